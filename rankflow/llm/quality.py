"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``WORDS`` words, of which only the bag has a label.  Each
passage is described by shares of kinds of characters, words and word shapes, and encoded by
a tanh layer, ``h = tanh(x W + b)``.  Gated attention weighs the passages of a document,
``a = softmax(tanh(h V) * sigmoid(h U) . w)``, and a logistic layer scores the weighted mean of
``h``.  All layers are learned together, by Adam on the cross entropy of the document labels.

Labels are learned from rows that are not held out (``crc32(id as text) mod 4 <> 2``).  The fit
runs on at most ``SAMPLE`` distinct labelled pairs of id and text, those with the smallest
hashes.  One bag of each comes to the driver, with the number of its rows times that of its
labels as weight, however often either is repeated; a training bag has all passages of its
text (188 bytes a passage).  Scoring reads every passage of every document.  Nothing but the
text is an input of a score.

NULL and empty texts are one passage without words.  A NULL id is not held out and has no
label.  Labels other than 0 and 1 are not used; a repeated label counts as often as it is
there.  If the labels are not of both kinds, no classifier is fitted and every score is their
smoothed mean; ``keep_good`` then keeps all rows.  Repeated documents give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rankflow.llm.names import free_name
from rankflow.llm.words import BASE, flat, mixed, pieces

WORDS = 50
#: Bytes of text that are described at once (some 50 bytes of memory each).
PIECE = 1 << 18
SAMPLE = 6000
THRESHOLD = 0.7
HIDDEN, GATE, ROUNDS, BATCH, RATE, DECAY, SEED = 24, 12, 30, 64, 0.01, 1e-4, 11

# Kinds of bytes.
SPACE, BREAK, LOWER, UPPER, DIGIT, FOREIGN, POINT, CALL, QUOTE, SIGN, FRAME, OTHER = range(12)
KINDS = 12
SHAPES = 24
FEATURES = KINDS + 11 + SHAPES


def _kinds() -> np.ndarray:
    table = np.full(256, OTHER, dtype=np.uint8)
    table[128:] = FOREIGN
    for chars, kind in (("abcdefghijklmnopqrstuvwxyz", LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER),
                        ("0123456789", DIGIT), (" ", SPACE), ("\t\n\r\v\f", BREAK), (".,;:", POINT),
                        ("!?", CALL), ("'\"()-", QUOTE), ("#$%&*@", SIGN), ("|<>[]{}=+/\\^~_`", FRAME)):
        table[list(chars.encode())] = kind
    return table


KIND = _kinds()


def passages(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, features of passages, first passage of each row)`` per piece of a column.

    A text longer than a piece is described in windows of whole passages.
    """
    body, at = flat(column)
    for first, last in pieces(at, PIECE):
        text, cut = body[at[first]:at[last]], at[first:last + 1] - at[first]
        if last - first > 1 or len(text) <= PIECE:
            yield first, *_describe(text, cut)
            continue
        found = [_describe(window, np.array([0, len(window)]))[0] for window in _windows(text)]
        x = np.concatenate(found)
        yield first, x, np.array([0, len(x)])


def _windows(text: np.ndarray) -> Iterator[np.ndarray]:
    """A text in parts that begin where a passage begins.

    A part holds about ``PIECE`` bytes; more only where one passage is longer than that.
    """
    at, size = 0, PIECE
    while at + size < len(text):
        inside = KIND[text[at:at + size]] > BREAK
        begins = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
        whole = (len(begins) - 1) // WORDS * WORDS
        if whole < WORDS:
            size *= 2
            continue
        yield text[at:at + begins[whole]]
        at, size = at + int(begins[whole]), PIECE
    yield text[at:]


def _describe(text: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = len(cut) - 1
    kind = KIND[text]
    inside = kind > BREAK
    owner = np.repeat(np.arange(rows, dtype=np.int32), np.diff(cut))
    same = np.r_[False, owner[1:] == owner[:-1]] if len(text) else np.zeros(0, bool)
    begins = np.flatnonzero(inside & ~(same & np.r_[False, inside[:-1]])) if len(text) else (
        np.zeros(0, np.int64))
    ends = np.flatnonzero(inside & ~np.r_[same[1:] & inside[1:], False]) + 1 if len(text) else begins
    doc = owner[begins] if len(text) else begins
    # Passages: every WORDS words of a row; a row without words has one.
    word_cut = np.searchsorted(begins, cut)
    counts = np.diff(word_cut)
    per_row = np.maximum(1, -(-counts // WORDS))
    cuts = np.r_[0, np.cumsum(per_row)]
    n = int(cuts[-1])
    nth = np.arange(len(begins)) - word_cut[:-1][doc]
    part = cuts[:-1][doc] + nth // WORDS
    # Bytes go with the word before them, and those before a row's first word with its first passage.
    spots = np.r_[cut[:-1], begins]
    order = np.argsort(spots, kind="stable")
    byte_part = np.repeat(np.r_[cuts[:-1], part][order].astype(np.int32),
                          np.diff(np.r_[spots[order], len(text)]))
    x = np.zeros((n, FEATURES))
    size = np.maximum(1, np.bincount(byte_part, minlength=n))
    x[:, :KINDS] = np.bincount(byte_part.astype(np.int64) * KINDS + kind, minlength=n * KINDS).reshape(
        n, KINDS) / size[:, None]
    if not len(begins):
        return x, cuts
    held = np.bincount(part, minlength=n)
    total = np.maximum(1, held)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(part, weights=flag, minlength=n) / total

    length = ends - begins
    head, tail = kind[begins], kind[ends - 1]
    edges = np.column_stack([begins, ends]).ravel()

    def within(per_byte: np.ndarray) -> np.ndarray:
        """Sums over the bytes of each word."""
        kinds = np.int64 if per_byte.dtype == bool else per_byte.dtype
        return np.add.reduceat(np.append(per_byte, per_byte.dtype.type(0)), edges, dtype=kinds)[::2]

    ups, digits = within(kind == UPPER), within(kind == DIGIT)
    letters = within((kind == LOWER) | (kind == UPPER) | (kind == FOREIGN))
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(length.max()), BASE, dtype=np.uint64)])
    # The place of each byte in its word; bytes between words are not summed.
    place = np.arange(len(text)) - np.repeat(np.r_[0, begins], np.diff(np.r_[0, begins, len(text)]))
    np.minimum(place, len(powers) - 1, out=place)
    word = mixed(within((text.astype(np.uint64) + np.uint64(1)) * powers[place]))
    again = np.r_[False, (word[1:] == word[:-1]) & (part[1:] == part[:-1])]
    pairs = np.sort((part.astype(np.uint64) << np.uint64(32)) | (word >> np.uint64(32)))
    fresh = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
    distinct = np.bincount((fresh >> np.uint64(32)).astype(np.int64), minlength=n)
    k = KINDS
    for value in (held / WORDS, share(length) / 10, share(length <= 2), share(length >= 12),
                  share(head == UPPER), share((ups == letters) & (letters >= 2)),
                  share((tail == SIGN) | (tail == FRAME) | (tail == CALL)),
                  share(digits > 0), share(letters == 0), share(again),
                  distinct / total):
        x[:, k] = value
        k += 1
    shape = (head.astype(np.int64) * KINDS + tail) * 4 + np.digitize(length, (3, 6, 10))
    spot = (mixed(shape.astype(np.uint64)) % np.uint64(SHAPES)).astype(np.int64)
    x[:, k:] = np.bincount(part * SHAPES + spot, minlength=n * SHAPES).reshape(
        n, SHAPES) / total[:, None]
    return x, cuts


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


@dataclass
class Model:
    """Weights of the network; ``mean`` and ``scale`` put features on one footing."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] | None
    constant: float = 0.5

    def forward(self, x: np.ndarray, cuts: np.ndarray) -> tuple:
        """Scores of the bags ``x[cuts[i]:cuts[i + 1]]``, and what led to them."""
        w = self.weights
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * g) @ w["w"]
        starts = cuts[:-1]
        bag = np.repeat(np.arange(len(starts)), np.diff(cuts))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return _sigmoid(z @ w["c"] + w["d"]), (h, t, g, a, z, bag, starts)

    def score(self, x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(cuts) - 1, self.constant)
        return self.forward((x - self.mean) / self.scale, cuts)[0]


def _gradients(model: Model, x: np.ndarray, cuts: np.ndarray, y: np.ndarray,
               times: np.ndarray | float = 1.0) -> dict:
    w = model.weights
    p, (h, t, g, a, z, bag, starts) = model.forward(x, cuts)
    err = times * (p - y) / len(y)
    dz = err[:, None] * w["c"]
    da = (dz[bag] * h).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, starts)[bag])
    dt, dg = de[:, None] * w["w"] * g * (1 - t * t), de[:, None] * w["w"] * t * g * (1 - g)
    dh = a[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["U"].T
    du = dh * (1 - h * h)
    return {"W": x.T @ du, "b": du.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg,
            "w": (t * g).T @ de, "c": z.T @ err, "d": np.array(err.sum())}


def fit(bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray | None = None) -> Model:
    """Learn from bags of passage features and their labels; the same each time.

    A label is the share of ones among the labels of a bag, which count ``weights`` times.
    """
    weights = np.ones(len(labels)) if weights is None else weights
    ones, total = (labels * weights).sum(), weights.sum()
    if not 0 < ones < total:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), None, float((ones + 1) / (total + 2)))
    every, of_passage = np.concatenate(bags), np.repeat(weights, [len(b) for b in bags])
    mean = np.average(every, axis=0, weights=of_passage)
    spread = np.sqrt(np.average((every - mean) ** 2, axis=0, weights=of_passage))
    model = Model(mean, spread + 1e-3, {})
    bags = [(b - model.mean) / model.scale for b in bags]
    # A bag of more than the mean weight is split over steps: 2 entries per bag on average at most.
    share = weights / weights.mean()
    parts = np.maximum(1, np.ceil(share - 1e-9)).astype(int)
    entries, share = np.repeat(np.arange(len(bags)), parts), np.repeat(share / parts, parts)
    rng = np.random.default_rng(SEED)
    shapes = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE),
              "w": (GATE,), "c": (HIDDEN,), "d": ()}
    w = model.weights
    for name, shape in shapes.items():
        w[name] = np.asarray(rng.normal(0, 1, shape) / np.sqrt(max(1, shape[0] if shape else 1)))
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for n in range(ROUNDS):
        rate = RATE * (1 - n / ROUNDS)
        order = rng.permutation(len(entries))
        for at in range(0, len(order), BATCH):
            times = share[order[at:at + BATCH]]
            chosen = entries[order[at:at + BATCH]]
            cuts = np.r_[0, np.cumsum([len(bags[i]) for i in chosen])]
            grads = _gradients(model, np.concatenate([bags[i] for i in chosen]), cuts, labels[chosen],
                               times)
            step += 1
            for k, grad in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                up = first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                w[k] = w[k] - rate * (up + DECAY * w[k])
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
          label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled texts that are not held out."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)
                          & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(
        F.avg(F.col(label).cast("double")).alias("_y"), F.count(F.lit(1)).alias("_times"))
    # Pairs of id and text hash are drawn, then one text of each is fetched.
    held = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text)).alias("_hash"),
                       F.col(text).alias("_text"))
    drawn = held.groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("_rows")).join(
        marked, "_id").orderBy(F.xxhash64("_id", "_hash"), "_id", "_hash").limit(sample).select(
        "_id", "_hash", "_y", (F.col("_times") * F.col("_rows")).cast("double").alias("_weight"))
    rows = held.join(F.broadcast(drawn), ["_id", "_hash"]).groupBy(
        "_id", "_hash", "_y", "_weight").agg(F.min("_text").alias("_text"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x, cuts in passages(batch.column("_text")):
                made = [x[a:b].astype("<f4").tobytes()
                        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                block = batch.slice(first, len(made))
                yield pa.RecordBatch.from_arrays(
                    [*[block.column(c) for c in keys], pa.array(made, pa.binary())],
                    names=[*keys, "bag"])

    keys = ["_id", "_hash", "_y", "_weight"]
    kind = rows.schema["_id"].dataType.simpleString()
    table = rows.mapInArrow(
        bags, f"_id {kind}, _hash bigint, _y double, _weight double, bag binary").toArrow()
    found = sorted(zip(*[table.column(c).to_pylist() for c in (*keys, "bag")]))
    return fit([np.frombuffer(r[4], dtype="<f4").reshape(-1, FEATURES).astype(float) for r in found],
               np.array([r[2] for r in found]), np.array([r[3] for r in found]))


def with_score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of every text in ``into`` (a column of that name is replaced)."""
    kept = [c for c in docs.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(x, cuts) for _, x, cuts in passages(batch.column(text))]
            values = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(values, pa.float64())],
                names=[*kept, into])

    source = docs.select(*kept)
    schema = StructType([*source.schema.fields, StructField(into, DoubleType())])
    return source.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    rows = docs.select("doc_id", "text")
    scored = with_score(rows, train(rows, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score at least ``THRESHOLD``.

    All rows, if the labels met in ``docs`` are not of both kinds: there is nothing to tell
    good rows by then.
    """
    model = train(docs, labels)
    if model.weights is None:
        return docs
    score = free_name(docs, "_score")
    return with_score(docs, model, into=score).where(F.col(score) >= THRESHOLD).drop(score)
