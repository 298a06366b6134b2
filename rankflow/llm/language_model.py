"""Language-model scores by context-tree weighting over bytes.

A text is its bytes, A-Z lowered, and an end byte 0.  A byte is eight binary decisions; each of
the 255 places in a byte has a tree of contexts, the last ``DEPTH`` bytes.  A node counts the
zeros and ones that followed its context in the training texts.  Its Krichevsky-Trofimov block
probability and the product of its children's weighted probabilities are mixed half and half,
from the leaves up to the root, which gives the weight of stopping at each depth.  A bit's
probability mixes the KT estimates of all depths on its path by those weights.  A text's
score is the sum of its bits' log10 probabilities; divided by its bytes, it is a code
length.  The unigram score over words, smoothed by one, comes with it.

How it runs.  Training texts are counted per task and summed (``counts``): one row per
distinct (DEPTH + 1)-gram and word, however large the corpus.  Trees are worked out per last
two bytes of a context, those of many contexts at once in shards of some 200,000 grams.  Their
weights go up into the two top levels (65,280 nodes at most, the only part of the model that
the driver sees and tasks share).  Words are found and counted as Arrow columns.  Documents are
dealt into blocks of bounded bytes; a block asks for the values of its distinct grams and
words, found in one reading of its texts, by joins, and its documents meet the answers in one task.  So no task and not the
driver ever holds the model.  A block is a hash of id and text; rows that repeat both so
often that they have more than an eighth of a block are scored once, and each of them is
given that score by a join, so that repeats do not make a block large.

NULL texts are empty.  Rows with a NULL id are training rows.  Repeated rows count and score
as often as they are there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.llm.words import LOWER, flat, pieces
from rankflow.scratch import stage

DEPTH = 4
#: Bytes of text that a block has on average.
BLOCK_BYTES = 16 << 20
#: Words and grams that a task counts before it hands them on.
HELD = 150_000
#: Grams whose trees are worked out together, on average.
TREE_GRAMS = 200_000
#: The word that ends a text, which no text can hold.
END = b" "

_bytes = np.arange(256)
IN_WORD = ~(((_bytes >= 9) & (_bytes <= 13)) | (_bytes == 32))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_rows(column: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """``(first row, words, where each row's words begin)`` per piece, without the ends."""
    body, at = flat(column)
    for first, last in pieces(at):
        text, cut = LOWER[body[at[first]:at[last]]], at[first:last + 1] - at[first]
        inside = IN_WORD[text]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = cut[:-1][cut[:-1] < len(text)]
        begins[edges] = inside[edges]
        # Without the white space between them the words lie end to end.
        bare = text[inside]
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), int(np.count_nonzero(begins)),
            [None, pa.py_buffer(np.append(np.flatnonzero(begins[inside]), len(bare))), pa.py_buffer(bare)])
        yield first, words, np.searchsorted(np.flatnonzero(begins), cut)


def gram_rows(column: pa.Array, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, grams, first gram of each row)``: each byte with the ``depth`` before it.

    A gram has its newest byte lowest.  Zeros stand before a text, and one ends it.
    """
    body, at = flat(column)
    for first, last in pieces(at):
        size = np.diff(at[first:last + 1])
        cuts = np.r_[0, np.cumsum(size + 1)]
        wide = np.zeros(int(cuts[-1]) + depth * len(size), dtype=np.uint8)
        begins = cuts[:-1] + depth * np.arange(len(size))
        newest = np.ones(len(wide), dtype=bool)
        newest[(begins[:, None] + np.arange(depth)).ravel()] = False
        filled = newest.copy()
        filled[begins + depth + size] = False
        wide[filled] = LOWER[body[at[first]:at[last]]]
        n = len(wide) - depth
        grams = wide[:n].astype(np.int64)
        for k in range(1, depth + 1):
            grams <<= 8
            grams |= wide[k:k + n]
        yield first, grams[newest[depth:]], cuts


def training_counts(docs: DataFrame, depth: int) -> DataFrame:
    """``word BINARY, gram BIGINT, n``: partial counts of the training rows, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams, times, held_words, held, ends = [], [], [], 0, 0, 0

        def words_out() -> pa.RecordBatch:
            found = pa.Table.from_batches(words).group_by("word").aggregate([("n", "sum")])
            word, n = (found.column(c).combine_chunks() for c in ("word", "n_sum"))
            return _count_rows(word, None, n)

        def grams_out() -> pa.RecordBatch:
            keys, where = np.unique(np.concatenate(grams), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate(times)).astype(np.int64)
            return _count_rows(None, pa.array(keys), pa.array(n))

        for batch in batches:
            ends += batch.num_rows
            for _, found, _ in word_rows(batch.column("text")):
                n = found.value_counts()
                words.append(pa.RecordBatch.from_arrays(n.flatten(), names=["word", "n"]))
                held_words += len(n)
                if held_words > 4 * HELD:
                    yield words_out()
                    words, held_words = [], 0
            for _, found, _ in gram_rows(batch.column("text"), depth):
                keys, n = np.unique(found, return_counts=True)
                grams.append(keys)
                times.append(n)
                held += len(keys)
                if held > 4 * HELD:
                    yield grams_out()
                    grams, times, held = [], [], 0
        if words:
            yield words_out()
        if ends:
            yield _count_rows(pa.array([END], pa.large_binary()), None, pa.array([ends]))
        if held:
            yield grams_out()

    return docs.where("NOT held_out").select("text").mapInArrow(
        run, "word binary, gram bigint, n bigint")


def _count_rows(words: pa.Array | None, grams: pa.Array | None, n: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.nulls(len(n), pa.binary()) if words is None else words.cast(pa.binary()),
         pa.nulls(len(n), pa.int64()) if grams is None else grams, n], names=["word", "gram", "n"])


# --- the trees -----------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for ``x >= 0.5``, by Stirling's series at ``x + 8``."""
    z = x + 8.0
    series = (1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5) - 1 / (1680 * z ** 7)
              + 1 / (1188 * z ** 9))
    shift = sum(np.log(x + k) for k in range(8))
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the KT probability of a block of so many zeros and ones."""
    return (log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0)
            - np.log(np.pi))


def log_mix(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, children) - np.log(2.0)


class Subtree:
    """The nodes of depths ``top`` to ``depth`` for one bit of the bytes of some grams.

    ``levels[d]`` has the nodes of depth ``d``: their keys (context and place in the byte),
    counts, log weighted probabilities and weights of stopping; ``at[d]`` is each gram's node.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray, bit: int, depth: int, top: int):
        byte, context = grams & 255, grams >> 8
        place = (1 << bit) | (byte >> (8 - bit))
        self.bit = (byte >> (7 - bit)) & 1
        times = n.astype(np.float64)
        self.levels: dict[int, dict[str, np.ndarray]] = {}
        self.at: dict[int, np.ndarray] = {}
        keys = (context << 8) | place
        zeros, ones, below = times * (self.bit == 0), times * (self.bit == 1), None
        rows = None
        for d in range(depth, top - 1, -1):
            if d < depth:
                keys = ((keys >> 8) & ((1 << (8 * d)) - 1)) << 8 | (keys & 255)
            nodes, where = np.unique(keys, return_inverse=True)
            zeros, ones = (np.bincount(where, weights=x, minlength=len(nodes)) for x in (zeros, ones))
            own = log_kt(zeros, ones)
            under = None if below is None else np.bincount(where, weights=below, minlength=len(nodes))
            total = own if under is None else log_mix(own, under)
            rows = where if rows is None else where[rows]
            self.at[d] = rows
            self.levels[d] = {
                "key": nodes, "zeros": zeros, "ones": ones, "total": total,
                "stop": np.ones(len(nodes)) if under is None else np.exp(own - np.log(2.0) - total)}
            keys, below = nodes, total

    def probabilities(self, depth: int, top: int) -> np.ndarray:
        """Of each gram's bits, mixed over the depths from ``top`` down."""
        p = None
        for d in range(depth, top - 1, -1):
            level, at = self.levels[d], self.at[d]
            count = np.where(self.bit == 1, level["ones"][at], level["zeros"][at])
            kt = (count + 0.5) / (level["zeros"][at] + level["ones"][at] + 1.0)
            stop = level["stop"][at]
            p = kt if p is None else stop * kt + (1 - stop) * p
        return p


def _by_shard(grams: DataFrame, shared: int, shards: int) -> DataFrame:
    """Grams dealt into shards by the last ``shared`` bytes of their contexts."""
    context = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << (8 * shared)) - 1))
    return grams.withColumn("shard", F.pmod(F.xxhash64(context), F.lit(shards)).cast("int"))


def gram_values(grams: DataFrame, depth: int) -> DataFrame:
    """``gram, value``: the log10 probability of each gram's byte in its context.

    ``grams`` has ``gram, n`` for all grams that will be asked for, ``n`` being 0 for those
    that training did not have.
    """
    shared = min(2, depth)

    def tops(table: pa.Table) -> pa.Table:
        found, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
        ends = [Subtree(found, n, bit, depth, shared).levels[shared] for bit in range(8)]
        return pa.table({c: np.concatenate([e[c] for e in ends])
                         for c in ("key", "zeros", "ones", "total")})

    sharded = _by_shard(grams, shared, max(1, -(-grams.count() // TREE_GRAMS)))
    # One row per last byte and place in the byte comes to the driver: 65,280 at most.
    last = F.col("key").bitwiseAND(F.lit((1 << 16) - 1)) if shared else F.col("key")
    rows = sharded.groupBy("shard").applyInArrow(
        tops, "key bigint, zeros double, ones double, total double").groupBy(
        last.alias("key")).agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "total")]).toArrow()
    upper: list[dict[str, np.ndarray]] = []
    if shared:
        order = np.argsort(rows.column("key").to_numpy())
        key, zeros, ones, below = (rows.column(c).to_numpy()[order]
                                   for c in ("key", "zeros", "ones", "total"))
        for d in ((1, 0) if shared == 2 else (0,)):
            if d == 0:
                key = key & 255
                nodes, where = np.unique(key, return_inverse=True)
                zeros, ones, below = (np.bincount(where, weights=x, minlength=len(nodes))
                                      for x in (zeros, ones, below))
                key = nodes
            own = log_kt(zeros, ones)
            total = log_mix(own, below)
            upper.append({"key": key, "zeros": zeros, "ones": ones,
                          "stop": np.exp(own - np.log(2.0) - total), "depth": np.array(d)})
            below = total

    def score(table: pa.Table) -> pa.Table:
        found, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
        value = np.zeros(len(found))
        for bit in range(8):
            tree = Subtree(found, n, bit, depth, shared)
            p = tree.probabilities(depth, shared)
            keys = tree.levels[depth]["key"][tree.at[depth]]
            for level in upper:
                d = int(level["depth"])
                short = (((keys >> 8) & ((1 << (8 * d)) - 1)) << 8) | (keys & 255)
                at = np.searchsorted(level["key"], short)
                count = np.where(tree.bit == 1, level["ones"][at], level["zeros"][at])
                kt = (count + 0.5) / (level["zeros"][at] + level["ones"][at] + 1.0)
                p = level["stop"][at] * kt + (1 - level["stop"][at]) * p
            value += np.log10(p)
        return pa.table({"gram": found, "value": value})

    return sharded.groupBy("shard").applyInArrow(score, "gram bigint, value double")


# --- documents -----------------------------------------------------------------------


def _asked(dealt: DataFrame, depth: int) -> DataFrame:
    """``block, word, gram``: the distinct words and grams of each block."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        words, pieces_of = [pa.array([END], pa.large_binary())], []
        for batch in table.select(["text"]).to_batches():
            words += [found.unique() for _, found, _ in word_rows(batch.column("text"))]
            for _, found, _ in gram_rows(batch.column("text"), depth):
                pieces_of.append(np.unique(found))
        grams = np.unique(np.concatenate(pieces_of))
        words = pa.chunked_array(words).unique().cast(pa.binary())
        n, m = len(words), len(grams)
        return pa.table({
            "block": pa.array(np.full(n + m, block, dtype=np.int32)),
            "word": pa.concat_arrays([words, pa.nulls(m, pa.binary())]),
            "gram": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(grams)])})

    return dealt.groupBy("block").applyInArrow(run, "block int, word binary, gram bigint")


class GramTable:
    """Values of sorted grams: a hash finds most at once, a search the others."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.grams, self.values = grams, values
        self.shift = np.uint64(64 - max(1, (8 * len(grams)).bit_length()))
        self.slots = np.zeros(1 << (64 - int(self.shift)), dtype=np.int32)
        self.slots[self._slot(grams)] = np.arange(len(grams), dtype=np.int32)

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.view(np.uint64) * self.FACTOR) >> self.shift).view(np.int64)

    def __getitem__(self, asked: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(asked)]
        others = np.flatnonzero(self.grams[at] != asked)
        at[others] = np.searchsorted(self.grams, asked[others])
        return self.values[at]


def _scored(depth: int, unseen: float, n_train: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        known = answers.filter(answers.column("word").is_valid())
        words = known.column("word").cast(pa.large_binary()).combine_chunks()
        # The last value is that of words without a row.
        value = np.append(known.column("value").to_numpy(), unseen)
        of_end = pc.index(words, pa.scalar(END, pa.large_binary())).as_py()
        rest = answers.filter(answers.column("gram").is_valid()).sort_by("gram")
        logs = GramTable(rest.column("gram").to_numpy(), rest.column("value").to_numpy())
        del rest, known, answers
        tokens, seen, base, score = ([np.zeros(0)] for _ in range(4))
        for batch in docs.select(["text"]).to_batches():
            for _, own, cuts in word_rows(batch.column("text")):
                own = own.dictionary_encode()
                place = pc.index_in(own.dictionary, value_set=words).fill_null(len(words))
                place = place.to_numpy()[own.indices.to_numpy()]
                n, row = np.diff(cuts), np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                tokens.append(n + 1)
                seen.append(np.bincount(row, weights=place < len(words), minlength=len(n)) + (of_end >= 0))
                base.append(np.bincount(row, weights=value[place], minlength=len(n)) + value[of_end])
            for _, own, cuts in gram_rows(batch.column("text"), depth):
                score.append(np.add.reduceat(logs[own], cuts[:-1]))
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"),
            "n_tokens": np.concatenate(tokens).astype(np.int64),
            "n_known": np.concatenate(seen).astype(np.int64),
            "train_tokens": np.full(docs.num_rows, n_train, dtype=np.int64),
            "base_score": np.concatenate(base), "score": np.concatenate(score),
            "n_bytes": docs.column("n_bytes"), "key": docs.column("key")})

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                    depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes`` of

    every row; the code length of a text is ``-score / log10(2)`` bits."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    keyed = rows.withColumn("n_bytes", F.octet_length("text").cast("bigint")).withColumn(
        "key", F.xxhash64("doc_id", "text"))
    # By their bytes there are at most eight of these keys per block.
    hot = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("size"))
                .where((F.col("n") > 1) & (F.col("size") > block_bytes // 8)).select("key"), "repeated")
    repeats = not hot.isEmpty()
    once = keyed
    if repeats:
        often = keyed.join(F.broadcast(hot), "key", "left_semi")
        once = keyed.join(F.broadcast(hot), "key", "left_anti").unionByName(
            often.distinct())
    dealt = once.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int"))

    counted = training_counts(rows, depth)
    counts = stage(counted.groupBy("word", "gram").agg(F.sum("n").alias("n")), "counts")
    words = counts.where("word IS NOT NULL").select("word", "n")
    total, distinct = words.agg(F.sum("n"), F.count("n")).first()
    spread = (total or 0) + distinct + 1
    # An unknown word has the value of none seen, so that it needs no row.
    unseen = float(np.log10(1 / spread))
    word_values = words.select("word", F.log10((F.col("n") + 1) / F.lit(float(spread))).alias("value"))

    # Words and grams are asked for in one reading of the texts.
    asked = stage(_asked(dealt, depth), "asked")
    ask_words = asked.where("word IS NOT NULL").select("block", "word")
    ask_grams = asked.where("gram IS NOT NULL").select("block", "gram")
    every = ask_grams.select("gram").distinct().join(
        counts.where("gram IS NOT NULL").select(F.col("gram").alias("_g"), "n"),
        F.col("gram") == F.col("_g"), "left").select("gram", F.coalesce("n", F.lit(0)).alias("n"))
    values = gram_values(stage(every, "every_gram"), depth)
    answers = ask_words.join(word_values, "word").select(
        "block", "word", F.lit(None).cast("bigint").alias("gram"), "value").unionByName(
        ask_grams.join(values, "gram").select(
            "block", F.lit(None).cast("binary").alias("word"), "gram", "value"))
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scored(depth, unseen, int(total or 0)),
        f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens bigint,"
        " n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint,"
        " key bigint")
    if not repeats:
        return scored.drop("key")
    scored = stage(scored, "scored")
    own = scored.join(F.broadcast(hot), "key", "left_semi").withColumnRenamed("doc_id", "_id")
    each = often.select(F.col("key").alias("_key"), "doc_id").join(
        F.broadcast(own), (F.col("_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return scored.join(F.broadcast(hot), "key", "left_anti").drop("key").unionByName(
        each.select(*[c for c in scored.columns if c != "key"]))
