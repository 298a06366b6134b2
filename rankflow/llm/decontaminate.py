"""Benchmark passages in documents, also reordered ones, by greedy string tiling.

1. Seeds: every ``SHINGLE`` words in a row have a rolling hash.  Those of the benchmark set
   bits of a filter of a fixed size, and a scan of the documents keeps the texts that may
   hold one.  The kept seeds are joined with the benchmark's, which gives pairs of a text
   and an item that share a seed.
2. Tiling: for each pair, the longest match of unmarked words is marked in both, again and
   again, down to matches of ``SHINGLE`` words.  Matches are found by the rolling hashes
   (Karp-Rabin), so a passage is found in whatever order its parts stand.
3. The coverage is the share of an item's words that are marked.  A text is contaminated
   if an item is covered by at least ``THRESHOLD``.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters.  Items of
under ``SHINGLE`` words, or NULL, match nothing; NULL and empty texts hold nothing.  Equal
texts are tiled once; every document row gets its result, repeated rows as well.  If several
items have the same coverage the smallest ``item_id`` is named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.names import free_name
from rankflow.llm.words import BASE, UNDO, hashed_words, mixed, shingle_hashes
from rankflow.scratch import stage

SHINGLE = 5
THRESHOLD = 0.8
#: Bits of the filter (2**23 are 1 MB), two of which a seed sets: a larger benchmark lets more texts through to the
#: join, which is exact.
FILTER_BITS = 23


def _seeds(table: DataFrame, keys: dict[str, str], text: str, only: bytes | None) -> DataFrame:
    """``keys, words BINARY, seeds ARRAY`` of the texts with a seed (that ``only`` lets pass)."""
    wanted = table.select(*[F.col(c).alias(k) for k, c in keys.items()], F.col(text).alias("_text"))
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if only is None else np.unpackbits(
            np.frombuffer(only, dtype=np.uint8), bitorder="little").view(bool)
        for batch in batches:
            rows, blobs, seeds = [], [], []
            for first, words, cut in hashed_words(batch.column("_text")):
                rolled = shingle_hashes(words, SHINGLE)
                here = np.ones(len(rolled), dtype=bool) if bits is None else (
                    bits[rolled >> np.uint64(64 - FILTER_BITS)]
                    & bits[rolled & np.uint64((1 << FILTER_BITS) - 1)])
                for row in np.unique(np.searchsorted(cut, np.flatnonzero(here), "right") - 1).tolist():
                    a, b = int(cut[row]), int(cut[row + 1])
                    own = rolled[a:max(a, b - SHINGLE + 1)]
                    own = np.unique(own[here[a:a + len(own)]])
                    if len(own):
                        rows.append(first + row)
                        blobs.append(words[a:b].tobytes())
                        seeds.append(own.view(np.int64))
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*[kept.column(k) for k in names], pa.array(blobs, pa.binary()),
                 pa.array(seeds, pa.list_(pa.int64()))], names=[*names, "words", "seeds"])

    kinds = ", ".join(f"{k} {wanted.schema[k].dataType.simpleString()}" for k in names)
    return wanted.mapInArrow(run, f"{kinds}, words binary, seeds array<bigint>")


def _filter(seeds: DataFrame) -> bytes:
    """The filter of all seeds: at most one row per 64 bits comes to the driver."""
    places = seeds.select(F.explode(F.array(
        F.shiftrightunsigned("seed", 64 - FILTER_BITS),
        F.col("seed").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)))).alias("place"))
    words = places.groupBy(F.shiftrightunsigned("place", 6).alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(place & 63 AS INT)))").alias("bits"))
    filled = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    for row in words.collect():
        filled[row["at"]] = row["bits"]
    return filled.tobytes()


class _Rolling:
    """Hashes of all windows of a word sequence, of any length, without marked words.

    ``places`` are the words' positions in their text, -1 for a gap, which is marked from the start.
    """

    def __init__(self, words: np.ndarray, places: np.ndarray):
        n = len(words)
        powers = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, dtype=np.uint64)])
        self.undo = np.cumprod(np.r_[np.uint64(1), np.full(n, UNDO, dtype=np.uint64)])
        self.sums = np.r_[np.uint64(0), np.cumsum(words * powers[:n])]
        self.places = places
        self.marked = (places < 0).astype(np.int64)

    def free_run(self) -> int:
        """Length of the longest stretch of unmarked words."""
        edges = np.flatnonzero(np.r_[1, self.marked, 1])
        return int((np.diff(edges) - 1).max())

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the unmarked windows and their hashes."""
        n = len(self.marked) - size + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        taken = np.r_[0, np.cumsum(self.marked)]
        at = np.flatnonzero(taken[size:size + n] == taken[:n])
        return at, mixed((self.sums[at + size] - self.sums[at]) * self.undo[at])

    def is_free(self, at: int, size: int) -> bool:
        return not self.marked[at:at + size].any()

    def mark(self, at: int, size: int) -> None:
        self.marked[at:at + size] = 1


def _stretches(words: np.ndarray, shared: np.ndarray, least: int) -> _Rolling:
    """Only the words inside a shared window (``shared`` are the starts), with gaps between stretches."""
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    edges[shared] += 1
    edges[shared + least] -= 1
    kept = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
    breaks = np.flatnonzero(np.diff(kept) > 1) + 1
    return _Rolling(np.insert(words[kept], breaks, np.uint64(0)), np.insert(kept, breaks, -1))


def _mark_all(a: _Rolling, b: _Rolling, size: int) -> Iterator[tuple[int, int, int]]:
    """Mark the matches of ``size`` words one after the other, by place in ``a``, then in ``b``."""
    (i, h), (j, g) = a.windows(size), b.windows(size)
    order = np.argsort(g, kind="stable")
    j, g = j[order], g[order]
    first, last = np.searchsorted(g, h, "left"), np.searchsorted(g, h, "right")
    tried: dict[int, int] = {}  # places of a hash that were marked once stay so
    for hit in np.flatnonzero(last > first).tolist():
        at, key, end = int(i[hit]), int(first[hit]), int(last[hit])
        if not a.is_free(at, size):
            continue
        k = tried.get(key, key)
        while k < end and not b.is_free(int(j[k]), size):
            k += 1
        tried[key] = k
        if k < end:
            a.mark(at, size)
            b.mark(int(j[k]), size)
            yield int(a.places[at]), int(b.places[j[k]]), size


def tiles(item: np.ndarray, text: np.ndarray, least: int = SHINGLE) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(item position, text position, words)``, the longest first.

    Of equally long ones the first in the item, then in the text, is marked.  Only words inside a shared
    window of ``least`` words are looked at, and each length of a tile is searched for once.
    """
    (i, h), (j, g) = (_Rolling(w, np.arange(len(w))).windows(least) for w in (item, text))
    a = _stretches(item, i[np.isin(h, g)], least)
    b = _stretches(text, j[np.isin(g, h)], least)
    done: list[tuple[int, int, int]] = []
    longest = len(item)
    while True:
        high = min(a.free_run(), b.free_run(), longest)
        low, best = least, 0
        size = high  # a whole passage is the usual case
        while low <= high:
            if np.isin(a.windows(size)[1], b.windows(size)[1]).any():
                best, low = size, size + 1
            else:
                high = size - 1
            size = (low + high + 1) // 2
        if not best:
            return done
        done.extend(_mark_all(a, b, best))
        longest = best - 1


def _coverage(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for words, item in zip(batch.column("words"), batch.column("item_words")):
                target = np.frombuffer(item.as_buffer(), dtype=np.uint64)
                text = np.frombuffer(words.as_buffer(), dtype=np.uint64)
                found.append(sum(n for _, _, n in tiles(target, text)) / len(target))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("item_id"), pa.array(found, pa.float64())],
                names=["key", "item_id", "coverage"])

    item = pairs.schema["item_id"].dataType.simpleString()
    return pairs.select("key", "item_id", "words", "item_words").mapInArrow(
        run, f"key binary, item_id {item}, coverage double")


def text_key(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key, n_items, coverage, item_id``: texts (by ``text_key``) that share a seed with an

    item, how many items are covered up to the threshold, and the best covered one."""
    items = stage(_seeds(benchmark, {"item_id": item_id}, item_text, None), "items")
    known = items.select("item_id", F.explode("seeds").alias("seed"))
    keyed = docs.select(text_key(text).alias("key"), F.col(text).alias("_body"))
    held = _seeds(keyed, {"key": "key"}, "_body", _filter(known))
    texts = stage(held.groupBy("key").agg(F.first("words").alias("words"),
                                          F.first("seeds").alias("seeds")), "texts")
    shared = texts.select("key", F.explode("seeds").alias("seed")).join(known, "seed").select(
        "key", "item_id").distinct()
    # Items of equal id are told apart by their words.
    pairs = shared.join(texts.select("key", "words"), "key").join(
        items.select(F.col("item_id").alias("_item"), F.col("words").alias("item_words")),
        F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item")
    covered = stage(_coverage(pairs), "coverage")
    first = F.min_by("item_id", F.struct((-F.col("coverage")).alias("c"), F.col("item_id")))
    return covered.groupBy("key").agg(
        F.count_if(F.col("coverage") >= THRESHOLD).alias("n_items"),
        F.max("coverage").alias("coverage"), first.alias("item_id"))


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """``doc_id, contaminated, coverage, n_items, item_id`` of every row."""
    found = contamination(docs, benchmark, text)
    return docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("key")).join(
        found, "key", "left").select(
        "doc_id", (F.coalesce("coverage", F.lit(0.0)) >= THRESHOLD).alias("contaminated"),
        F.round(F.coalesce("coverage", F.lit(0.0)), 6).alias("coverage"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is contaminated."""
    key = free_name(docs, "_key")
    found = stage(contamination(docs, benchmark, text).where(
        F.col("coverage") >= THRESHOLD).select(F.col("key").alias(key)), "contaminated")
    return docs.join(found, text_key(text) == F.col(key), "left_anti")
