"""SimHash near copies: fingerprints of three-word shingles, linked at two differing bits.

Words are runs of other than ASCII white space after lower-casing A-Z; a shingle is three
words joined by a space (a shorter text: all its words), repeats included.  A bit of the
fingerprint is 1 if it is set in over half of the shingles' XXH64 (seed 42).  A text
without words, or NULL, has fingerprint 0, which links like any other.

Linking is exact.  Distinct fingerprints are laid in tiles by the population counts of their
eight bytes.  Two that differ in at most two bits are in tiles whose counts differ by at
most two in sum, so only such pairs of tiles are compared, by exclusive-or and bit counts
over numpy blocks.  A tile reports a spanning set of its links, never all its pairs.

A group is what links connect; its id is its smallest doc_id (NULL only if all are).
Repeated rows are members like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.names import free_name
from rankflow.llm.graph import components
from rankflow.llm.tiles import compare, lay_tiles
from rankflow.scratch import stage

SEED = 42
RADIUS = 2
#: Shingles whose bits are spread out at once.
BLOCK = 1 << 15
#: A fingerprint with more than this part of all rows is joined by broadcast.
FREQUENT = 4096
#: Links that a tile gathers before it hands them on.
HELD = 50_000


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else (
        [b" ".join(words)])
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i:i + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp`` of every row."""
    asked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                        F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column("text")],
                           dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(fps)],
                names=["doc_id", "text_hash", "fp"])

    return asked.mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint")


def _moves() -> list[int]:
    """Steps to the tiles within the radius, as differences of keys, one of each two."""
    units = [1 << (4 * i) for i in range(8)]
    sums = {s * a for a in units for s in (1, 2)}
    sums |= {a * s + b * t for a, b in combinations(units, 2) for s in (1, -1) for t in (1, -1)}
    return sorted({abs(x) for x in sums})


class _Tile:
    """Links among the owners of a tile and to its visitors, as a spanning set."""

    def __init__(self, key: tuple, owners: pa.Table):
        self.fp = owners.column("fp").to_numpy().view(np.uint64)
        self.up = list(range(len(self.fp)))
        self.links: list[tuple[int, int]] = []
        if len(self.fp) > 1:
            self._compare(self.fp, own=True)

    def _root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def _compare(self, others: np.ndarray, own: bool) -> None:
        step = max(1, (1 << 20) // len(self.fp))
        for at in range(0, len(others), step):
            block = others[at:at + step]
            near = np.bitwise_count(block[:, None] ^ self.fp[None, :]) <= RADIUS
            last, anchor = -1, -1
            for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
                if own:
                    anchor = at + i
                elif i != last:
                    # A visitor's first link; its others only join owners.
                    last, anchor = i, j
                    self.links.append((int(block[i]), int(self.fp[j])))
                a, b = self._root(anchor), self._root(j)
                if a != b:
                    self.up[a] = b
                    self.links.append((int(block[i]), int(self.fp[j])))

    def visit(self, block: pa.RecordBatch) -> pa.RecordBatch | None:
        self._compare(block.column("fp").to_numpy().view(np.uint64), own=False)
        return self.close() if len(self.links) > HELD else None

    def close(self) -> pa.RecordBatch:
        pairs = np.array(self.links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        self.links = []
        return pa.RecordBatch.from_arrays(
            [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """``u, v``: links that connect all distinct ``fp`` within the radius."""
    counts = [F.bit_count(F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)))
              .cast("bigint") * F.lit(1 << (4 * i)) for i in range(8)]
    key = counts[0]
    for c in counts[1:]:
        key = key + c
    owners = fps.select(key.alias("tile"), "fp")
    # A step that would leave a count's range ends in a key that no tile has.
    moves = F.array(*[F.lit(m).cast("bigint") for m in _moves()])
    visitors = owners.select(F.explode(F.transform(moves, lambda m: F.col("tile") + m)).alias("tile"),
                             "fp")
    placed = lay_tiles(owners, visitors, ["tile"], "fp")
    return compare(placed, ["tile"], ["fp"], _Tile, "u bigint, v bigint")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp, component_id, root`` of every row (a root per group)."""
    rows = stage(fingerprints(docs, id_col, text), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(fingerprint_links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    linked = distinct.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    ids = linked.join(least, "root").select("fp", "root", "least")
    known = stage(distinct.join(ids, "fp", "left").select(
        "fp", "n", F.coalesce("least", "first").alias("component_id"),
        F.coalesce("root", "fp").alias("root")), "components")
    # Fewer than FREQUENT fingerprints have more than that share of the rows each, so their table is
    # broadcast; the rows of any other are few beside a task's.
    share = F.lit(known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / FREQUENT)
    found = ["component_id", "root"]
    hot = known.where(F.col("n") > share).select("fp", *[F.col(c).alias(f"_{c}") for c in found])
    judged = rows.select("doc_id", "text_hash", "fp").join(F.broadcast(hot), "fp", "left")
    direct = judged.where("_root IS NOT NULL").select(
        "doc_id", "text_hash", "fp", *[F.col(f"_{c}").alias(c) for c in found])
    others = judged.where("_root IS NULL").join(
        known.where(F.col("n") <= share).select("fp", *found), "fp")
    return direct.unionByName(others.select("doc_id", "text_hash", "fp", *found))


def simhash_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    return near_copies(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the smallest id, and one of its repeats.

    Texts are not shuffled for the comparison; only the rows that go are joined.
    """
    rows = near_copies(docs, id_col, text)
    groups = rows.groupBy("root", "component_id", "doc_id", "text_hash").agg(
        F.count(F.lit(1)).alias("n"))
    # Rows without their group's id go, without a look at the rest of the group.  Of
    # those with it, the smallest text hash stays.
    has_id = F.col("doc_id").eqNullSafe(F.col("component_id"))
    heads = groups.where(has_id)
    first = heads.groupBy("root").agg(F.min("text_hash").alias("head"))
    fate = F.when(F.col("text_hash") != F.col("head"), 0).when(F.col("n") > 1, 1)
    decided = heads.join(first, "root").select("doc_id", "text_hash", fate.alias("_keep"))
    others = groups.where(~has_id).select("doc_id", "text_hash", F.lit(0).alias("_keep"))
    keep, i, h = (free_name(docs, name) for name in ("_keep", "_i", "_h"))
    verdicts = stage(decided.where("_keep IS NOT NULL").unionByName(others).select(
        F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.col("_keep").alias(keep)), "verdicts")
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(h))
    judged = docs.join(verdicts, same, "left").drop(i, h)
    once = judged.where(F.col(keep).isNull())
    # Exact repeats of one row, id included: one of them stays.
    repeats = judged.where(F.col(keep) == 1).drop(keep).dropDuplicates([id_col, text])
    return once.drop(keep).unionByName(repeats)
