"""Approximate nearest neighbours by cross-polytope hashing: largest inner product.

A fast pseudo-rotation (random signs and a Hadamard transform, three times, on the dimensions
filled up to a power of two) turns a unit vector, and the nearest signed axis is its bucket.
Each of ``TABLES`` tables has a rotation of its own.  A query probes the nearest
``PROBE_SHARE`` of the signed axes in every table, and its inner products with all vectors in
these buckets are taken in double precision on the original vectors.  Buckets of many vectors
are cut into parts (``tiles``), which queries visit in blocks, so no vector of a bucket is
left out.

The hash only sees directions, so vectors are also grouped by length, in bands of half a
power of two; a query probes its buckets in every band.  Copies of a vector are one with its
smallest ids, enough for any list, so that a vector which fills a third of the table is
compared once.  A query that finds fewer rows than it asks for is compared with every vector.

Vectors that are NULL, empty, zero, or hold NULL or non-finite components take no part, nor do
rows without an id.  Vectors of different lengths do not meet.  A query leaves out its own
row once; further rows that repeat its id are candidates.  Queries and candidates that are
equal in score are ordered by id.  An empty table gives no rows.  Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankflow.llm.tiles import compare, lay_tiles
from rankflow.scratch import stage

NEIGHBOURS = 20
TABLES = 4
PROBE_SHARE = 0.25
ROUNDS = 3
SEED = 11
#: Rows of a batch of queries that are spread over their buckets at once.
SPREAD = 256
#: Rounding of a product by blocks, relative to the lengths of both vectors.
SLACK = 1e-12

_KEY = ["dims", "turn", "band", "bucket"]
_COLUMNS = ["rep", "first", "embedding"]


# --- hashing ---------------------------------------------------------------------------


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, step = rows.shape[1], 1
    while step < n:
        pairs = rows.reshape(len(rows), -1, 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]],
                        axis=2).reshape(len(rows), n)
        step *= 2
    return rows / np.sqrt(n)


def lengths(vectors: np.ndarray) -> np.ndarray:
    most = np.abs(vectors).max(axis=1)
    return most * np.sqrt(((vectors / most[:, None]) ** 2).sum(axis=1))


def bands(norms: np.ndarray) -> np.ndarray:
    """Bands of half a power of two, the middle of band 0 at length 1."""
    return np.round(2 * np.log2(norms)).astype(np.int32)


def turned(vectors: np.ndarray, turn: int) -> np.ndarray:
    """Unit vectors under the pseudo-rotation of a table."""
    dims = 1 << (vectors.shape[1] - 1).bit_length()
    rows = np.zeros((len(vectors), dims))
    rows[:, :vectors.shape[1]] = vectors / lengths(vectors)[:, None]
    draw = np.random.default_rng([SEED, turn])
    for _ in range(ROUNDS):
        rows = hadamard(rows * draw.choice([-1.0, 1.0], dims))
    return rows


def axes(rows: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of each row, nearest first: ``2 axis + (negative)``."""
    both = np.stack([rows, -rows], axis=2).reshape(len(rows), -1)
    if probes == 1:
        return np.argmax(both, axis=1)[:, None]
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def probes_of(dims: int, share: float) -> int:
    return max(1, int(np.ceil(share * (2 << (dims - 1).bit_length()))))


# --- tables ----------------------------------------------------------------------------


def _matrix(column, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        dims_of = batch.column("dims").to_numpy()
        for dims in np.unique(dims_of).tolist():
            part = batch.filter(pa.array(dims_of == dims))
            for at in range(0, part.num_rows, SPREAD):
                yield dims, part.slice(at, SPREAD)


def _placed(part: pa.RecordBatch, rows: np.ndarray, dims: int, turn: int, band, bucket) -> pa.RecordBatch:
    went = part.take(pa.array(rows))
    place = [pa.array(np.broadcast_to(x, len(rows)).astype(np.int32)) for x in (dims, turn, band, bucket)]
    return pa.RecordBatch.from_arrays([*place, *[went.column(c) for c in _COLUMNS]],
                                      names=[*_KEY, *_COLUMNS])


def _schema(reps: DataFrame) -> str:
    kind = reps.schema["embedding"].dataType.simpleString()
    return ", ".join(f"{c} int" for c in _KEY) + f", rep bigint, first bigint, embedding {kind}"


def index(reps: DataFrame, tables: int) -> DataFrame:
    """Every distinct vector in its bucket of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, part in _parts(batches):
            vectors = _matrix(part.column("embedding"), dims)
            band, rows = bands(lengths(vectors)), np.arange(len(vectors))
            for turn in range(tables):
                yield _placed(part, rows, dims, turn, band, axes(turned(vectors, turn), 1)[:, 0])

    return reps.select("dims", *_COLUMNS).mapInArrow(run, _schema(reps))


def probes(asked: DataFrame, tables: int, share: float, known: dict[int, list[int]]) -> DataFrame:
    """Every query in the buckets it probes, in each table and band of its dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, part in _parts(batches):
            vectors = _matrix(part.column("embedding"), dims)
            n = probes_of(dims, share)
            rows = np.repeat(np.arange(len(vectors)), n)
            for turn in range(tables):
                near = axes(turned(vectors, turn), n).ravel()
                for band in known.get(dims, []):
                    yield _placed(part, rows, dims, turn, band, near)

    return asked.select("dims", *_COLUMNS).mapInArrow(run, _schema(asked))


def _tile(most: int):
    class Tile:
        """Owners of a bucket's part; each visitor leaves with its ``most`` best of them."""

        def __init__(self, key: tuple, owners: pa.Table):
            self.dims = key[0]
            self.reps, self.firsts = (owners.column(c).to_numpy() for c in ("rep", "first"))
            self.vectors = _matrix(owners.column("embedding"), self.dims)
            self.longest = lengths(self.vectors).max()

        def visit(self, block: pa.RecordBatch) -> pa.RecordBatch:
            asked = block.column("rep").to_numpy()
            vectors = _matrix(block.column("embedding"), self.dims)
            step = max(1, (1 << 20) // len(self.reps))
            found = [self._best(asked[n:n + step], vectors[n:n + step])
                     for n in range(0, len(asked), step)]
            return self._batch(*[np.concatenate(x) for x in zip(*found)])

        def _best(self, asked: np.ndarray, vectors: np.ndarray):
            rough = vectors @ self.vectors.T
            k = min(most, rough.shape[1])
            bar = np.partition(rough, -k, axis=1)[:, -k] - SLACK * self.longest * lengths(vectors)
            i, j = np.nonzero(rough >= bar[:, None])
            # Added up row by row, so that copies of a pair have the same score everywhere.
            score = (vectors[i] * self.vectors[j]).sum(axis=1)
            order = np.lexsort((self.firsts[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            kept = place < most
            return asked[i[kept]], self.reps[j[kept]], self.firsts[j[kept]], score[kept]

        def _batch(self, *columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns],
                                              names=["asked", "rep", "first", "score"])

        def close(self) -> pa.RecordBatch:
            none = np.zeros(0, np.int64)
            return self._batch(none, none, none, np.zeros(0))

    return Tile


def _best_lists(owners: DataFrame, visitors: DataFrame, reps: DataFrame, most: int) -> DataFrame:
    """Per query vector ``asked, found``: its best rows as structs, and how many there are."""
    laid = lay_tiles(owners, visitors, _KEY, "rep")
    pairs = stage(compare(laid, _KEY, _COLUMNS, _tile(most),
                          "asked bigint, rep bigint, first bigint, score double"), "pairs")
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "first")
    best = pairs.distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    rows = best.drop("first", "_n").join(reps.select("rep", "ids"), "rep").select(
        "asked", F.explode("ids").alias("id"), "rep", "score")
    return rows.groupBy("asked").agg(F.collect_list(F.struct(
        (-F.col("score")).alias("loss"), "id", "rep")).alias("found"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, tables: int = TABLES,
            probe_share: float = PROBE_SHARE, id_col: str = "vec_id",
            embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found of each query.

    ``queries`` are rows of ``vectors``.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.coalesce(
        F.col("id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite)
        & F.exists("embedding", lambda x: x != 0), F.lit(False))

    def read(df: DataFrame) -> DataFrame:
        # -0.0 and 0.0 are the same component.
        flat = F.transform(F.col(embedding).cast("array<double>"), lambda x: x + F.lit(0.0))
        return df.select(F.col(id_col).cast("bigint").alias("id"), flat.alias("embedding")).where(sound)

    most = k + 1  # a query's own row may be among them
    # The smallest ids of each distinct vector; a task hands on that many per vector.
    first = Window.partitionBy("embedding").orderBy("id")
    few = read(vectors).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    reps = stage(few.groupBy("embedding").agg(F.sort_array(F.collect_list("id")).alias("ids"))
                 .withColumns({"rep": F.monotonically_increasing_id(), "first": F.col("ids")[0],
                               "dims": F.size("embedding")}), "vectors")
    rows = stage(read(queries).join(reps.select("embedding", "rep"), "embedding").select(
        "id", "rep"), "queries")
    asked = stage(reps.join(rows.select("rep").distinct(), "rep", "left_semi"), "asked")

    owners = index(reps, tables)
    known: dict[int, list[int]] = {}
    # Lengths of doubles have at most some 4,200 bands.
    for dims, band in owners.select("dims", "band").distinct().collect():
        known.setdefault(dims, []).append(band)
    found = stage(_best_lists(owners, probes(asked, tables, probe_share, known), reps, most), "found")

    # Whoever found too few is compared with everything of its dimensions.
    there = reps.groupBy("dims").agg(F.sum(F.size("ids")).alias("rows"))
    short = stage(asked.join(found, asked["rep"] == found["asked"], "left").join(there, "dims").where(
        F.coalesce(F.size("found"), F.lit(0)) < F.least(F.col("rows"), F.lit(most))).select(
        *asked.columns), "short")
    whole = lambda df: df.select("dims", *[F.lit(0).alias(c) for c in _KEY[1:]], *_COLUMNS)
    if not short.isEmpty():
        late = _best_lists(whole(reps), whole(short), reps, most)
        found = stage(found.join(short, found["asked"] == short["rep"], "left_anti").unionByName(late),
                      "found")

    ordered = F.array_sort("found")
    own = F.array_position(F.transform(ordered, lambda r: (r["id"] == F.col("id")) & (
        r["rep"] == F.col("rep"))), True).cast("int")
    lists = rows.join(found, rows["rep"] == found["asked"]).select(
        "id", ordered.alias("_all"), own.alias("_own"))
    kept = F.when(F.col("_own") > 0, F.concat(
        F.slice("_all", F.lit(1), F.col("_own") - 1),
        F.slice("_all", F.col("_own") + 1, F.size("_all")))).otherwise(F.col("_all"))
    return lists.select("id", F.posexplode(F.slice(kept, 1, k)).alias("_n", "_r")).select(
        F.col("id").alias("query_id"), (F.col("_n") + 1).alias("rank"), F.col("_r.id").alias("vec_id"),
        (-F.col("_r.loss")).alias("score"))
