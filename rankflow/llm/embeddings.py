"""Near copies of embeddings by a pigeonhole over subspaces.

Vectors link if their labels are equal and their cosine is at least ``min_cosine``, that is
if their unit vectors are within a squared distance of ``2 - 2 min_cosine``.  A random
rotation (fixed seed) spreads that distance over the dimensions; the rotated vectors are
cut into ``BLOCKS`` blocks, and each block gets the share of the squared distance that its
dimensions have of all.  Vectors that link are within the budget in at least one block, so
a range join per block finds every link.  The join lays a grid of twice the budget's
radius over the first two coordinates of a block; a vector visits the neighbouring cells
that are within the radius.  The union of the candidates is checked by its exact cosine, in
double precision, and counted in the first block that proposes it.

Vectors that are NULL, empty, zero, or hold NULL or non-finite components, and vectors with
a NULL label, link with nothing; vectors of different lengths do not link.  Exact copies
are one representative with a multiplicity; its pairs are counted, not expanded.  Every row
is a vector of its own, also where its id is repeated or NULL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.graph import components
from rankflow.llm.tiles import compare, lay_tiles
from rankflow.scratch import stage

MIN_COSINE = 0.93
BLOCKS = 8
ROTATION_SEED = 7
#: Rounding in float32 coordinates, added to every budget.
SLACK = 1e-5
#: Linked vectors that a tile counts before it hands the counts on.
HELD = 50_000


_turns: dict[int, np.ndarray] = {}


def rotation(dims: int) -> np.ndarray:
    """An orthogonal matrix, the same wherever it is made; a task makes it once."""
    if dims not in _turns:
        gauss = np.random.default_rng(ROTATION_SEED).standard_normal((dims, dims))
        q, r = np.linalg.qr(gauss)
        _turns[dims] = q * np.sign(np.diag(r))
    return _turns[dims]


def cuts(dims: int, blocks: int) -> list[tuple[int, int]]:
    """Bounds of each block; there are no empty ones."""
    at = np.linspace(0, dims, min(blocks, dims) + 1).round().astype(int)
    return list(zip(at[:-1].tolist(), at[1:].tolist()))


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def rotated(vectors: np.ndarray) -> np.ndarray:
    return (unit(vectors) @ rotation(vectors.shape[1])).astype(np.float32)


def budgets(dims: int, blocks: int, reach: float) -> np.ndarray:
    """Squared distance that each block may use up."""
    return np.array([reach * (b - a) / dims + SLACK for a, b in cuts(dims, blocks)])


def _matrix(column, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _place(reps: DataFrame, blocks: int, reach: float) -> DataFrame:
    """Every representative per block: ``label, dims, block, x, y, role`` and itself."""
    kind = reps.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims_of = batch.column("dims").to_numpy()
            for dims in np.unique(dims_of).tolist():
                part = batch.filter(pa.array(dims_of == dims))
                turned = rotated(_matrix(part.column("embedding"), dims)).astype(np.float64)
                rows = np.arange(len(turned))
                for block, ((a, b), budget) in enumerate(
                        zip(cuts(dims, blocks), budgets(dims, blocks, reach))):
                    radius = float(np.sqrt(budget)) * (1 + 1e-9)
                    at = turned[:, a:b][:, :2] / (2 * radius)
                    if b - a == 1:
                        at = np.column_stack([at, np.zeros(len(at))])
                    home = np.floor(at).astype(np.int64)
                    # The cells ahead in order; those behind send their own visitors.
                    low = (at - home) <= 0.5
                    up = ~low | ((at - home) >= 0.5)
                    all_rows = np.ones(len(at), dtype=bool)
                    steps = [((0, 0), all_rows), ((0, 1), up[:, 1]), ((1, 0), up[:, 0]),
                             ((1, 1), up[:, 0] & up[:, 1]), ((1, -1), up[:, 0] & low[:, 1])]
                    for (dx, dy), go in steps:
                        went = rows[go]
                        if not len(went):
                            continue
                        out = part.take(pa.array(went))
                        yield pa.RecordBatch.from_arrays([
                            out.column("label"), out.column("dims"),
                            pa.array(np.full(len(went), block, dtype=np.int32)),
                            pa.array(home[went, 0] + dx), pa.array(home[went, 1] + dy),
                            pa.array(np.full(len(went), int(dx or dy), dtype=np.int32)),
                            out.column("rep"), out.column("copies"), out.column("embedding"),
                        ], names=["label", "dims", "block", "x", "y", "away", "rep", "copies",
                                  "embedding"])

    label = reps.schema["label"].dataType.simpleString()
    return reps.select("label", "dims", "rep", "copies", "embedding").mapInArrow(
        run, f"label {label}, dims int, block int, x bigint, y bigint, away int, rep bigint,"
             f" copies bigint, embedding {kind}")


def _tile(blocks: int, reach: float, min_cosine: float):
    class Tile:
        def __init__(self, key: tuple, owners: pa.Table):
            _, dims, self.block, _, _ = key
            self.dims, self.cuts = dims, cuts(dims, blocks)
            self.budgets = budgets(dims, blocks, reach)
            self.own = self._load(owners)
            self.up = list(range(len(self.own[0])))
            self._begin()
            self._compare(self.own, own=True)

        def _begin(self) -> None:
            self.count: dict[int, int] = {}
            self.links: list[tuple[int, int]] = []
            # The owner that stands for each vector; a visitor comes only once.
            self.seen = {int(x): n for n, x in enumerate(self.own[0])}

        def _load(self, rows):
            vectors = _matrix(rows.column("embedding"), self.dims)
            return (rows.column("rep").to_numpy(), rows.column("copies").to_numpy(), unit(vectors),
                    rotated(vectors).astype(np.float64))

        def _root(self, i: int) -> int:
            while self.up[i] != i:
                self.up[i] = self.up[self.up[i]]
                i = self.up[i]
            return i

        def _compare(self, others, own: bool) -> None:
            step = max(1, (1 << 20) // len(self.own[0]))
            for at in range(0, len(others[0]), step):
                self._block(tuple(x[at:at + step] for x in others), at if own else None)

        def _block(self, others, at: int | None) -> None:
            ids, copies, units, turned = others
            own_ids, own_copies, own_units, own_turned = self.own
            a, b = self.cuts[self.block]
            p, q = turned[:, a:b], own_turned[:, a:b]
            far = (p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2 * (p @ q.T)
            i, j = np.nonzero(far <= self.budgets[self.block] + SLACK)
            if at is not None:
                i, j = i[i + at < j], j[i + at < j]
            # Checked coordinate by coordinate, so that every task judges a pair alike.
            for n in range(0, len(i), 1 << 16):
                self._verify(i[n:n + (1 << 16)], j[n:n + (1 << 16)], others)

        def _verify(self, i, j, others) -> None:
            ids, copies, units, turned = others
            own_ids, own_copies, own_units, own_turned = self.own
            gap = (turned[i] - own_turned[j]) ** 2
            inside = np.column_stack([gap[:, a:b].sum(axis=1) for a, b in self.cuts]) <= self.budgets
            first = inside[:, self.block] & ~inside[:, :self.block].any(axis=1)
            i, j = i[first], j[first]
            near = (units[i] * own_units[j]).sum(axis=1) >= min_cosine
            for s, t in zip(i[near].tolist(), j[near].tolist()):
                u, v = int(ids[s]), int(own_ids[t])
                self.count[u] = self.count.get(u, 0) + int(own_copies[t])
                self.count[v] = self.count.get(v, 0) + int(copies[s])
                self._span(u, v, t)

        def _span(self, u: int, v: int, t: int) -> None:
            """Keep a link only where it connects something new."""
            known = self.seen.get(u)
            if known is None:
                self.seen[u] = t
                self.links.append((u, v))
                return
            a, b = self._root(known), self._root(t)
            if a != b:
                self.up[a] = b
                self.links.append((u, v))

        def visit(self, block: pa.RecordBatch) -> pa.RecordBatch | None:
            self._compare(self._load(block), own=False)
            return self.close() if len(self.count) > HELD else None

        def close(self) -> pa.RecordBatch:
            u, v = [x for x, _ in self.links], [x for _, x in self.links]
            names, sums = list(self.count), list(self.count.values())
            self._begin()
            return pa.RecordBatch.from_arrays([
                pa.array(u + names, pa.int64()), pa.array(v + [None] * len(names), pa.int64()),
                pa.array([None] * len(u) + sums, pa.int64())], names=["u", "v", "n"])

    return Tile


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", embedding: str = "embedding",
                 label: str = "label", min_cosine: float = MIN_COSINE,
                 blocks: int = BLOCKS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    reach = 2 - 2 * min_cosine
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label).alias("label"),
                          F.col(embedding).alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.coalesce(
        F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite)
        & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.where(sound)
    # The number of a representative is fixed by the table it is written to.
    reps = stage(good.groupBy("label", "embedding").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first")).withColumns({
            "rep": F.monotonically_increasing_id(), "dims": F.size("embedding")}), "vectors")

    placed = _place(reps, blocks, reach)
    key, columns = ["label", "dims", "block", "x", "y"], ["rep", "copies", "embedding"]
    laid = lay_tiles(placed.where("away = 0").drop("away"), placed.where("away = 1").drop("away"),
                     key, "rep")
    found = stage(compare(laid, key, columns, _tile(blocks, reach, min_cosine),
                          "u bigint, v bigint, n bigint"), "found")
    counts = found.where("n IS NOT NULL").groupBy("u").agg(F.sum("n").alias("others"))
    roots = components(found.where("v IS NOT NULL").select("u", "v"))
    least = reps.join(roots, reps["rep"] == roots["node"]).groupBy("root").agg(
        F.min("first").alias("least"))
    named = roots.join(least, "root").select(F.col("node").alias("rep"), "least")
    known = reps.join(counts.withColumnRenamed("u", "rep"), "rep", "left").join(
        named, "rep", "left").select(
        "label", "embedding", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("least", "first").alias("component_id"))
    linked = good.join(known, ["label", "embedding"])
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("bigint").alias("n_links"),
                                      F.col("vec_id").alias("component_id"))
    every = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    return every.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
