"""Comparing the rows of a tile with one another and with visitors from other tiles.

A tile is a key whose rows (the owners) must be compared with each other and with the
rows that other tiles send (the visitors).  Tiles of over ``OWNERS`` rows are cut into
parts, to each of which its visitors go.  A task reads its rows in order: the owners of
a part, which are held, and then its visitors, which stream past in bounded blocks.
Each pair is compared once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.scratch import stage

#: Most owners of one part, on average.
OWNERS = 2048


def lay_tiles(owners: DataFrame, visitors: DataFrame, key: Sequence[str], row_id: str) -> DataFrame:
    """Owners and visitors with their ``part`` and ``role`` (0 owner, 1 visitor).

    Both have the columns of ``owners``; the key of a visitor is the tile it visits.
    """
    key = list(key)
    counts = owners.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > OWNERS)
    large = stage(counts.select(*key, F.ceil(F.col("_n") / OWNERS).cast("int").alias("_parts")),
                  "tiles")
    parts = F.coalesce("_parts", F.lit(1))
    mine = F.pmod(F.xxhash64(row_id), parts).cast("int")
    owned = owners.join(large, key, "left").withColumn("part", mine)
    # An owner also visits the later parts of its own tile.
    later = owned.where(F.col("part") + 1 < F.col("_parts")).withColumn(
        "part", F.explode(F.sequence(F.col("part") + 1, F.col("_parts") - 1)))
    sent = visitors.join(large, key, "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), parts - 1)))
    role = lambda df, r: df.drop("_parts").withColumn("role", F.lit(r))
    return role(owned, 0).unionByName(role(later, 1)).unionByName(role(sent, 1))


def compare(placed: DataFrame, key: Sequence[str], columns: Sequence[str],
            open_tile: Callable, schema: str) -> DataFrame:
    """Run ``open_tile(key values, owners)`` per part; it returns an object with

    ``visit(visitors)``, which may return a batch of results, and ``close()``, which
    returns one; owners and visitors have ``columns``.  A part without owners is skipped.
    """
    order = [*key, "part"]
    spread = placed.select(*order, "role", *columns).repartition(*order).sortWithinPartitions(
        *order, "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, tile = None, [], None

        for batch in batches:
            if not batch.num_rows:
                continue
            for place, role, block in _runs(batch, order, columns):
                if place != current:
                    if tile is None and held:
                        tile = open_tile(current[:-1], pa.Table.from_batches(held))
                    if tile is not None:
                        yield tile.close()
                    current, held, tile = place, [], None
                if role == 0:
                    held.append(block)
                elif held or tile is not None:
                    if tile is None:
                        tile, held = open_tile(current[:-1], pa.Table.from_batches(held)), []
                    done = tile.visit(block)
                    if done is not None:
                        yield done
        if tile is None and held:
            tile = open_tile(current[:-1], pa.Table.from_batches(held))
        if tile is not None:
            yield tile.close()

    return spread.mapInArrow(run, schema)


def _runs(batch: pa.RecordBatch, order: list[str], columns: Sequence[str]) -> Iterator[tuple]:
    """Stretches of a batch with equal place and role."""
    n = batch.num_rows
    turn = None
    for name in [*order, "role"]:
        col = batch.column(name)
        if n > 1:
            step = pc.not_equal(col[1:], col[:-1])
            turn = step if turn is None else pc.or_(turn, step)
    cuts = [0, *([] if turn is None else (pc.indices_nonzero(turn).to_numpy() + 1).tolist()), n]
    keys = [batch.column(c).to_pylist() for c in order]
    roles = batch.column("role").to_pylist()
    kept = batch.select(list(columns))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield tuple(k[a] for k in keys), roles[a], kept.slice(a, b - a)
