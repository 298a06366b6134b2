"""Exact quantiles: the element at rank ``ceil(p * n)`` of each group, in two scans.

The first scan counts rows in ranges of the logarithm (2 % wide) with the least and the
greatest value of each range, per group.  These counts add up like any sketch: their total is
the size of the group, so no pass for sizes is needed, and their running total tells in which
range each wanted rank lies and at which place in it.  A rank is known at once if it is the
first or the last of its range, or if the range holds one value.  What is left is written as a
small table of ranges.

The second scan reads only rows inside these ranges (the table is broadcast if it is small)
and counts their distinct values, per task first.  Ranges with many rows are cut into 2**20
equal parts, so that no task orders more than the values of one part.  A second scan is not
run if nothing is left.

Groups known to be small may use ``percentile_disc`` instead, which holds a value-to-count map
per group and reads the input once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.functions.scalars import QUANTILES, as_column, quantile_column
from rankflow.scratch import BROADCAST_ROWS, hint_broadcast, join_groups, stage

#: Most rows of a range whose distinct values one task orders.
ONE_TASK = 1 << 20

#: Parts a larger range is cut into.
SLICES = 1 << 20

Rank = Callable[[Column], Column]


def nearest_rank(p: float) -> Rank:
    """1-based rank ``ceil(p * n)``, at least 1."""
    return lambda n: F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * n)).cast("bigint")


def _block(v: Column) -> Column:
    """Coarse block number, non-decreasing in ``v`` over all doubles."""
    step = F.floor(F.ln(F.abs(v)) * F.lit(50.0)).cast("bigint") + F.lit(40_000)
    inf = F.lit(float("inf"))
    return (
        F.when(F.isnan(v), F.lit(200_000))
        .when(v == inf, F.lit(100_000))
        .when(v == -inf, F.lit(-100_000))
        .when(v == 0, F.lit(0))
        .when(v > 0, step)
        .otherwise(-step)
        .cast("bigint")
    )


def _slice(v: Column, lo: Column, hi: Column) -> Column:
    """Equal-width slice of ``[lo, hi]``, non-decreasing in ``v``."""
    return (
        F.when(lo == hi, F.lit(0))
        .otherwise(F.floor((v - lo) / (hi - lo) * F.lit(SLICES)))
        .cast("bigint")
    )


def _locate(counts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Counts with the number of rows before each, per group."""
    group = Window.partitionBy(*keys)
    upto = group.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("_upto", F.sum("_c").over(upto)).withColumn(
        "_before", F.col("_upto") - F.col("_c")
    )


def _inside(counts: DataFrame, ranks: Column) -> DataFrame:
    """Rows with ``_before`` and ``_upto`` that hold one of ``ranks``, and which of their rows
    each of these is (``_ranks``)."""
    here = F.filter(
        ranks, lambda r: (r["rank"] > F.col("_before")) & (r["rank"] <= F.col("_upto")))
    moved = F.transform(here, lambda r: F.struct(
        r["name"].alias("name"), (r["rank"] - F.col("_before")).alias("rank")))
    return counts.withColumn("_ranks", moved).where(F.size("_ranks") > 0)


def rank_ranges(base: DataFrame, keys: Sequence[str], ranks: dict[str, Rank]) -> DataFrame:
    """First scan: the ranges that hold a wanted rank, with their group's size ``_n``.

    Rows ``keys, _n, _block, _c, _lo, _hi, _ranks``, at most one per group and rank.
    """
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("bigint").alias("rank"))
        for name, rank in ranks.items()
    ])
    counts = base.groupBy(*keys, "_block").agg(
        F.sum("_w").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    sized = _locate(counts, keys, "_block").withColumn(
        "_n", F.sum("_c").over(Window.partitionBy(*keys)))
    return _inside(sized, wanted).select(*keys, "_n", "_block", "_c", "_lo", "_hi", "_ranks")


def _read_off() -> Column:
    """The value at a rank of a range, as far as the range's own counts tell."""
    return F.transform("_ranks", lambda r: F.struct(
        r["name"].alias("name"), r["rank"].alias("rank"),
        F.when((r["rank"] == 1) | F.col("_lo").eqNullSafe(F.col("_hi")), F.col("_lo"))
        .when(r["rank"] == F.col("_c"), F.col("_hi")).alias("value")))


def _pick(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, _n, name, value`` out of counted values and the ranks wanted of their part."""
    return _inside(counts, F.col("_ranks")).select(
        *keys, "_n", F.explode("_ranks.name").alias("name"), F.col("_v").alias("value"))


def _second_scan(base: DataFrame, keys: list[str], left: DataFrame) -> DataFrame:
    """``keys, _n, name, value`` of the ranks that the first scan leaves open."""
    rows, most = left.agg(F.count(F.lit(1)), F.max("_c")).first()
    at = [*keys, "_block"]
    bounds = hint_broadcast(left.select(*at, "_lo", "_hi"), rows <= BROADCAST_ROWS)
    open_ranks = hint_broadcast(left.select(*at, "_n", "_ranks"), rows <= BROADCAST_ROWS)
    read = join_groups(base, bounds, at)
    if most is None or most <= ONE_TASK:
        values = read.groupBy(*at, "_v").agg(F.sum("_w").alias("_c"))
        return _pick(join_groups(_locate(values, at, "_v"), open_ranks, at), keys)
    # Both uses of ``values`` share one exchange, so the input is not read again.
    part = [*at, "_slice"]
    values = read.withColumn("_slice", _slice(F.col("_v"), F.col("_lo"), F.col("_hi"))).groupBy(
        *part, "_v").agg(F.sum("_w").alias("_c"))
    parts = _locate(values.groupBy(*part).agg(F.sum("_c").alias("_c")), at, "_slice")
    held = _inside(join_groups(parts, open_ranks, at), F.col("_ranks")).select(
        *part, "_n", "_ranks")
    return _pick(join_groups(_locate(join_groups(values, held.select(*part), part, "left_semi"),
                                     part, "_v"), held, part), keys)


def order_statistics(df: DataFrame, value: str | Column, keys: Sequence[str],
                     ranks: dict[str, Rank], weight: str | None = None) -> DataFrame:
    """The values at the given ranks of each group, as one column per rank.

    ``ranks`` maps a column name to a function from the group size to a 1-based
    rank.  A ``weight`` column says how many rows a row stands for.  The result has
    ``keys, n`` and the rank columns; without keys it is one row, also over nothing.
    NULLs are left out and NaN sorts last.  The first scan runs when this is called.
    """
    keys = list(keys)
    rows = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    base = df.select(
        *keys, as_column(value).cast("double").alias("_v"), rows.alias("_w")
    ).where(F.col("_v").isNotNull()).withColumn("_block", _block(F.col("_v")))
    ranges = stage(rank_ranges(base, keys, ranks).withColumn("_ranks", _read_off()), "ranges")
    answers = ranges.select(*keys, "_n", F.inline("_ranks")).where(
        F.col("value").isNotNull()).select(*keys, "_n", "name", "value")
    left = ranges.withColumn("_ranks", F.transform(
        F.filter("_ranks", lambda r: r["value"].isNull()),
        lambda r: F.struct(r["name"].alias("name"), r["rank"].alias("rank")))).where(
        F.size("_ranks") > 0)
    if not left.isEmpty():
        answers = answers.unionByName(_second_scan(base, keys, left))
    cols = [F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in ranks]
    return answers.groupBy(*keys).agg(F.coalesce(F.max("_n"), F.lit(0)).alias("n"), *cols)


def exact_quantiles_large(df: DataFrame, value: str | Column, keys: Sequence[str] = (),
                          ps: Sequence[float] = QUANTILES, places: int | None = 4) -> DataFrame:
    """Exact quantiles for groups of any size: ``keys, n, pct_..``."""
    wide = order_statistics(df, value, keys, {quantile_column(p): nearest_rank(p) for p in ps})
    return _rounded(wide, keys, ps, places)


def value_counts(df: DataFrame, value: str | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct value: ``keys, value, n`` (one aggregation, also on streams)."""
    return (
        df.select(*keys, as_column(value).cast("double").alias("value"))
        .where(F.col("value").isNotNull()).groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def count_quantiles(counts: DataFrame, keys: Sequence[str] = (),
                    ps: Sequence[float] = QUANTILES, places: int | None = 4) -> DataFrame:
    """Exact quantiles out of ``value_counts`` rows."""
    ranks = {quantile_column(p): nearest_rank(p) for p in ps}
    return _rounded(order_statistics(counts, "value", keys, ranks, "n"), keys, ps, places)


def exact_quantiles_small(df: DataFrame, value: str | Column, keys: Sequence[str] = (),
                          ps: Sequence[float] = QUANTILES, places: int | None = 4) -> DataFrame:
    """Exact quantiles in one aggregation, for groups known to be small."""
    rows = df.select(*keys, as_column(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    array = ", ".join(repr(float(p)) for p in ps)
    wide = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.expr(f"percentile_disc(array({array})) WITHIN GROUP (ORDER BY _v)").alias("_q"),
    )
    picks = [F.col("_q")[i].alias(quantile_column(p)) for i, p in enumerate(ps)]
    return _rounded(wide.select(*keys, "n", *picks), keys, ps, places)


def exact_quantiles(df: DataFrame, value: str | Column, keys: Sequence[str] = (),
                    ps: Sequence[float] = QUANTILES, places: int | None = 4) -> DataFrame:
    """Exact quantiles of groups of any number and any sizes: ``keys, n, pct_..``."""
    return exact_quantiles_large(df, value, keys, ps, places)


def _rounded(wide: DataFrame, keys: Sequence[str], ps: Sequence[float],
             places: int | None) -> DataFrame:
    if places is None:
        return wide
    cols = [F.round(quantile_column(p), places).alias(quantile_column(p)) for p in ps]
    return wide.select(*keys, "n", *cols)
