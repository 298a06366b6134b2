"""Distribution statistics: kurtosis, histograms, group means and intervals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rankflow.functions.scalars import as_column
from rankflow.operators.exact import order_statistics
from rankflow.scratch import hint_broadcast, is_small, join_groups, stage


def min_max(df: DataFrame, value: str | Column, keys: Sequence[str] = ()) -> DataFrame:
    v = as_column(value)
    return df.groupBy(*keys).agg(F.min(v).alias("min_value"), F.max(v).alias("max_value"))


def kurtosis(value: str | Column) -> Column:
    """Aggregate: bias-corrected excess kurtosis; NULL below four values."""
    v = as_column(value)
    n = F.count(v).cast("double")
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(v) + 6)
    return F.when(F.count(v) > 3, corrected)


def group_mean(df: DataFrame, keys: Sequence[str], columns: Sequence[str],
               places: int | None = None) -> DataFrame:
    """Mean of the columns per group, half-even rounded if asked."""
    means = {c: F.avg(c) for c in columns}
    if places is not None:
        means = {c: F.bround(m, places) for c, m in means.items()}
    return df.groupBy(*keys).agg(*[m.alias(c) for c, m in means.items()])


def ci95(c: str | Column) -> Column:
    """Aggregate: half width of the 95 % interval of a mean (population deviation)."""
    c = as_column(c)
    return F.stddev_pop(c) * F.lit(1.96) / F.sqrt(F.count(c))


def ci95_guarded(c: str | Column) -> Column:
    """As ``ci95``, and exactly 0 for a group with one distinct value."""
    c = as_column(c)
    return F.when(F.min(c) == F.max(c), F.lit(0.0)).otherwise(ci95(c))


def group_ci95(df: DataFrame, keys: Sequence[str], columns: Sequence[str],
               guarded: bool = False) -> DataFrame:
    width = ci95_guarded if guarded else ci95
    return df.groupBy(*keys).agg(*[width(c).alias(c) for c in columns])


def sum_count_by(df: DataFrame, keys: Sequence[str], column: str,
                 divisor: float = 1000.0) -> DataFrame:
    """Total of a time column over ``divisor`` and the number of operations."""
    return df.groupBy(*keys).agg(
        (F.sum(column) / F.lit(divisor)).alias("total"), F.count(column).alias("ops")
    )


def pivot_total(totals: DataFrame, keys: Sequence[str], pivot: str,
                names: Sequence[str]) -> DataFrame:
    """One column per name out of a ``sum_count_by`` result."""
    return totals.groupBy(*keys).pivot(pivot, list(names)).agg(F.max("total"))


def value_histogram(df: DataFrame, value: str | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Share of rows per value rounded half-even to a whole number."""
    v = F.bround(as_column(value), 0).cast("double")
    counts = (
        df.where(as_column(value).isNotNull()).select(*keys, v.alias("value"))
        .groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 0)
    )
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    return join_groups(counts, totals, keys).select(
        *keys, "value", (F.col("_n") / F.col("_total")).alias("share")
    )


def auto_bins(df: DataFrame, value: str | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Automatic bins per group: ``keys, n, lo, hi, bins``.

    The width is the smaller of the Freedman-Diaconis and the Sturges width, the
    quartiles are exact and interpolated between neighbouring values.
    """
    def at(p: float, step: int):
        return lambda n: F.least(n, F.floor((n - 1) * F.lit(p)) + F.lit(1 + step)).cast("bigint")

    ranks = {"_a0": at(.25, 0), "_a1": at(.25, 1), "_b0": at(.75, 0), "_b1": at(.75, 1),
             "lo": lambda n: F.lit(1).cast("bigint"), "hi": lambda n: n.cast("bigint")}
    s = order_statistics(df, value, keys, ranks)

    def quartile(low: str, high: str, p: float) -> Column:
        pos = (F.col("n") - 1) * F.lit(p)
        return F.col(low) + (F.col(high) - F.col(low)) * (pos - F.floor(pos))

    iqr = quartile("_b0", "_b1", .75) - quartile("_a0", "_a1", .25)
    span = F.col("hi") - F.col("lo")
    n = F.col("n").cast("double")
    fd = F.lit(2.0) * iqr / F.pow(n, F.lit(1 / 3))
    sturges = span / (F.log2(n) + F.lit(1.0))
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    bins = F.when(span > 0, F.ceil(span / width)).otherwise(F.lit(1)).cast("bigint")
    return s.select(*keys, "n", "lo", "hi", bins.alias("bins"))


def fixed_bins(df: DataFrame, value: str | Column, bins: int,
               keys: Sequence[str] = ()) -> DataFrame:
    v = as_column(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")
    ).withColumn("bins", F.lit(bins).cast("bigint"))


def width_bins(df: DataFrame, value: str | Column, width: float = 1.0,
               keys: Sequence[str] = ()) -> DataFrame:
    """Bins of one width that start at the minimum and cover the maximum."""
    s = fixed_bins(df, value, 1, keys)
    count = F.greatest(F.lit(1), F.floor((F.col("hi") - F.col("lo")) / F.lit(width)) + 1)
    return s.withColumn("bins", count.cast("bigint")).withColumn(
        "hi", F.col("lo") + F.col("bins") * F.lit(width)
    )


def binned_histogram(df: DataFrame, value: str | Column, bins: DataFrame,
                     keys: Sequence[str] = ()) -> DataFrame:
    """Share of rows per non-empty bin: ``keys, bin, bin_start, share``.

    ``bins`` comes from ``auto_bins``, ``fixed_bins`` or ``width_bins``.  The last
    bin includes its upper end.
    """
    bins = stage(bins, "bins")
    rows = df.select(*keys, as_column(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull()
    )
    joined = join_groups(rows, hint_broadcast(bins, is_small(bins)), keys)
    span = F.col("hi") - F.col("lo")
    raw = F.floor((F.col("_v") - F.col("lo")) / span * F.col("bins"))
    bin_no = F.when(span > 0, F.least(raw, F.col("bins") - 1)).otherwise(F.lit(0))
    counts = joined.select(
        *keys, "n", "lo", "hi", "bins", bin_no.cast("bigint").alias("bin")
    ).groupBy(*keys, "n", "lo", "hi", "bins", "bin").agg(F.count(F.lit(1)).alias("_c"))
    start = F.col("lo") + F.col("bin") * span / F.col("bins")
    return counts.select(*keys, "bin", start.alias("bin_start"),
                         (F.col("_c") / F.col("n")).alias("share"))


#: Values that a task counts at a time.
TOP_COUNTERS = 10_000


def frequency_summaries(df: DataFrame, value: str | Column, counters: int = TOP_COUNTERS) -> DataFrame:
    """Misra-Gries summaries of each task: ``value, n``, and rows ``NULL, cut`` in ``cut``.

    A task keeps counts of at most ``counters`` values (four times as many between two cuts).  A cut
    takes the count of the first value that has no place from all; what all cuts of a task took is
    one row.  The counts of a value add up over tasks to between its number of rows less all
    cuts, and its number of rows.
    """
    v = as_column(value)
    plain = df.select(v.alias("value"))
    kind = plain.schema["value"].dataType
    if kind.typeName() in ("double", "float"):
        # One zero and one NaN, as in grouping.
        plain = plain.select(F.when(F.isnan("value"), F.lit(float("nan")).cast(kind)).otherwise(
            F.col("value") + F.lit(0).cast(kind)).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, taken = None, 0

        def counted(table: pa.Table) -> pa.Table:
            return table.group_by("value").aggregate([("n", "sum")]).rename_columns(["value", "n"])

        def cut(table: pa.Table) -> tuple[pa.Table, int]:
            n = table.column("n").to_numpy()
            if len(n) <= counters:
                return table, 0
            bar = int(np.partition(n, len(n) - counters - 1)[len(n) - counters - 1])
            left = table.filter(pa.array(n > bar))
            return pa.table({"value": left.column("value"),
                             "n": pa.array(left.column("n").to_numpy() - bar)}), bar

        for batch in batches:
            ones = pa.table({"value": batch.column("value"),
                             "n": pa.array(np.ones(batch.num_rows, dtype=np.int64))})
            fresh = counted(ones)
            held = fresh if held is None else counted(pa.concat_tables([held, fresh]))
            if held.num_rows > 4 * counters:
                held, bar = cut(held)
                taken += bar
        if held is None:
            return
        held, bar = cut(held)
        for batch in held.combine_chunks().to_batches():
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.nulls(batch.num_rows, pa.int64())], names=["value", "n", "cut"])
        if taken + bar:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, held.schema.field("value").type), pa.nulls(1, pa.int64()),
                 pa.array([taken + bar], pa.int64())], names=["value", "n", "cut"])

    return plain.mapInArrow(run, StructType([
        plain.schema["value"], StructField("n", LongType()), StructField("cut", LongType())]))


def top_values(df: DataFrame, value: str | Column, k: int = 10,
               counters: int = TOP_COUNTERS) -> DataFrame:
    """The ``k`` most frequent values; ties go to the lower value.

    Tasks send summaries of bounded size instead of all their distinct values.  If no summary was cut,
    they are the counts.  Else the values that may be among the first ``k`` are counted in a second
    scan; a value that is not among them has at most as many rows as all cuts took, or fewer than
    ``k`` others.  Only where the cuts took as much as the last of the ``k`` has, all
    values are counted.
    """
    summed = stage(frequency_summaries(df, value, counters), "summaries")
    taken = summed.agg(F.coalesce(F.sum("cut"), F.lit(0))).first()[0]
    estimates = summed.where("cut IS NULL").groupBy("value").agg(F.sum("n").alias("n"))
    order = (F.desc("n"), F.asc("value"))
    if not taken:
        return estimates.orderBy(*order).limit(k)
    rows = df.select(as_column(value).alias("value"))
    bar = estimates.orderBy(F.desc("n")).limit(k).agg(F.min("n")).first()[0] or 0
    likely = stage(estimates.where(F.col("n") + taken >= bar).select(F.col("value").alias("_value")),
                   "candidates")
    counts = rows.join(hint_broadcast(likely, is_small(likely)),
                       F.col("value").eqNullSafe(F.col("_value"))).groupBy("value").agg(
        F.count(F.lit(1)).alias("n"))
    first = stage(counts.orderBy(*order).limit(k), "top")
    found, least = first.agg(F.count(F.lit(1)), F.min("n")).first()
    if found == k and least > taken:
        return first.orderBy(*order)
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(*order).limit(k)


def top_total(df: DataFrame, value: str | Column, k: int = 10) -> DataFrame:
    """How many rows the ``k`` most frequent values cover."""
    return top_values(df, value, k).agg(F.sum("n").alias("n"))

