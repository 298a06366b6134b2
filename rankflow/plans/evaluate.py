"""Reports that set sketch results against exact ones."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.functions import scalars
from rankflow.functions.scalars import QUANTILES, quantile_column, quantile_columns
from rankflow.operators import kll, moments, req, stats
from rankflow.operators.exact import exact_quantiles
from rankflow.operators.late import drop_last_partial_window
from rankflow.plans.methods import SKETCHES, method, run_methods, shared_sketches
from rankflow.scratch import hint_broadcast, is_small, join_groups, stage

# Which quantiles each accuracy band averages.  0.01 is in none.
MID = (0.05, 0.25, 0.50, 0.75, 0.90)
UPPER = (0.95, 0.98)
TOP = (0.99,)
BANDS = {"Mid": MID, "Upper": UPPER, "0.99": TOP}


def acc_column(p: float) -> str:
    return quantile_column(p) + "_acc"


def accuracy_by_window(approx: DataFrame, real: DataFrame, window: str = "window_id",
                       ps: Sequence[float] = QUANTILES, keys: Sequence[str] = (),
                       run: Column | None = None) -> DataFrame:
    """Join sketch and exact rows on the window (and ``keys``) and add the relative errors.

    Result: ``run_id, window_id, keys, pct_.._acc, win_size`` (``query_time`` and
    ``num_retained`` too where the sketch rows carry them).  ``run`` says which run a
    window belongs to, such as ``run_id(window)``; by default all are one run, 0.
    """
    size = "win_size" if "win_size" in real.columns else "n"
    groups = [window, *keys]
    r = real.select(*groups, F.col(size).cast("bigint").alias("win_size"),
                    *[F.col(c).alias(f"{c}_real") for c in quantile_columns(ps)])
    kept = [c for c in ("query_time", "num_retained") if c in approx.columns]
    joined = join_groups(approx.select(*groups, *quantile_columns(ps), *kept), r, groups)
    errors = [
        scalars.relative_error(quantile_column(p), f"{quantile_column(p)}_real")
        .alias(acc_column(p))
        for p in ps
    ]
    number = F.lit("0") if run is None else run
    return joined.select(number.alias("run_id"), *groups, *errors, *kept, "win_size")


def accuracy_by_run(by_window: DataFrame, ps: Sequence[float] = QUANTILES) -> DataFrame:
    """Mean errors (and sizes, times) per run."""
    columns = [acc_column(p) for p in ps]
    columns += [c for c in ("query_time", "num_retained", "win_size") if c in by_window.columns]
    return stats.group_mean(by_window, ["run_id"], columns)


def row_mean(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns]) / F.lit(float(len(columns)))


def accuracy_bands(by_run: DataFrame) -> DataFrame:
    """Mean error of each band per run: ``run_id, mid, upper, p99``."""
    return by_run.select(
        "run_id",
        row_mean([acc_column(p) for p in MID]).alias("mid"),
        row_mean([acc_column(p) for p in UPPER]).alias("upper"),
        row_mean([acc_column(p) for p in TOP]).alias("p99"),
    )


def accuracy_band_totals(by_run: DataFrame, places: int = 4) -> DataFrame:
    """One row: the mean of the per-quantile means of each band."""
    cols = {p: F.avg(acc_column(p)) for p in (*MID, *UPPER, *TOP)}

    def mean(ps: Sequence[float]) -> Column:
        return F.bround(reduce(lambda a, b: a + b, [cols[p] for p in ps]) / F.lit(float(len(ps))),
                        places)

    return by_run.agg(mean(MID).alias("mid"), mean(UPPER).alias("upper"), mean(TOP).alias("p99"))


def accuracy_overall(by_run: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over runs and all quantiles but 0.01, six places."""
    error = row_mean([acc_column(p) for p in (*MID, *UPPER, *TOP)])
    return by_run.groupBy(*keys).agg(F.bround(F.avg(error), 6).alias("error"))


def accuracy_report(bands: DataFrame) -> DataFrame:
    """Mean and 95 % interval per band and method, in band order.

    ``bands`` has ``algo, run_id, mid, upper, p99``; the result ``band, algo,
    error, ci95`` with the error rounded to four places.
    """
    long = bands.select("algo", F.inline(F.array(
        F.struct(F.lit(1).alias("pos"), F.lit("Mid").alias("band"), F.col("mid").alias("e")),
        F.struct(F.lit(2).alias("pos"), F.lit("Upper").alias("band"), F.col("upper").alias("e")),
        F.struct(F.lit(3).alias("pos"), F.lit("0.99").alias("band"), F.col("p99").alias("e")),
    )))
    return (
        long.groupBy("pos", "band", "algo")
        .agg(F.bround(F.avg("e"), 4).alias("error"), stats.ci95("e").alias("ci95"))
        .orderBy("pos", "algo").select("band", "algo", "error", "ci95")
    )


def collapse_cost(dds: DataFrame, ddsc: DataFrame) -> DataFrame:
    """Per band what the bounded store costs: absolute and percent difference.

    Both sides are one-row results of ``accuracy_band_totals``.
    """
    def long(df: DataFrame, out: str) -> DataFrame:
        return df.select(F.inline(F.array(*[
            F.struct(F.lit(b).alias("band"), F.col(c).alias(out))
            for b, c in (("Mid", "mid"), ("Upper", "upper"), ("0.99", "p99"))
        ])))

    joined = long(dds, "dds").join(long(ddsc, "ddsc"), "band")
    diff = F.abs(F.col("dds") - F.col("ddsc"))
    return joined.select(
        "band", "dds", "ddsc", F.bround(diff, 4).alias("diff"),
        F.bround(diff * F.lit(100.0) / F.nullif("dds", F.lit(0.0)), 4).alias("diff_pct"),
    )


def prepare_results(results: DataFrame, run: Column, window: str = "window_id",
                    num_windows: int | None = None) -> DataFrame:
    """Drop the last, partial window of each run of more than ``num_windows``, if asked.

    Nothing is dropped unless ``num_windows`` is given.
    """
    if num_windows is None:
        return results
    marked = results.withColumn("_run", run)
    return drop_last_partial_window(marked, window, "_run", num_windows).drop("_run")


def evaluate_methods(df: DataFrame, value: str | Column, names: Sequence[str] = SKETCHES,
                     window: str = "window_id", log: bool = False, run: Column | None = None,
                     num_windows: int | None = None) -> DataFrame:
    """Accuracy bands of several methods: ``algo, run_id, mid, upper, p99``.

    ``df`` carries the window id, ``run`` and ``num_windows`` are those of
    ``accuracy_by_window`` and ``prepare_results``.  The exact side is computed once.
    """
    real = stage(exact_quantiles(df, value, [window]), "exact")
    wide = run_methods(df, value, names, [window], log=log)
    approx = stage(wide, "results")
    parts = []
    for name in names:
        own = approx.where(F.col("algo") == name).drop("algo")
        kept = prepare_results(own, F.lit("0") if run is None else run, window, num_windows)
        errors = accuracy_by_window(kept, real, window, run=run)
        parts.append(accuracy_bands(accuracy_by_run(errors)).select(F.lit(name).alias("algo"), "*"))
    return reduce(DataFrame.unionByName, parts)


def long_errors(table: DataFrame, keys: Sequence[str], actual: str, columns: Sequence[str],
                places: int | None = None) -> DataFrame:
    """Turn each method column into its relative error against ``actual``."""
    out = {}
    for c in columns:
        e = F.abs((F.col(c) - F.col(actual)) / F.nullif(actual, F.lit(0.0)))
        out[c] = e if places is None else F.bround(e, places)
    return table.select(*keys, *[e.alias(c) for c, e in out.items()])


def adaptability_report(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Errors at the median and elsewhere after the distribution changed.

    ``table``: ``run_id, quantile, actual`` and one column per method.  Result:
    ``band`` (1 the median, 0 the rest), then mean and interval per method over
    the runs.
    """
    errors = long_errors(
        scalars.filter_extreme_quantiles(table), ["run_id", "quantile"], "actual", columns, 4
    )
    per_quantile = stats.group_mean(errors, ["run_id", "quantile"], columns, 4)
    banded = per_quantile.select(
        "run_id", scalars.quantile_band("quantile").alias("band"), *columns
    )
    per_run = stats.group_mean(banded, ["run_id", "band"], columns, 4)
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(c), stats.ci95(c).alias(f"{c}_ci")]
    return per_run.groupBy("band").agg(*aggs)


def adaptability_table(df: DataFrame, value: str | Column, names: Sequence[str],
                       run: str = "run_id", ps: Sequence[float] = QUANTILES) -> DataFrame:
    """Exact and sketch values at every quantile of each run, one row each."""
    actual = scalars.melt_quantiles(exact_quantiles(df, value, [run], ps), [run], ps, "actual")
    wide = run_methods(df, value, names, [run], ps)
    each = scalars.melt_quantiles(wide, ["algo", run], ps, "value")
    columns = each.groupBy(run, "quantile").agg(
        *[F.max(F.when(F.col("algo") == name, F.col("value"))).alias(name) for name in names])
    return join_groups(actual, columns, [run, "quantile"])


def kurtosis_table(df: DataFrame, dataset: str, value: str, names: Sequence[str],
                   p: float = 0.98, runs: Sequence[str] = ()) -> DataFrame:
    """Per data set and run: kurtosis, the exact quantile and each sketch's."""
    q, keys = quantile_column(p), [dataset, *runs]
    shape = df.groupBy(*keys).agg(F.round(stats.kurtosis(value), 4).alias("kurtosis"))
    actual = exact_quantiles(df, value, keys, [p]).select(*keys, F.col(q).alias("actual"))
    columns = run_methods(df, value, names, keys, [p]).groupBy(*keys).agg(
        *[F.max(F.when(F.col("algo") == name, F.col(q))).alias(name) for name in names])
    return join_groups(join_groups(shape, actual, keys), columns, keys)


def kurtosis_report(table: DataFrame, dataset: str, columns: Sequence[str]) -> DataFrame:
    """Mean error and guarded interval per data set over its runs, by rising kurtosis.

    Kurtosis and the exact value are the means over the runs as well.
    """
    errors = long_errors(table, [dataset, "kurtosis", "actual"], "actual", columns)
    aggs = [F.avg("kurtosis").alias("kurtosis"), F.avg("actual").alias("actual")]
    for c in columns:
        aggs += [F.bround(F.avg(c), 6).alias(c), stats.ci95_guarded(c).alias(f"{c}_ci")]
    ordered = errors.groupBy(dataset).agg(*aggs).orderBy("kurtosis")
    shown = ordered.withColumn("kurtosis", F.bround("kurtosis", 2))
    return shown.withColumn("label", scalars.tick_label("kurtosis", dataset))


def sketch_sizes(df: DataFrame, value: str, keys: Sequence[str],
                 names: Sequence[str] = SKETCHES) -> DataFrame:
    """Bytes of each method's sketch per group: ``keys, algo, bytes``."""
    parts = []
    for name, sketch in shared_sketches(df, value, names, keys).items():
        sized = sketch_size_bytes(sketch, name, keys)
        parts.append(sized.select(*keys, F.lit(name).alias("algo"), "bytes"))
    return reduce(DataFrame.unionByName, parts)


def sketch_size_bytes(sketch: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """``keys, bytes``: 16 per bucket, 8 per moment and extreme, or the blob."""
    if name in ("dds", "ddsc", "udds"):
        return sketch.groupBy(*keys).agg(
            (F.count(F.lit(1)) * 16).cast("bigint").alias("bytes")
        )
    if name == "moments":
        return sketch.select(*keys, F.lit((moments.K + 2) * 8).cast("bigint").alias("bytes"))
    size = kll.kll_size_bytes if name == "kll" else req.req_size_bytes
    return sketch.select(*keys, size("sketch").alias("bytes"))


def merge_report(df: DataFrame, value: str, sketch_id: str, names: Sequence[str],
                 keys: Sequence[str] = (), ps: Sequence[float] = QUANTILES) -> DataFrame:
    """Sketches built per ``sketch_id``, merged, and queried: one row per method
    and group with the number of sketches that went in."""
    parts = []
    for name, built in shared_sketches(df, value, names, [*keys, sketch_id]).items():
        m = method(name)
        merged = m.quantiles(m.merge(built.drop(sketch_id), keys), keys, ps)
        parts.append(merged.select(F.lit(name).alias("algo"), *keys, "n", *quantile_columns(ps)))
    return reduce(DataFrame.unionByName, parts)


def merge_counts_report(df: DataFrame, value: str, sketch_id: str, counts: Sequence[int],
                        names: Sequence[str], ps: Sequence[float] = QUANTILES) -> DataFrame:
    """Quantiles of the first 10, 100, ... of many sketches, merged.

    ``sketch_id`` numbers the sketch of each row from 0 on.  Every sketch is built once and goes into
    each merge that is large enough for it; one row per method and number of sketches.
    """
    inside = F.array(*[F.when(F.col(sketch_id) < m, F.lit(m)) for m in counts])
    into = F.explode(F.array_compact(inside)).alias("num_sketches")
    parts = []
    for name, built in shared_sketches(df.where(F.col(sketch_id) < max(counts)), value, names,
                                       [sketch_id]).items():
        m = method(name)
        used = built.select(into, *[c for c in built.columns if c != sketch_id])
        merged = m.quantiles(m.merge(used, ["num_sketches"]), ["num_sketches"], ps)
        parts.append(merged.select(F.lit(name).alias("algo"), "num_sketches", "n",
                                   *quantile_columns(ps)))
    return reduce(DataFrame.unionByName, parts)


def op_time_report(table: DataFrame, size: str, columns: Sequence[str], kind: str) -> DataFrame:
    """Mean time and interval per size out of a table of single measurements.

    ``insert`` times are per item, ``merge`` times per merge (sketches less one,
    four places), ``query`` times as they are.
    """
    if kind == "insert":
        table = scalars.per_item_time(table, columns, F.col(size))
    elif kind == "merge":
        table = scalars.per_item_time(table, columns, F.col(size) - 1, 4)
    elif kind != "query":
        raise ValueError(f"unknown kind {kind!r}")
    label = F.col(size) if kind == "merge" else scalars.to_millions(size)
    aggs = []
    for c in columns:
        mean = F.bround(F.avg(c), 4) if kind == "query" else F.avg(c)
        aggs += [mean.alias(c), stats.ci95(c).alias(f"{c}_ci")]
    return table.groupBy(label.cast("bigint").alias(size)).agg(*aggs)


def rank_check(df: DataFrame, value: str | Column, wide: DataFrame, keys: Sequence[str],
               bound, ps: Sequence[float] = QUANTILES, dtype: str = "double") -> DataFrame:
    """Whether each sketch quantile lies within ``bound(p, n)`` ranks of ``p``.

    ``keys, quantile, n, within``: the true rank interval of the returned value,
    counted on the data, must come within the bound of ``p`` (plus one row), and
    the sketch must have counted every row.
    """
    wide = stage(wide.select(*keys, F.col("n").alias("_n"), *quantile_columns(ps)), "wide")
    v = scalars.as_column(value).cast(dtype).cast("double")
    rows = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull())
    joined = join_groups(rows, hint_broadcast(wide, is_small(wide)), keys)
    counts = []
    for p in ps:
        q = F.col(quantile_column(p))
        counts += [F.count_if(F.col("_v") < q).alias(f"lt_{quantile_column(p)}"),
                   F.count_if(F.col("_v") <= q).alias(f"le_{quantile_column(p)}")]
    ranked = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("_n").alias("_n"), *counts
    )
    checks = []
    for p in ps:
        slack = bound(p, F.col("n")) + F.lit(1.0) / F.col("n")
        low = F.col(f"lt_{quantile_column(p)}") / F.col("n") - slack
        high = F.col(f"le_{quantile_column(p)}") / F.col("n") + slack
        ok = (F.lit(p) >= low) & (F.lit(p) <= high) & (F.col("n") == F.col("_n"))
        checks.append(F.struct(F.lit(p).alias("quantile"), ok.alias("within")))
    return ranked.select(*keys, "n", F.inline(F.array(*checks)))
