"""The quantile methods behind one interface: build, merge, query.

``partials`` is the part that also runs on a stream, which then keeps a few partial
results per window; ``finish`` turns those into sketches on a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.functions.scalars import QUANTILES, as_column, quantile_columns
from rankflow.operators import buckets, exact, kll, moments, req
from rankflow.scratch import stage


@dataclass(frozen=True)
class Method:
    """One quantile method; all callables take DataFrames and key columns."""

    name: str
    build: Callable[..., DataFrame]  # (df, value, keys) -> sketch rows
    merge: Callable[..., DataFrame]  # (sketch rows, keys) -> sketch rows
    quantiles: Callable[..., DataFrame]  # (sketch rows, keys, ps) -> wide rows
    partials: Callable[..., DataFrame]  # (df, value, keys) -> partial rows
    finish: Callable[..., DataFrame]  # (partial results, keys) -> sketch rows

    def run(self, df: DataFrame, value, keys: Sequence[str] = (),
            ps: Sequence[float] = QUANTILES) -> DataFrame:
        """Build and query in one go."""
        return self.quantiles(self.build(df, value, keys), keys, ps)


def _as_is(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows


def method(name: str, log: bool = False, **params) -> Method:
    """Look a method up; ``params`` override its published parameters.

    ``log`` turns on the log transform, which only the moments sketch uses.
    """
    if name == "dds":
        return Method(
            name, partial(buckets.dds_build, **params), buckets.dds_merge,
            partial(buckets.dds_quantiles, **params),
            partial(buckets.dds_build, **params), _as_is,
        )
    if name == "ddsc":
        fold = {k: v for k, v in params.items() if k == "max_buckets"}
        accuracy = {k: v for k, v in params.items() if k == "alpha"}
        return Method(
            name, partial(buckets.ddsc_build, **params), partial(buckets.ddsc_merge, **fold),
            partial(buckets.ddsc_quantiles, **accuracy),
            partial(buckets.dds_build, **accuracy), partial(buckets.ddsc_fold, **fold),
        )
    if name == "udds":
        store = {k: v for k, v in params.items() if k == "max_buckets"}
        accuracy = {k: v for k, v in params.items() if k in ("alpha", "collapses")}
        return Method(
            name, partial(buckets.udds_build, **params), partial(buckets.udds_merge, **store),
            partial(buckets.udds_quantiles, **accuracy),
            partial(buckets.udds_partials, **params), buckets.finish_states,
        )
    if name == "moments":
        size = {k: v for k, v in params.items() if k == "k"}
        return Method(
            name, partial(moments.moments_build, log=log, **params),
            partial(moments.moments_merge, **size),
            partial(moments.moments_quantiles, log=log, **params),
            partial(moments.moments_build, log=log, **params), _as_is,
        )
    if name == "kll":
        return Method(
            name, partial(kll.kll_build, **params), partial(kll.kll_merge, **params),
            kll.kll_quantiles, partial(kll.kll_counts, **params), _as_is,
        )
    if name == "req":
        return Method(
            name, partial(req.req_build, **params), req.req_merge, req.req_quantiles,
            partial(req.req_partials, **params), req.req_merge,
        )
    if name == "exact":
        return Method(
            name, exact.value_counts,
            lambda rows, keys: rows.groupBy(*keys, "value").agg({"n": "sum"})
            .withColumnRenamed("sum(n)", "n"),
            exact.count_quantiles, exact.value_counts, _as_is,
        )
    raise ValueError(f"unknown method {name!r}")


def shared_sketches(df: DataFrame, value, names: Sequence[str], keys: Sequence[str] = (),
                    log: bool = False) -> dict[str, DataFrame]:
    """Sketch rows of several methods with their published parameters.

    The two DDSketches share one count of buckets, and moments and KLL one aggregation,
    so six methods read the input four times.
    """
    keys, made = list(keys), {}
    if "dds" in names or "ddsc" in names:
        counts = buckets.dds_build(df, value, keys)
        made["dds"], made["ddsc"] = counts, buckets.ddsc_fold(counts, keys)
    if "moments" in names and "kll" in names:
        rows = df.where(as_column(value).isNotNull()).select(
            *keys, moments.usable(value, log).alias("_z"), kll.usable(value).alias("_v"),
            F.pmod(F.spark_partition_id(), F.lit(kll.SHARES)).alias("_share"))
        parts = rows.groupBy(*keys, "_share").agg(*moments.power_sums("_z"), kll.sketch_of("_v"))
        both = stage(parts.groupBy(*keys).agg(*moments.merged_sums(), kll.merged_sketch()), "sketches")
        made["moments"], made["kll"] = both.drop("sketch"), both.select(*keys, "sketch")
    for name in names:
        if name not in made:
            made[name] = method(name, log and name == "moments").build(df, value, keys)
    return {name: made[name] for name in names}


def run_methods(df: DataFrame, value, names: Sequence[str], keys: Sequence[str] = (),
                ps: Sequence[float] = QUANTILES, log: bool = False) -> DataFrame:
    """``algo, keys, n, pct_..`` of several methods."""
    parts = []
    for name, sketch in shared_sketches(df, value, names, keys, log).items():
        wide = method(name, log and name == "moments").quantiles(sketch, keys, ps)
        parts.append(wide.select(F.lit(name).alias("algo"), *keys, "n", *quantile_columns(ps)))
    return reduce(DataFrame.unionByName, parts)


#: The six sketches, in the order of the reports.
SKETCHES = ("moments", "dds", "ddsc", "kll", "req", "udds")
METHODS = (*SKETCHES, "exact")
