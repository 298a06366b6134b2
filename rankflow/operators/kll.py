"""KLL sketches over 32-bit floats, on Spark's built-in sketch functions.

A sketch table has one row per group: ``keys..., sketch BINARY``.  Ranks are
inclusive (the quantile at ``p`` is the item at rank ``ceil(p * n)`` of the
sketch's estimate).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.functions.scalars import QUANTILES, as_column, quantile_column

K = 350

#: A group's task sketches are first merged in this many shares.
SHARES = 64


def kll_counts(df: DataFrame, value: str | Column, keys: Sequence[str] = (),
               k: int = K) -> DataFrame:
    """One sketch per group in a single aggregation (also on streams)."""
    return _rows(df, value, keys).groupBy(*keys).agg(sketch_of("_v", k))


def kll_build(df: DataFrame, value: str | Column, keys: Sequence[str] = (), k: int = K,
              shares: int = SHARES) -> DataFrame:
    """One sketch per group; only sketches are shuffled.

    With very many input tasks the merge of a hot group is itself large, so it is
    done in two steps: by share of the input tasks, then across the shares.
    """
    shared = _rows(df, value, keys).withColumn(
        "_share", F.pmod(F.spark_partition_id(), F.lit(shares))
    )
    parts = shared.groupBy(*keys, "_share").agg(sketch_of("_v", k))
    return kll_merge(parts, keys, k)


def usable(value: str | Column) -> Column:
    """The 32-bit value that a sketch takes; NULL if it is NULL or NaN."""
    v = as_column(value).cast("float")
    return F.when(v <= F.lit(float("inf")), v)


def _rows(df: DataFrame, value: str | Column, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, usable(value).alias("_v")).where(F.col("_v").isNotNull())


def sketch_of(v: str, k: int = K) -> Column:
    """The aggregate of a sketch over a column of usable values."""
    return F.kll_sketch_agg_float(v, F.lit(k)).alias("sketch")


def merged_sketch(k: int = K) -> Column:
    """The aggregate that merges sketches."""
    return F.kll_merge_agg_float("sketch", F.lit(k)).alias("sketch")


def kll_merge(sketches: DataFrame, keys: Sequence[str] = (), k: int = K) -> DataFrame:
    return sketches.groupBy(*keys).agg(merged_sketch(k))


def kll_n(sketch: str | Column = "sketch") -> Column:
    return F.kll_sketch_get_n_float(sketch)


def kll_retained(sketch: str | Column = "sketch") -> Column:
    """Items the sketch keeps."""
    text = F.kll_sketch_to_string_float(sketch)
    return F.regexp_extract(text, r"Retained Items\s*:\s*(\d+)", 1).cast("bigint")


def kll_size_bytes(sketch: str | Column = "sketch") -> Column:
    return F.octet_length(sketch).cast("bigint")


def kll_quantiles(sketch: DataFrame, keys: Sequence[str] = (),
                  ps: Sequence[float] = QUANTILES) -> DataFrame:
    """``keys, n, num_retained, pct_..`` per group."""
    ranks = F.array(*[F.lit(float(p)) for p in ps])
    got = sketch.where(kll_n() > 0).select(
        *keys, kll_n().alias("n"), kll_retained().alias("num_retained"),
        F.kll_sketch_get_quantile_float("sketch", ranks).alias("_q"),
    )
    picks = [F.col("_q")[i].cast("double").alias(quantile_column(p)) for i, p in enumerate(ps)]
    return got.select(*keys, "n", "num_retained", *picks)


def kll_rank_error(k: int = K, pmf: bool = False) -> float:
    """Normalized rank error of a sketch of size ``k`` at 99 % confidence."""
    # The published fit of the sketch's measured error.
    return 2.446 / k**0.9433 if pmf else 2.296 / k**0.9723


def kll_k_for_error(epsilon: float, pmf: bool = False) -> int:
    """Smallest ``k`` whose rank error is at most ``epsilon``."""
    guess = (2.446 / epsilon) ** (1 / 0.9433) if pmf else (2.296 / epsilon) ** (1 / 0.9723)
    k = max(8, int(guess))
    while kll_rank_error(k, pmf) > epsilon:
        k += 1
    return k
