"""Deterministic random columns: a hash of an id, put through an inverse CDF.

Every value depends on its row's id alone, so the columns need no shuffle, come
out the same on any partitioning and survive task retries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.functions.scalars import as_column


def hash_uniform(id_col: str | Column, salt: str = "") -> Column:
    """Uniform in [0, 1) from the first 32 bits of ``md5(id || salt)``."""
    text = as_column(id_col).cast("string")
    if salt:
        text = F.concat(text, F.lit(salt))
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10)
    return head.cast("double") / F.lit(2.0**32)


def _num(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def gen_uniform(id_col: str | Column, low: float | Column = 0.0, high: float | Column = 1000.0,
                salt: str = "") -> Column:
    return _num(low) + (_num(high) - _num(low)) * hash_uniform(id_col, salt)


def gen_pareto(id_col: str | Column, scale: float | Column = 1.0, shape: float | Column = 1.0,
               salt: str = "") -> Column:
    u = hash_uniform(id_col, salt)
    return _num(scale) * F.pow(F.lit(1.0) - u, F.lit(-1.0) / _num(shape))


def gen_normal(id_col: str | Column, mean: float | Column = 0.0, sd: float | Column = 1.0,
               salt: str = "") -> Column:
    """Box-Muller on two salted uniforms."""
    u1, u2 = hash_uniform(id_col, salt + "a"), hash_uniform(id_col, salt + "b")
    r = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u1))
    return _num(mean) + _num(sd) * r * F.cos(F.lit(2 * math.pi) * u2)


def gen_exponential(id_col: str | Column, mean: float = 150.0, salt: str = "") -> Column:
    """Exponential, cut to whole numbers."""
    u = hash_uniform(id_col, salt)
    return F.floor(F.lit(-float(mean)) * F.ln(F.lit(1.0) - u)).cast("bigint")


def binomial_cdf(trials: int, p: float) -> list[float]:
    """P(X <= i) for i = 0 .. trials."""
    out, total = [], 0.0
    for i in range(trials + 1):
        total += math.comb(trials, i) * p**i * (1 - p) ** (trials - i)
        out.append(total)
    return out


def zipf_cdf(items: int, exponent: float) -> list[float]:
    """P(X <= i) for i = 1 .. items."""
    weights = [i**-exponent for i in range(1, items + 1)]
    out, total = [], 0.0
    for w in weights:
        total += w
        out.append(total / sum(weights))
    return out


def _lookup(u: Column, cdf: list[float], first: int) -> Column:
    """Index of the first entry above ``u``: the number of entries at or below it."""
    steps = F.array(*[F.lit(c) for c in cdf[:-1]])
    return (F.lit(first) + F.size(F.filter(steps, lambda c: c <= u))).cast("bigint")


def gen_binomial(id_col: str | Column, trials: int = 30, p: float = 0.4, salt: str = "") -> Column:
    return _lookup(hash_uniform(id_col, salt), binomial_cdf(trials, p), 0)


def gen_zipf(id_col: str | Column, items: int = 20, exponent: float = 0.6,
             salt: str = "") -> Column:
    return _lookup(hash_uniform(id_col, salt), zipf_cdf(items, exponent), 1)


def block_id(id_col: str | Column, rows: int = 50) -> Column:
    """Number of the block of ``rows`` ids that shares one parameter draw."""
    return F.floor(as_column(id_col) / F.lit(rows)).cast("bigint")


def gen_pareto_drifting(id_col: str | Column, rows: int = 50, mean: float = 1.0,
                        sd: float = 0.05) -> Column:
    """Pareto whose scale and shape are one draw ``s`` per block of ids."""
    s = F.greatest(F.lit(0.01), gen_normal(block_id(id_col, rows), mean, sd, "s"))
    return gen_pareto(id_col, s, s)


def gen_uniform_drifting(id_col: str | Column, rows: int = 50) -> Column:
    """Uniform whose ends are drawn per block: N(100, 25) and N(1000, 100)."""
    block = block_id(id_col, rows)
    low = gen_normal(block, 100.0, 25.0, "lo")
    high = gen_normal(block, 1000.0, 100.0, "hi")
    return gen_uniform(id_col, low, high)


def gen_mixture(first: Column, second: Column, in_first: Column) -> Column:
    """One distribution where ``in_first`` holds, the other elsewhere."""
    return F.when(in_first, first.cast("double")).otherwise(second.cast("double"))


def gen_alternating(sketch_id: str | Column, id_col: str | Column) -> Column:
    """Uniform, binomial or Zipf, by the sketch number modulo three."""
    which = F.pmod(as_column(sketch_id), F.lit(3))
    return (
        F.when(which == 0, gen_uniform(id_col, 1.0, 5000.0))
        .when(which == 1, gen_binomial(id_col, 100, 0.2).cast("double"))
        .otherwise(gen_zipf(id_col, 20, 0.6).cast("double"))
    )


def gen_event_stream(df: DataFrame, id_col: str, base_ms: int, throughput: float,
                     mean_delay_ms: float | None = None) -> DataFrame:
    """Give rows arrival and event times at a rate of ``throughput`` per second.

    At or above 1,000 per second each millisecond takes ``ceil(rate / 1000)``
    ids; below, each id is one millisecond and is kept with chance
    ``rate / 1000``.
    """
    per_ms = throughput / 1000.0
    if per_ms < 1:
        df = df.where(hash_uniform(id_col, "t") < F.lit(per_ms))
    step = max(1, math.ceil(per_ms))
    out = df.withColumn(
        "arrival_ms", (F.lit(base_ms) + F.floor(F.col(id_col) / F.lit(step))).cast("bigint")
    )
    if mean_delay_ms is None:
        return out.withColumn("event_ms", F.col("arrival_ms"))
    return out.withColumn(
        "event_ms", F.col("arrival_ms") - gen_exponential(id_col, mean_delay_ms, "d")
    )
