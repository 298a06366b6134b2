"""Registration, table access and SQL fragments shared by the catalogue."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.functions.scalars import QUANTILES, epoch_ms, quantile_column
from rankflow.operators.buckets import gamma, uniform_alpha

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DAY = 86_400
WEEK = 7 * DAY

LN_GAMMA = math.log(gamma(0.01))
LN_GAMMA_0 = math.log(gamma(uniform_alpha()))


def query(name: str, sql: str | None = None):
    """Register a query and the SQL that gives the same rows."""

    def wrap(fn: Query) -> Query:
        add(name, fn, sql)
        return fn

    return wrap


def add(name: str, fn: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = fn
    if sql is not None:
        ORACLES[name] = sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a zoned timestamp and its epoch milliseconds."""
    df = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return df.withColumn("ms", epoch_ms("ts"))


def rounded(df: DataFrame, places: int = 4, *columns: str) -> DataFrame:
    """Round the quantile columns (or the named ones) for comparison."""
    names = columns or [c for c in df.columns if c.startswith("pct_")]
    return df.withColumns({c: F.round(c, places) for c in names})


# --- SQL fragments ---------------------------------------------------------------


def sql_list(keys: str, *rest: str) -> str:
    return ", ".join([k for k in (keys, *rest) if k])


def sql_group(keys: str) -> str:
    return f"GROUP BY {keys}" if keys else ""


def sql_exact(src: str, value: str, keys: str, ps=QUANTILES, places: int = 4) -> str:
    picks = ", ".join(
        f"round(quantile_disc({value}, {p!r}), {places}) AS {quantile_column(p)}" for p in ps
    )
    return f"SELECT {sql_list(keys, 'count(*) AS n')}, {picks} FROM ({src}) {sql_group(keys)}"


def sql_buckets(src: str, value: str, keys: str, ln_gamma: float = LN_GAMMA) -> str:
    """Rows keys, sgn, idx, n."""
    group = sql_list(keys, "sgn", "idx")
    return f"""
SELECT {group}, count(*) AS n FROM (
  SELECT *, CASE WHEN {value} > 0 THEN 1 WHEN {value} < 0 THEN -1 ELSE 0 END AS sgn,
         CASE WHEN {value} = 0 THEN 0
              ELSE ceil(ln(abs({value})) / {ln_gamma!r}::DOUBLE) END::BIGINT AS idx
  FROM ({src})) GROUP BY {group}"""


def sql_fold(buckets: str, keys: str, max_buckets: int) -> str:
    """Fold the lowest buckets of each sign's store."""
    part = sql_list(keys, "sgn")
    group = sql_list(keys, "sgn", "idx")
    return f"""
SELECT {group}, sum(n)::BIGINT AS n FROM (
  SELECT {sql_list(keys, 'sgn')}, n,
         greatest(idx, max(idx) OVER (PARTITION BY {part}) - {max_buckets - 1}) AS idx
  FROM ({buckets})) GROUP BY {group}"""


def sql_uniform(src: str, value: str, keys: str, max_buckets: int = 1024) -> str:
    """Rows keys, level, sgn, idx, n after the fewest sufficient collapses."""
    k = sql_list(keys)
    using = f"USING ({k})" if k else "ON TRUE"
    group = sql_list(keys, "level", "sgn", "idx")
    raw = sql_buckets(src, value, keys, LN_GAMMA_0)
    return f"""
SELECT {group}, sum(n)::BIGINT AS n FROM (
  SELECT {sql_list(keys, 'level', 'sgn')}, ceil(idx / pow(2.0, level))::BIGINT AS idx, n
  FROM ({raw}) JOIN (
    SELECT {sql_list(keys, 'min(l)::INTEGER AS level')} FROM (
      SELECT {sql_list(keys, 'l')},
             count(DISTINCT CASE WHEN sgn <> 0
                   THEN sgn || ':' || ceil(idx / pow(2.0, l))::BIGINT END) AS c
      FROM ({raw}), range(0, 30) t(l) GROUP BY {sql_list(keys, 'l')})
    WHERE c <= {max_buckets} {sql_group(keys)}) {using}) GROUP BY {group}"""


def sql_walk(buckets: str, keys: str, rep: str, extra: str = "", ps=QUANTILES,
             places: int = 4) -> str:
    """Quantiles over bucket rows; ``rep`` is the value of a bucket of sign 1."""
    part = f"PARTITION BY {keys}" if keys else ""
    picks = ", ".join(
        f"round(min(CASE WHEN cum > {p!r}::DOUBLE * (total - 1) THEN rep END), {places})"
        f" AS {quantile_column(p)}" for p in ps
    )
    return f"""
SELECT {sql_list(keys, 'sum(n)::BIGINT AS n')}{extra}, {picks} FROM (
  SELECT *, CASE WHEN sgn = 0 THEN 0.0 ELSE sgn * {rep} END AS rep,
         sum(n) OVER ({part} ORDER BY sgn, sgn * idx) AS cum,
         sum(n) OVER ({part}) AS total
  FROM ({buckets})) {sql_group(keys)}"""


REP = f"2 * exp(idx * {LN_GAMMA!r}::DOUBLE) / (exp({LN_GAMMA!r}::DOUBLE) + 1)"
REP_UNIFORM = (f"2 * exp(idx * {LN_GAMMA_0!r}::DOUBLE * pow(2.0, level))"
               f" / (exp({LN_GAMMA_0!r}::DOUBLE * pow(2.0, level)) + 1)")
ALPHA_UNIFORM = (f"round(tanh({math.atanh(uniform_alpha())!r}::DOUBLE * pow(2.0, max(level))), 9)"
                 " AS alpha")


def sql_dds(src: str, value: str, keys: str, ps=QUANTILES, places: int = 4) -> str:
    return sql_walk(sql_buckets(src, value, keys), keys, REP, "", ps, places)


def sql_ddsc(src: str, value: str, keys: str, max_buckets: int = 1024, ps=QUANTILES,
             places: int = 4) -> str:
    folded = sql_fold(sql_buckets(src, value, keys), keys, max_buckets)
    return sql_walk(folded, keys, REP, "", ps, places)


def sql_udds(src: str, value: str, keys: str, ps=QUANTILES, places: int = 4) -> str:
    extra = f", max(level) AS level, {ALPHA_UNIFORM}"
    return sql_walk(sql_uniform(src, value, keys), keys, REP_UNIFORM, extra, ps, places)


def sql_half_up(expr: str, places: int) -> str:
    """Half-up rounding of the decimal text of a double."""
    return f"round(({expr})::VARCHAR::DECIMAL(38, 18), {places})::DOUBLE"


def sql_bucket_rows(src: str, value: str, keys: str) -> dict[str, str]:
    """The sketch rows of each bucket method at its published parameters."""
    plain = sql_buckets(src, value, keys)
    return {"dds": plain, "ddsc": sql_fold(plain, keys, 1024),
            "udds": sql_uniform(src, value, keys)}


def sql_within(src: str, keys: str, ps=QUANTILES) -> str:
    """One TRUE row per group and quantile, with the group's size."""
    values = ", ".join(f"({p!r})" for p in ps)
    return (f"SELECT {sql_list(keys, 'n', 'q.quantile::DOUBLE AS quantile')}, TRUE AS within "
            f"FROM (SELECT {sql_list(keys, 'count(*) AS n')} FROM ({src}) {sql_group(keys)}), "
            f"(VALUES {values}) q(quantile)")


def sql_hash(id_expr: str, salt: str = "") -> str:
    text = f"({id_expr})::VARCHAR" + (f" || '{salt}'" if salt else "")
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def sql_window(ts: str = "ts", seconds: int = DAY) -> str:
    return f"floor((epoch_us({ts}) // 1000) / {seconds * 1000}.0)::BIGINT"


EVENT_WINDOWS = f"SELECT *, {sql_window()} AS window_id FROM events"
