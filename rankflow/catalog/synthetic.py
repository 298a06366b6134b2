"""Deterministic random columns over the ids of the given tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rankflow.catalog.base import add, events, query, sql_hash, table
from rankflow.functions import uniform
from rankflow.scratch import new_path
from rankflow.sources.generated import read_event_stream

LINE_ID = "(l_orderkey * 8 + l_linenumber)"


def _column(name, make, sql_value, tab="orders", key="o_orderkey"):
    """One generated column per row of a table."""

    def fn(spark, sf):
        df = table(spark, sf, tab)
        return df.select(F.col(key).cast("bigint").alias("id"), make(key).alias("value"))

    add(name, fn, f"SELECT {key}::BIGINT AS id, {sql_value} AS value FROM {tab}")


def _r4(c):
    return F.round(c, 4)


def sql_normal(id_expr, mean, sd, salt=""):
    u1, u2 = sql_hash(id_expr, salt + "a"), sql_hash(id_expr, salt + "b")
    return f"({mean} + {sd} * sqrt(-2.0 * ln(1.0 - {u1})) * cos({2 * math.pi!r} * {u2}))"


def sql_lookup(u, cdf, first):
    steps = ", ".join(f"{c!r}::DOUBLE" for c in cdf[:-1])
    return f"({first} + len(list_filter([{steps}], lambda c: c <= {u})))::BIGINT"


U = sql_hash("o_orderkey")
BLOCK = "floor(o_orderkey / 50)::BIGINT"
S = f"greatest(0.01::DOUBLE, {sql_normal(BLOCK, 1.0, 0.05, 's')})"

_column("gen_pareto", lambda k: _r4(uniform.gen_pareto(k)), f"round(1.0 / (1.0 - {U}), 4)")
_column("gen_uniform", lambda k: _r4(uniform.gen_uniform(k, 40, 100)),
        f"round(40 + 60 * {U}, 4)")
_column("gen_normal", lambda k: _r4(uniform.gen_normal(k, 100, 25)),
        f"round({sql_normal('o_orderkey', 100, 25)}, 4)")
_column("gen_exponential", lambda k: uniform.gen_exponential(k),
        f"floor(-150.0 * ln(1.0 - {U}))::BIGINT")
_column("gen_binomial", lambda k: uniform.gen_binomial(k),
        sql_lookup(U, uniform.binomial_cdf(30, 0.4), 0))
_column("gen_zipf", lambda k: uniform.gen_zipf(k),
        sql_lookup(U, uniform.zipf_cdf(20, 0.6), 1))
_column("gen_pareto_drifting", lambda k: _r4(uniform.gen_pareto_drifting(k)),
        f"round({S} * pow(1.0 - {U}, -1.0 / {S}), 4)")
LOW, HIGH = sql_normal(BLOCK, 100, 25, "lo"), sql_normal(BLOCK, 1000, 100, "hi")
_column("gen_uniform_drifting", lambda k: _r4(uniform.gen_uniform_drifting(k)),
        f"round({LOW} + ({HIGH} - {LOW}) * {U}, 4)")
_column("gen_mixture", lambda k: _r4(uniform.gen_mixture(
            uniform.gen_binomial(k), uniform.gen_uniform(k, 30, 100),
            F.col("o_orderstatus") == "F")),
        f"""CASE WHEN o_orderstatus = 'F'
            THEN {sql_lookup(U, uniform.binomial_cdf(30, 0.4), 0)}::DOUBLE
            ELSE round(30 + 70 * {U}, 4) END""")
_column("gen_alternating", lambda k: _r4(uniform.gen_alternating("o_custkey", k)),
        f"""CASE o_custkey % 3 WHEN 0 THEN round(1 + 4999 * {U}, 4)
            WHEN 1 THEN {sql_lookup(U, uniform.binomial_cdf(100, 0.2), 0)}::DOUBLE
            ELSE {sql_lookup(U, uniform.zipf_cdf(20, 0.6), 1)}::DOUBLE END""")


@query("gen_event_stream", f"""
SELECT id, arrival_ms, arrival_ms - floor(-150.0 * ln(1.0 - {sql_hash('id', 'd')}))::BIGINT
       AS event_ms
FROM (SELECT {LINE_ID}::BIGINT AS id,
             (1700000000000 + floor({LINE_ID} / 50))::BIGINT AS arrival_ms FROM lineitem)""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(F.expr(LINE_ID).cast("bigint").alias("id"))
    return uniform.gen_event_stream(df, "id", 1_700_000_000_000, 50_000, 150.0)


@query("gen_event_stream_thinned", f"""
SELECT event_id AS id, (1700000000000 + event_id)::BIGINT AS arrival_ms,
       (1700000000000 + event_id)::BIGINT AS event_ms
FROM events WHERE {sql_hash('event_id', 't')} < 0.25""")
def _(spark, sf):
    df = events(spark, sf).select(F.col("event_id").alias("id"))
    return uniform.gen_event_stream(df, "id", 1_700_000_000_000, 250)


# Ids of a streaming source, in two runs over one checkpoint: the second one goes on.
@query("stream_gen_event_stream", f"""
SELECT id, arrival_ms, arrival_ms - floor(-150.0 * ln(1.0 - {sql_hash('id', 'd')}))::BIGINT
       AS event_ms
FROM (SELECT id, (1700000000000 + floor(id / 50))::BIGINT AS arrival_ms
      FROM (SELECT unnest(range(count(*))) AS id FROM orders))""")
def _(spark, sf):
    rows = table(spark, sf, "orders").count()
    out, checkpoint = new_path(spark, "generated"), new_path(spark, "checkpoint")
    for due in (rows // 3, rows):
        stream = read_event_stream(spark, due, 1_700_000_000_000, 50_000, 150.0, ids_per_task=5_000)
        stream.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("id bigint, arrival_ms bigint, event_ms bigint").parquet(out)
