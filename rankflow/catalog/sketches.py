"""Exact quantiles and the six sketches: build, merge, query."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankflow.catalog.base import (
    EVENT_WINDOWS,
    REP,
    add,
    events,
    query,
    rounded,
    sql_buckets,
    sql_dds,
    sql_ddsc,
    sql_exact,
    sql_fold,
    sql_udds,
    sql_uniform,
    sql_within,
    table,
)
from rankflow.functions.scalars import quantile_columns, window_id
from rankflow.operators import buckets, exact, kll, moments, req
from rankflow.plans.evaluate import rank_check
from rankflow.plans.methods import method

FLAG = ["l_returnflag"]
PRIORITY = ["o_orderpriority"]
LINE = "SELECT * FROM lineitem"
ORDERS = "SELECT * FROM orders"
FOLDED = 64


# --- exact -----------------------------------------------------------------------


@query("exact_quantiles_by_window", sql_exact(EVENT_WINDOWS, "value", "window_id"))
def _(spark, sf):
    df = events(spark, sf).withColumn("window_id", window_id("ts", 86_400))
    return exact.exact_quantiles(df, "value", ["window_id"])


@query("exact_quantiles", sql_exact(ORDERS, "o_totalprice", "o_orderpriority"))
def _(spark, sf):
    return exact.exact_quantiles(table(spark, sf, "orders"), "o_totalprice", PRIORITY)


@query("exact_quantiles_large", sql_exact(LINE, "l_extendedprice", "l_returnflag"))
def _(spark, sf):
    return exact.exact_quantiles_large(table(spark, sf, "lineitem"), "l_extendedprice", FLAG)


@query("exact_quantiles_ties", sql_exact(LINE, "l_quantity", "l_linestatus"))
def _(spark, sf):
    return exact.exact_quantiles_large(table(spark, sf, "lineitem"), "l_quantity",
                                       ["l_linestatus"])


@query("exact_quantiles_signed", sql_exact("SELECT * FROM customer", "c_acctbal", ""))
def _(spark, sf):
    return exact.exact_quantiles_large(table(spark, sf, "customer"), "c_acctbal")


# --- DDSketch ----------------------------------------------------------------------


@query("dds_build", sql_buckets("SELECT * FROM events", "value", "event_type"))
def _(spark, sf):
    return buckets.dds_build(table(spark, sf, "events"), "value", ["event_type"])


@query("dds_quantiles", sql_dds("SELECT * FROM customer", "c_acctbal", "c_mktsegment"))
def _(spark, sf):
    sketch = buckets.dds_build(table(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"])
    return rounded(buckets.dds_quantiles(sketch, ["c_mktsegment"]))


@query("dds_quantiles_zero", sql_dds(LINE, "l_discount", "l_returnflag"))
def _(spark, sf):
    sketch = buckets.dds_build(table(spark, sf, "lineitem"), "l_discount", FLAG)
    return rounded(buckets.dds_quantiles(sketch, FLAG))


@query("dds_minmax", f"""
SELECT c_mktsegment, round(min(rep), 4) AS min_value, round(max(rep), 4) AS max_value FROM (
  SELECT c_mktsegment, CASE WHEN sgn = 0 THEN 0.0 ELSE sgn * {REP} END AS rep
  FROM ({sql_buckets("SELECT * FROM customer", "c_acctbal", "c_mktsegment")}))
GROUP BY c_mktsegment""")
def _(spark, sf):
    sketch = buckets.dds_build(table(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"])
    return rounded(buckets.dds_minmax(sketch, ["c_mktsegment"]), 4, "min_value", "max_value")


@query("dds_merge", sql_buckets(LINE, "l_extendedprice", "l_returnflag"))
def _(spark, sf):
    fine = buckets.dds_build(table(spark, sf, "lineitem"), "l_extendedprice",
                             [*FLAG, "l_linestatus"])
    return buckets.dds_merge(fine.drop("l_linestatus"), FLAG)


# --- DDSketch with a bounded store ----------------------------------------------------


LINE_BUCKETS = sql_buckets(LINE, "l_extendedprice", "l_returnflag")


@query("ddsc_build", sql_fold(LINE_BUCKETS, "l_returnflag", FOLDED))
def _(spark, sf):
    return buckets.ddsc_build(table(spark, sf, "lineitem"), "l_extendedprice", FLAG,
                              max_buckets=FOLDED)


@query("ddsc_merge", sql_fold(LINE_BUCKETS, "l_returnflag", FOLDED))
def _(spark, sf):
    fine = buckets.ddsc_build(table(spark, sf, "lineitem"), "l_extendedprice",
                              [*FLAG, "l_linenumber"], max_buckets=FOLDED)
    return buckets.ddsc_merge(fine.drop("l_linenumber"), FLAG, max_buckets=FOLDED)


@query("ddsc_quantiles", sql_ddsc(LINE, "l_extendedprice", "l_returnflag", FOLDED))
def _(spark, sf):
    m = method("ddsc", max_buckets=FOLDED)
    return rounded(m.run(table(spark, sf, "lineitem"), "l_extendedprice", FLAG))


@query("ddsc_quantiles_signed",
       sql_ddsc("SELECT * FROM customer", "c_acctbal", "c_mktsegment", FOLDED))
def _(spark, sf):
    m = method("ddsc", max_buckets=FOLDED)
    return rounded(m.run(table(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"]))


# --- UDDSketch --------------------------------------------------------------------------


@query("udds_build", sql_uniform(LINE, "l_extendedprice", "l_returnflag"))
def _(spark, sf):
    return buckets.udds_build(table(spark, sf, "lineitem"), "l_extendedprice", FLAG)


@query("udds_collapse", sql_uniform(LINE, "l_extendedprice", "l_linestatus"))
def _(spark, sf):
    counts = buckets.udds_counts(table(spark, sf, "lineitem"), "l_extendedprice",
                                 ["l_linestatus"])
    return buckets.udds_collapse(counts, ["l_linestatus"])


@query("udds_merge", sql_uniform(LINE, "l_extendedprice", "l_returnflag"))
def _(spark, sf):
    fine = buckets.udds_build(table(spark, sf, "lineitem"), "l_extendedprice",
                              [*FLAG, "l_linenumber"])
    return buckets.udds_merge(fine.drop("l_linenumber"), FLAG)


def _udds(df, value, keys):
    wide = rounded(method("udds").run(df, value, keys))
    return wide.withColumn("alpha", F.round("alpha", 9))


@query("udds_quantiles", sql_udds(ORDERS, "o_totalprice", "o_orderpriority"))
def _(spark, sf):
    return _udds(table(spark, sf, "orders"), "o_totalprice", PRIORITY)


@query("udds_quantiles_signed",
       sql_udds("SELECT * FROM customer", "c_acctbal", "c_mktsegment"))
def _(spark, sf):
    return _udds(table(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"])


# --- moments ------------------------------------------------------------------------------


def _power_means(sketch, keys):
    """Roots of the mean powers: comparable numbers of moderate size."""
    cols = [
        F.round(F.pow(F.abs(F.col(c) / F.col("n")), F.lit(1.0 / i)), 6).alias(c)
        for i, c in enumerate(moments.power_columns(), 1)
    ]
    return sketch.select(*keys, "n", F.round("zmin", 6).alias("zmin"),
                         F.round("zmax", 6).alias("zmax"), *cols)


def _sql_powers(src, z, key):
    cols = ", ".join(
        f"round(pow(abs(avg(pow(z, {i}))), 1.0 / {i}), 6) AS {c}"
        for i, c in enumerate(moments.power_columns(), 1)
    )
    return (f"SELECT {key}, count(*) AS n, round(min(z), 6) AS zmin, round(max(z), 6) AS zmax, "
            f"{cols} FROM (SELECT {key}, {z} AS z FROM ({src})) GROUP BY {key}")


@query("moments_build", _sql_powers("SELECT * FROM events", "asinh(value)", "event_type"))
def _(spark, sf):
    sketch = moments.moments_build(table(spark, sf, "events"), "value", ["event_type"])
    return _power_means(sketch, ["event_type"])


@query("moments_build_log",
       _sql_powers(LINE, "asinh(ln(l_extendedprice))", "l_returnflag"))
def _(spark, sf):
    sketch = moments.moments_build(table(spark, sf, "lineitem"), "l_extendedprice", FLAG,
                                   log=True)
    return _power_means(sketch, FLAG)


@query("moments_merge", _sql_powers(LINE, "asinh(l_extendedprice)", "l_returnflag"))
def _(spark, sf):
    fine = moments.moments_build(table(spark, sf, "lineitem"), "l_extendedprice",
                                 [*FLAG, "l_linenumber"])
    return _power_means(moments.moments_merge(fine, FLAG), FLAG)


def _checked(name, tab, value, keys, bound, merge_key=None, dtype="double", log=False):
    """Rank-checked quantiles of a method, built whole or merged from parts."""

    def fn(spark, sf):
        df = table(spark, sf, tab)
        m = method(name, log)
        if merge_key is None:
            sketch = m.build(df, value, keys)
        else:
            sketch = m.merge(m.build(df, value, [*keys, merge_key]).drop(merge_key), keys)
        return rank_check(df, value, m.quantiles(sketch, keys), keys, bound, dtype=dtype)

    return fn, sql_within(f"SELECT * FROM {tab}", ", ".join(keys))


def moments_bound(p, n):
    """Two percent, and the sampling noise a smooth density does not follow."""
    return F.lit(0.02) + F.lit(0.5) / F.sqrt(n)


def kll_bound(p, n):
    return F.lit(2 * kll.kll_rank_error())


def req_bound(p, n):
    return F.lit(4 * req.req_rse(req.K, p))


add("moments_quantiles", *_checked("moments", "events", "value", ["event_type"],
                                   moments_bound))
add("moments_quantiles_orders", *_checked("moments", "orders", "o_totalprice", PRIORITY,
                                          moments_bound))
add("moments_quantiles_signed", *_checked("moments", "customer", "c_acctbal",
                                          ["c_mktsegment"], moments_bound))

# --- KLL ------------------------------------------------------------------------------------


@query("kll_build", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    sketch = kll.kll_build(table(spark, sf, "lineitem"), "l_extendedprice", FLAG)
    return sketch.select(*FLAG, kll.kll_n().alias("n"))


add("kll_merge", *_checked("kll", "lineitem", "l_extendedprice", FLAG, kll_bound,
                           "l_linenumber", "float"))
add("kll_quantiles", *_checked("kll", "orders", "o_totalprice", PRIORITY, kll_bound,
                               dtype="float"))


@query("kll_retained", "SELECT o_orderpriority, count(*) AS n, TRUE AS bounded "
                       "FROM orders GROUP BY o_orderpriority")
def _(spark, sf):
    sketch = kll.kll_build(table(spark, sf, "orders"), "o_totalprice", PRIORITY)
    kept = kll.kll_retained()
    bounded = (kept > 0) & (kept <= F.least(kll.kll_n(), F.lit(4 * kll.K)))
    return sketch.select(*PRIORITY, kll.kll_n().alias("n"), bounded.alias("bounded"))


@query("kll_rank_error", f"""
SELECT o_orderpriority, count(*) AS n,
       round({2.296}::DOUBLE / pow(350, 0.9723::DOUBLE), 8) AS epsilon,
       round({2.446}::DOUBLE / pow(350, 0.9433::DOUBLE), 8) AS epsilon_pmf
FROM orders GROUP BY o_orderpriority""")
def _(spark, sf):
    sketch = kll.kll_build(table(spark, sf, "orders"), "o_totalprice", PRIORITY)
    return sketch.select(
        *PRIORITY, kll.kll_n().alias("n"),
        F.round(F.lit(kll.kll_rank_error()), 8).alias("epsilon"),
        F.round(F.lit(kll.kll_rank_error(pmf=True)), 8).alias("epsilon_pmf"),
    )


# --- REQ --------------------------------------------------------------------------------------


@query("req_build", """
SELECT l_returnflag, count(*) AS n, min(l_extendedprice::FLOAT)::DOUBLE AS min_value,
       max(l_extendedprice::FLOAT)::DOUBLE AS max_value
FROM lineitem GROUP BY l_returnflag""")
def _(spark, sf):
    sketch = req.req_build(table(spark, sf, "lineitem"), "l_extendedprice", FLAG)
    return req.req_describe(sketch, FLAG, [0.5]).select(*FLAG, "n", "min_value", "max_value")


add("req_merge", *_checked("req", "lineitem", "l_extendedprice", FLAG, req_bound,
                           "l_linenumber", "float"))
add("req_quantiles", *_checked("req", "orders", "o_totalprice", PRIORITY, req_bound,
                               dtype="float"))


@query("req_retained", "SELECT l_returnflag, count(*) AS n, TRUE AS bounded "
                       "FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    sketch = req.req_build(table(spark, sf, "lineitem"), "l_extendedprice", FLAG)
    got = req.req_describe(sketch, FLAG, [0.5])
    kept = F.col("num_retained")
    bounded = (kept > 0) & (kept <= F.least(F.col("n"), F.lit(40 * req.K * 6)))
    return got.select(*FLAG, "n", bounded.alias("bounded"))


@query("req_rse", """
SELECT l_returnflag, q.quantile::DOUBLE AS quantile, count(*) AS n,
       round(q.quantile + least(0.084::DOUBLE / 30, 0.1306::DOUBLE / 30 * (1 - q.quantile)), 8)
         AS upper_rank
FROM lineitem, (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE),
  (0.75::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (0.98::DOUBLE), (0.99::DOUBLE)) q(quantile)
GROUP BY l_returnflag, q.quantile""")
def _(spark, sf):
    from rankflow.functions.scalars import QUANTILES

    sketch = req.req_build(table(spark, sf, "lineitem"), "l_extendedprice", FLAG)
    sizes = req.req_describe(sketch, FLAG, [0.5]).select(*FLAG, "n")
    return sizes.select(*FLAG, F.inline(F.array(*[
        F.struct(F.lit(p).alias("quantile"), F.col("n"),
                 F.round(F.lit(req.req_upper_rank(req.K, p)), 8).alias("upper_rank"))
        for p in QUANTILES
    ])))


# --- NULLs, and no keys ---------------------------------------------------------------------

# Groups on both sides of the size from which a group is narrowed down, with NULLs in all.
GAPS = ("SELECT l_linenumber, l_extendedprice AS v FROM lineitem WHERE l_partkey % 5 <> 0")


@query("exact_quantiles_nulls", sql_exact(GAPS, "v", "l_linenumber"))
def _(spark, sf):
    v = F.when(F.col("l_partkey") % 5 != 0, F.col("l_extendedprice")).alias("v")
    df = table(spark, sf, "lineitem").select("l_linenumber", v)
    return exact.exact_quantiles(df, "v", ["l_linenumber"])


@query("exact_quantiles_no_values",
       f"SELECT 0::BIGINT AS n, {', '.join(f'NULL::DOUBLE AS {c}' for c in quantile_columns())}")
def _(spark, sf):
    v = F.when(F.col("l_quantity") < 0, F.col("l_extendedprice")).alias("v")
    return exact.exact_quantiles(table(spark, sf, "lineitem").select(v), "v")


@query("udds_merge_all", sql_udds(LINE, "l_extendedprice", ""))
def _(spark, sf):
    fine = buckets.udds_build(table(spark, sf, "lineitem"), "l_extendedprice", ["l_linenumber"])
    wide = buckets.udds_quantiles(buckets.udds_merge(fine.drop("l_linenumber")))
    return rounded(wide.withColumn("alpha", F.round("alpha", 9)))


def _sql_rank_bounds(side: str) -> str:
    to_end, kept = {"high": ("1 - q.quantile", "q.quantile >= 1 - 90.0::DOUBLE / n"),
                    "low": ("q.quantile", "q.quantile <= 90.0::DOUBLE / n")}[side]
    error = (f"CASE WHEN n <= 90 OR {kept} THEN 0.0::DOUBLE "
             f"ELSE least(0.084::DOUBLE / 30, 0.1306::DOUBLE / 30 * ({to_end})) END")
    return f"""
SELECT l_suppkey, '{side}' AS side, q.quantile::DOUBLE AS quantile, n,
       round(q.quantile - {error}, 8) AS lower_rank, round(q.quantile + {error}, 8) AS upper_rank
FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey),
  (VALUES (0.01::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE),
          (0.9999::DOUBLE)) q(quantile)"""


@query("req_rank_bounds", f"{_sql_rank_bounds('high')} UNION ALL {_sql_rank_bounds('low')}")
def _(spark, sf):
    sizes = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    ranks = F.explode(F.array(*[F.lit(p) for p in (.01, .25, .5, .9, .99, .9999)])).alias("quantile")
    sizes = sizes.select("l_suppkey", "n", ranks)
    both = []
    for side in ("high", "low"):
        lower, upper = req.req_rank_bounds(F.col("quantile"), F.col("n"), side=side)
        both.append(sizes.select("l_suppkey", F.lit(side).alias("side"), "quantile", "n",
                                 F.round(lower, 8).alias("lower_rank"),
                                 F.round(upper, 8).alias("upper_rank")))
    return both[0].unionByName(both[1])
