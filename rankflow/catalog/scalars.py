"""Projections, filters, parsing and file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankflow.catalog.base import DAY, add, events, query, sql_half_up, sql_window, table
from rankflow.functions import scalars as sc
from rankflow.operators.exact import exact_quantiles
from rankflow.operators.late import drop_last_partial_window
from rankflow.scratch import new_path
from rankflow.sources import events as ev
from rankflow.sources import files, schemas


def _rows(name, tab, columns, sql_columns, where=""):
    """Row-wise expressions over a whole table."""

    def fn(spark, sf):
        df = events(spark, sf) if tab == "events" else table(spark, sf, tab)
        return df.select(*[c.alias(n) for n, c in columns().items()])

    add(name, fn, f"SELECT {sql_columns} FROM {tab} {where}")


_rows("window_id", "events",
      lambda: {"event_id": F.col("event_id"), "window_id": sc.window_id("ts", DAY)},
      f"event_id, {sql_window()} AS window_id")
_rows("run_id", "events",
      lambda: {"event_id": F.col("event_id"), "run_id": sc.run_id(sc.window_id("ts", 3))},
      f"event_id, substr(({sql_window('ts', 3)})::VARCHAR, 1, 4) AS run_id")
_rows("assign_event_time", "events",
      lambda: {"event_id": F.col("event_id"),
       "event_ms": sc.epoch_ms(sc.event_time(F.col("ms").cast("string")))},
      "event_id, (epoch_us(ts) // 1000) AS event_ms")
_rows("round4", "lineitem",
      lambda: {"l_orderkey": F.col("l_orderkey"), "l_linenumber": F.col("l_linenumber"),
       "price": sc.round4(F.col("l_extendedprice") / F.col("l_quantity"))},
      f"l_orderkey, l_linenumber, {sql_half_up('l_extendedprice / l_quantity', 4)} AS price")
_rows("value_as_double", "events",
      lambda: {"event_id": F.col("event_id"),
       "value": sc.value_as_double(F.col("value").cast("string"))},
      "event_id, value::VARCHAR::DOUBLE AS value")
_rows("value_as_float", "events",
      lambda: {"event_id": F.col("event_id"),
       "value": F.round(sc.value_as_float(F.col("value").cast("string")).cast("double"), 6)},
      "event_id, round(value::FLOAT::DOUBLE, 6) AS value")
_rows("log_transform", "orders",
      lambda: {"o_orderkey": F.col("o_orderkey"),
       "logged": F.round(sc.log_transform("o_totalprice"), 9),
       "back": F.round(sc.exp_back(sc.log_transform("o_totalprice")), 2)},
      "o_orderkey, round(ln(o_totalprice), 9) AS logged, round(exp(ln(o_totalprice)), 2) AS back")
_rows("arcsinh_compress", "customer",
      lambda: {"c_custkey": F.col("c_custkey"), "z": F.round(sc.arcsinh_compress("c_acctbal"), 6),
       "back": F.round(F.sinh(sc.arcsinh_compress("c_acctbal")), 2)},
      "c_custkey, round(asinh(c_acctbal), 6) AS z, round(sinh(asinh(c_acctbal)), 2) AS back")
_rows("relative_error", "lineitem",
      lambda: {"l_orderkey": F.col("l_orderkey"), "l_linenumber": F.col("l_linenumber"),
       "error": F.round(sc.relative_error("l_tax", "l_discount"), 6)},
      "l_orderkey, l_linenumber, round(abs(l_tax - l_discount) / nullif(l_discount, 0), 6) "
      "AS error")
_rows("to_millions", "orders",
      lambda: {"o_orderkey": F.col("o_orderkey"),
       "millions": sc.to_millions(F.col("o_totalprice") * 100)},
      "o_orderkey, floor(o_totalprice * 100 / 1000000)::BIGINT AS millions")
_rows("quantile_band", "lineitem",
      lambda: {"l_orderkey": F.col("l_orderkey"), "l_linenumber": F.col("l_linenumber"),
       "band": sc.quantile_band(F.col("l_quantity") / 100)},
      "l_orderkey, l_linenumber, CASE WHEN l_quantity / 100 = 0.5 THEN 1 ELSE 0 END AS band")
_rows("tick_label", "part",
      lambda: {"p_partkey": F.col("p_partkey"), "label": sc.tick_label("p_size", "p_brand")},
      "p_partkey, p_size::VARCHAR || chr(10) || '(' || p_brand || ')' AS label")
_rows("project", "lineitem",
      lambda: {c: F.col(c) for c in ("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")},
      "l_orderkey, l_linenumber, l_extendedprice, l_returnflag")


@query("per_item_time", f"""
SELECT l_orderkey, l_linenumber,
       {sql_half_up("l_extendedprice / l_quantity", 6)} AS l_extendedprice,
       {sql_half_up("l_tax / l_quantity", 6)} AS l_tax FROM lineitem""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice",
                                             "l_tax", "l_quantity")
    columns = ["l_extendedprice", "l_tax"]
    timed = sc.per_item_time(df, columns, "l_quantity").drop("l_quantity")
    return timed.withColumns({c: F.round(c, 6) for c in columns})


@query("missing_pct", """
SELECT o_custkey, round(count(*) FILTER (o_orderstatus = 'F') * 100.0::DOUBLE / count(*), 6)
       AS missing_pct FROM orders GROUP BY o_custkey
HAVING count(*) FILTER (o_orderstatus = 'F') > 0""")
def _(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("slack_events"),
        F.count(F.lit(1)).alias("win_size"),
    )
    shares = counts.select("o_custkey", F.round(sc.missing_pct("slack_events", "win_size"), 6)
                           .alias("missing_pct"))
    return sc.filter_missing(shares)


@query("filter_extreme_quantiles", """
SELECT l_orderkey, l_linenumber, l_discount AS quantile FROM lineitem
WHERE l_discount NOT IN (0.01::DOUBLE, 0.99::DOUBLE)""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber",
                                             F.col("l_discount").alias("quantile"))
    return sc.filter_extreme_quantiles(df)


@query("drop_last_partial_window", """
SELECT run_id, window_id, n FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY window_id DESC) AS r,
         count(*) OVER (PARTITION BY run_id) AS windows
  FROM (SELECT event_type AS run_id, floor((epoch_us(ts) // 1000) / 86400000.0)::BIGINT AS window_id,
               count(*) AS n FROM events GROUP BY 1, 2))
WHERE NOT (r = 1 AND windows > 10)""")
def _(spark, sf):
    counts = events(spark, sf).groupBy(
        F.col("event_type").alias("run_id"), sc.window_id("ts", DAY).alias("window_id")
    ).agg(F.count(F.lit(1)).alias("n"))
    return drop_last_partial_window(counts)


# --- JSON --------------------------------------------------------------------------


@query("json_has_key", """
SELECT event_id, json_exists(props, '$.k') AS has_k, json_exists(props, '$.fake') AS has_fake
FROM events""")
def _(spark, sf):
    return events(spark, sf).select(
        "event_id", ev.json_has_key("props", "k").alias("has_k"),
        ev.json_has_key("props", "fake").alias("has_fake"),
    )


@query("to_json_events", """
SELECT '{"value":"' || value::VARCHAR || '","event_time":"' || (epoch_us(ts) // 1000)::VARCHAR || '"}'
       AS value FROM events""")
def _(spark, sf):
    return ev.to_json_events(events(spark, sf), ["value"], "ms").select("value")


@query("parse_value_event", "SELECT (epoch_us(ts) // 1000) AS event_ms, value FROM events")
def _(spark, sf):
    texts = ev.to_json_events(events(spark, sf), ["value"], "ms")
    parsed = ev.parse_value_event(texts, "value")
    return parsed.select(F.col("event_time").cast("bigint").alias("event_ms"),
                         sc.value_as_double("value").alias("value"))


TAXI_SQL = """
SELECT o_orderkey::VARCHAR AS medallion, o_custkey::VARCHAR AS hack_license,
       o_orderstatus AS vendor_id, strftime(o_orderdate, '%Y-%m-%d') AS pickup_datetime,
       o_orderpriority AS payment_type, round(o_totalprice - 2, 2) AS fare_amount,
       0.5::DOUBLE AS surcharge, 0.5::DOUBLE AS mta_tax, 1.0::DOUBLE AS tip_amount,
       0.0::DOUBLE AS tolls_amount, o_totalprice AS total_amount FROM orders"""


def taxi_rides(spark, sf):
    """Orders in the layout of the taxi rides."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("medallion"),
        F.col("o_custkey").cast("string").alias("hack_license"),
        F.col("o_orderstatus").alias("vendor_id"),
        F.date_format(F.col("o_orderdate"), "yyyy-MM-dd").alias("pickup_datetime"),
        F.col("o_orderpriority").alias("payment_type"),
        F.round(F.col("o_totalprice") - 2, 2).alias("fare_amount"),
        F.lit(0.5).alias("surcharge"), F.lit(0.5).alias("mta_tax"),
        F.lit(1.0).alias("tip_amount"), F.lit(0.0).alias("tolls_amount"),
        F.col("o_totalprice").alias("total_amount"), F.col("o_orderdate"),
    )


@query("parse_taxi_event", """
SELECT o_totalprice AS total_amount, o_orderstatus AS vendor_id,
       strftime(o_orderdate, '%Y-%m-%d') AS pickup_datetime, o_orderpriority AS payment_type,
       round(o_totalprice - 2, 2) AS fare_amount, (epoch_us(o_orderdate) // 1000) AS event_ms,
       FALSE AS fake FROM orders""")
def _(spark, sf):
    rides = taxi_rides(spark, sf).withColumn("ms", sc.epoch_ms("o_orderdate"))
    texts = ev.to_json_events(rides, schemas.TAXI_FIELDS, "ms")
    narrow = ev.project_taxi(ev.parse_taxi_event(texts))
    return narrow.select(
        narrow.total_amount.cast("double").alias("total_amount"), "vendor_id",
        "pickup_datetime", "payment_type", narrow.fare_amount.cast("double").alias("fare_amount"),
        narrow.event_time.cast("bigint").alias("event_ms"), "fake",
    )


@query("json_roundtrip", """
SELECT event_id, (epoch_us(ts) // 1000) AS event_ms, value, event_type FROM events""")
def _(spark, sf):
    df = events(spark, sf)
    texts = ev.to_json_events(df, ["event_id", "value", "event_type"], "ms")
    path = new_path(spark, "events-json")
    ev.write_json_events(texts, path)
    back = spark.read.schema(
        "event_id string, value string, event_type string, event_time string").json(path)
    return back.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("event_time").cast("bigint").alias("event_ms"),
        F.col("value").cast("double").alias("value"), "event_type",
    )


# --- files ---------------------------------------------------------------------------


@query("scan_taxi_csv", TAXI_SQL)
def _(spark, sf):
    path = new_path(spark, "taxi-csv")
    files.write_result_table(taxi_rides(spark, sf).drop("o_orderdate"), path)
    return files.scan_taxi_csv(spark, path)


@query("scan_power_csv", """
SELECT strftime(ts, '%d/%m/%Y') AS "Date", strftime(ts, '%H:%M:%S') AS "Time",
       value AS "Global_active_power", 0.1::DOUBLE AS "Global_reactive_power",
       user_id::DOUBLE AS "Voltage", 1.5::DOUBLE AS "Global_intensity",
       0.0::DOUBLE AS "Sub_metering_1", 1.0::DOUBLE AS "Sub_metering_2",
       event_id::DOUBLE AS "Sub_metering_3" FROM events""")
def _(spark, sf):
    e = events(spark, sf)
    rows = e.select(
        F.date_format("ts", "dd/MM/yyyy"), F.date_format("ts", "HH:mm:ss"), "value",
        F.lit(0.1), F.col("user_id").cast("double"), F.lit(1.5), F.lit(0.0), F.lit(1.0),
        F.col("event_id").cast("double"),
    )
    path = new_path(spark, "power-csv")
    rows.toDF(*schemas.POWER_FIELDS).write.option("sep", ";").csv(path)
    return files.scan_power_csv(spark, path)


@query("scan_sample_csv",
       'SELECT event_id AS "index", value AS sampled_val FROM events')
def _(spark, sf):
    path = new_path(spark, "sample-csv")
    files.export_sample(events(spark, sf), "event_id", "value", path)
    return files.scan_sample_csv(spark, path)


@query("scan_op_times", """
SELECT l_orderkey AS "Data Size", l_extendedprice AS "Moments", l_quantity::DOUBLE AS "DDS",
       l_discount AS "KLL", l_tax AS "REQ", l_linenumber::DOUBLE AS "UDDS" FROM lineitem""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("Data Size"), F.col("l_linenumber").alias("UDDS"),
        F.col("l_tax").alias("REQ"), F.col("l_discount").alias("KLL"),
        F.col("l_quantity").alias("DDS"), F.col("l_extendedprice").alias("Moments"),
    )
    path = new_path(spark, "times-csv")
    files.write_result_table(rows, path, header=True)
    return files.scan_op_times(spark, path, "insert")


@query("scan_results", """
SELECT floor((epoch_us(ts) // 1000) / 86400000.0)::BIGINT AS window_id, """ + ", ".join(
    f"round(quantile_disc(value, {p!r}), 4) AS {sc.quantile_column(p)}" for p in sc.QUANTILES
) + """, count(*) AS win_size, 0::BIGINT AS slack_events FROM events GROUP BY 1""")
def _(spark, sf):
    df = events(spark, sf).withColumn("window_id", sc.window_id("ts", DAY))
    wide = exact_quantiles(df, "value", ["window_id"])
    path = new_path(spark, files.result_name("power", "exact"))
    files.write_window_results(wide.select(
        "window_id", *sc.quantile_columns(), F.col("n").alias("win_size"),
        F.lit(0).alias("slack_events")), path)
    return files.scan_results(spark, path, "exact")


@query("row_cap", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem LIMIT 12345")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return files.row_cap(rows, 12_345)


@query("export_sample", "SELECT o_orderkey::BIGINT AS index, o_totalprice::DOUBLE AS sampled_val FROM orders")
def _(spark, sf):
    """Written as a sample file, and scanned again."""
    path = new_path(spark, "sample")
    files.export_sample(table(spark, sf, "orders"), "o_orderkey", "o_totalprice", path)
    return files.scan_sample_csv(spark, path)
