"""The window query of every data set and method, on tables and on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankflow.catalog.base import (
    DAY,
    EVENT_WINDOWS,
    WEEK,
    add,
    events,
    query,
    rounded,
    sql_dds,
    sql_ddsc,
    sql_exact,
    sql_hash,
    sql_udds,
    sql_window,
    sql_within,
    table,
)
from rankflow.catalog.reports import DELAY_MS, LATE_COUNTS, MARKED
from rankflow.catalog.scalars import taxi_rides
from rankflow.catalog.sketches import kll_bound, moments_bound, req_bound
from rankflow.catalog.synthetic import HIGH, LOW
from rankflow.functions import uniform
from rankflow.functions.scalars import epoch_ms, window_id
from rankflow.operators import late
from rankflow.plans.evaluate import rank_check
from rankflow.plans.methods import SKETCHES
from rankflow.plans.windows import dataset_window_quantiles
from rankflow.scratch import new_path
from rankflow.sources import events as ev
from rankflow.sources import files, schemas
from rankflow.sources.results import ResultTable
from rankflow.streaming import windows as streaming
from rankflow.streaming.arrival import ArrivalWindows

BOUNDS = {"moments": moments_bound, "kll": kll_bound, "req": req_bound}
FLOATS = ("kll", "req")
QUARTER = 91 * DAY


def _taxi(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_totalprice").alias("total_amount"),
                    F.col("o_orderdate").cast("timestamp").alias("ts"))


def _power(spark, sf):
    return events(spark, sf).select(F.col("value").alias("Global_active_power"), "ts")


def _pareto(spark, sf):
    drawn = F.round(uniform.gen_pareto("event_id"), 4)
    return events(spark, sf).select(drawn.alias("pareto_value"), "ts")


def _uniform(spark, sf):
    drawn = F.round(uniform.gen_uniform_drifting("event_id"), 4)
    return events(spark, sf).select(drawn.alias("uniform_value"), "ts")


def _sql_events(value: str) -> str:
    return f"SELECT {value} AS value, {sql_window('ts', WEEK)} AS window_id FROM events"


_EVENT_ID_LOW = LOW.replace("o_orderkey", "event_id")
_EVENT_ID_HIGH = HIGH.replace("o_orderkey", "event_id")

#: Data set -> (rows with its value field and ts, window seconds, the same in SQL).
DATASETS = {
    "taxi": (_taxi, QUARTER, f"SELECT o_totalprice AS value, "
                             f"{sql_window('o_orderdate', QUARTER)} AS window_id FROM orders"),
    "power": (_power, WEEK, _sql_events("value")),
    "pareto": (_pareto, WEEK,
               _sql_events(f"round(1.0 / (1.0 - {sql_hash('event_id')}), 4)")),
    "uniform": (_uniform, WEEK, _sql_events(
        f"round({_EVENT_ID_LOW} + ({_EVENT_ID_HIGH} - {_EVENT_ID_LOW})"
        f" * {sql_hash('event_id')}, 4)")),
}

SQL = {"dds": sql_dds, "ddsc": sql_ddsc, "udds": sql_udds}


def _tidy(wide):
    wide = rounded(wide)
    return wide.withColumn("alpha", F.round("alpha", 9)) if "alpha" in wide.columns else wide


def _window_query(dataset, name):
    rows, seconds, src = DATASETS[dataset]
    if name in SQL:
        def fn(spark, sf):
            return _tidy(dataset_window_quantiles(rows(spark, sf), dataset, name, seconds))

        return fn, SQL[name](src, "value", "window_id")

    def fn(spark, sf):
        df = rows(spark, sf)
        wide = dataset_window_quantiles(df, dataset, name, seconds)
        dtype = "float" if name in FLOATS else "double"
        return rank_check(df.withColumn("window_id", window_id("ts", seconds)),
                          schemas.VALUE_FIELDS[dataset], wide, ["window_id"], BOUNDS[name],
                          dtype=dtype)

    return fn, sql_within(src, "window_id")


for _dataset in DATASETS:
    for _name in SKETCHES:
        add(f"window_{_dataset}_{_name}", *_window_query(_dataset, _name))


# --- streams -----------------------------------------------------------------------------
#
# The rows are written out as JSON lines and read back as a stream.  The last window
# stays open, as no later event moves the watermark past it.


def _closed(src: str) -> str:
    return f"SELECT * FROM ({src}) WHERE window_id < (SELECT max(window_id) FROM ({src}))"


def _run_stream(spark, dataset, name, rows, seconds):
    """Feed rows with a value field and ``ts`` to the stream query of a data set."""
    source, out, checkpoint = (new_path(spark, f"stream-{part}") for part in
                               ("in", "out", "checkpoint"))
    fields = schemas.TAXI_FIELDS if dataset == "taxi" else [schemas.VALUE_FIELDS[dataset]]
    timed = rows.withColumn("ms", epoch_ms("ts"))
    ev.write_json_events(ev.to_json_events(timed, fields, "ms"), source)
    # One state store per input file, within the session's own number.
    files = len(spark.read.text(source).inputFiles())
    stores = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(8, files))
    running = streaming.stream_query(spark, dataset, name, source, out, checkpoint, seconds,
                                     trigger={"availableNow": True}, state_partitions=stores)
    running.awaitTermination()
    return streaming.read_results(spark, out)


def _stream_query(dataset, name, rows, seconds, src):
    if name in BOUNDS:
        def fn(spark, sf):
            df = rows(spark, sf)
            wide = _run_stream(spark, dataset, name, df, seconds)
            dtype = "float" if name in FLOATS else "double"
            return rank_check(df.withColumn("window_id", window_id("ts", seconds)),
                              schemas.VALUE_FIELDS[dataset], wide, ["window_id"], BOUNDS[name],
                              dtype=dtype)

        return fn, sql_within(_closed(src), "window_id")

    def fn(spark, sf):
        return _tidy(_run_stream(spark, dataset, name, rows(spark, sf), seconds))

    sql = {**SQL, "exact": sql_exact}[name]
    return fn, sql(_closed(src), "value", "window_id")


def _daily(spark, sf):
    return events(spark, sf).select(F.col("value").alias("uniform_value"), "ts")


for _name in (*SKETCHES, "exact"):
    add(f"stream_{_name}", *_stream_query("uniform", _name, _daily, DAY, EVENT_WINDOWS))


def _rides(spark, sf):
    return taxi_rides(spark, sf).withColumn("ts", F.col("o_orderdate").cast("timestamp"))


for _dataset, (_rows, _seconds, _src) in DATASETS.items():
    for _name in SKETCHES:
        add(f"stream_{_dataset}_{_name}", *_stream_query(
            _dataset, _name, _rides if _dataset == "taxi" else _rows, _seconds, _src))


# --- streams in order of arrival -----------------------------------------------------------
#
# Events with a delay are fed in three runs over one checkpoint, each with a third of the
# arrivals.  Lateness is counted per event, and the end of the run closes the last window.

ARRIVALS = 3
_IN_TIME = f"SELECT * FROM ({MARKED}) WHERE NOT is_late"


def _delayed_events(spark, sf):
    df = late.with_delay(events(spark, sf), "ms", "event_id", DELAY_MS)
    return df.withColumn("ts", F.timestamp_millis("event_ms"))


def _run_arrivals(spark, sf, name, **more):
    rows = _delayed_events(spark, sf).select("event_id", "value", "event_ms", "ts")
    source, out, checkpoint = (new_path(spark, f"arrivals-{part}") for part in
                               ("in", "out", "checkpoint"))
    query = ArrivalWindows(out, F.col("value").cast("double"), name, "event_id", DAY, **more)
    first, last = rows.agg(F.min("event_id"), F.max("event_id")).first()
    third = F.floor((F.col("event_id") - first) * ARRIVALS / (last - first + 1))
    for n in range(ARRIVALS):
        sent = ev.to_json_events(rows.where(third == n), ["event_id", "value"], "event_ms")
        ev.write_json_events(sent, source)
        fields = F.from_json("value", "event_id string, value string, event_time string").alias("e")
        parsed = ev.read_json_events(spark, source).select(fields).select(
            F.col("e.event_id").cast("bigint").alias("event_id"), "e.value", "e.event_time")
        query.start(ev.assign_event_time(parsed), checkpoint, {"availableNow": True}).awaitTermination()
    query.end_stream(spark)
    return query


@query("stream_late_count", LATE_COUNTS)
def _(spark, sf):
    return _run_arrivals(spark, sf, "dds").counts(spark)


@query("stream_late_drop", f"SELECT event_id, window_id, value FROM ({_IN_TIME})")
def _(spark, sf):
    kept = _run_arrivals(spark, sf, "dds", keep_events=True).events_in_time(spark)
    return kept.select("event_id", "window_id", F.col("value").cast("double").alias("value"))


def _whole_stream(name):
    def fn(spark, sf):
        wide = _run_arrivals(spark, sf, name).results(spark)
        if name not in BOUNDS:
            return _tidy(wide)
        rows = late.late_drop(_delayed_events(spark, sf).withColumn(
            "window_id", window_id("ts", DAY)), "event_id")
        return rank_check(rows, "value", wide, ["window_id"], BOUNDS[name],
                          dtype="float" if name in FLOATS else "double")

    if name in BOUNDS:
        return fn, sql_within(_IN_TIME, "window_id")
    return fn, {**SQL, "exact": sql_exact}[name](_IN_TIME, "value", "window_id")


for _name in (*SKETCHES, "exact"):
    add(f"stream_whole_{_name}", *_whole_stream(_name))


@query("stream_result_table", f"""
SELECT * EXCLUDE (n), n AS win_size FROM ({sql_exact(_closed(EVENT_WINDOWS), 'value', 'window_id')})""")
def _(spark, sf):
    """Lines of one table: a run over half of the days, one over the rest, and a compaction."""
    rows = _daily(spark, sf).withColumn("ms", epoch_ms("ts"))
    source, out, checkpoint = (new_path(spark, f"table-{part}") for part in ("in", "out", "checkpoint"))
    lines = ResultTable(out)
    first, last = rows.agg(F.min("ms"), F.max("ms")).first()
    half = (first + last) // 2
    for due in (F.col("ms") <= half, F.col("ms") > half):
        sent = ev.to_json_events(rows.where(due), ["uniform_value"], "ms")
        ev.write_json_events(sent, source)
        parsed = ev.assign_event_time(ev.parse_value_event(ev.read_json_events(spark, source), "uniform_value"))
        streaming.start_window_query(parsed, "uniform_value", "exact", "", checkpoint, DAY, table=lines,
                                     trigger={"availableNow": True}).awaitTermination()
    lines.compact(spark, schemas.EXACT_RESULTS)
    return files.scan_results(spark, lines.folders(spark), "exact").drop("slack_events")
