"""Tumbling event-time windows on streams, one query for every method.

The stream keeps per window only a small aggregate: bucket counts, power sums, a
sketch, or (for exact quantiles) value counts.  When the watermark
passes a window, its rows come out together in one micro-batch, and the rest of
the work (folding, collapsing, the quantiles) is the batch operator on them.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from rankflow.functions.scalars import QUANTILES, as_column, epoch_ms, quantile_column
from rankflow.operators import buckets, req
from rankflow.plans.methods import method
from rankflow.plans.windows import uses_log
from rankflow.sources import events, schemas
from rankflow.sources.results import ResultTable, result_lines

#: Held while a query starts with a setting of its own.
_starting = threading.Lock()

#: Default window length in seconds.
WINDOW_SECONDS = 3

#: States that the tasks of a window are shared out to.
STATE_SHARES = 8

#: Methods whose state no built-in aggregate can hold: how tasks reduce their rows,
#: and how a state is read back.
TASK_STATES = {
    "req": (req.req_partials, req.ReqState.from_bytes),
    "udds": (buckets.udds_partials, buckets.BucketState.from_bytes),
}


def _with_window_id(rows: DataFrame, keys: Sequence[str], seconds: int) -> DataFrame:
    number = F.floor(epoch_ms("window.start") / F.lit(seconds * 1000)).cast("bigint")
    rest = [c for c in rows.columns if c not in ("window", *keys)]
    return rows.select(number.alias("window_id"), *keys, *rest)


def window_partials(stream: DataFrame, value: str | Column, name: str,
                    window_seconds: int = WINDOW_SECONDS, ts: str = "ts",
                    keys: Sequence[str] = (), log: bool = False, delay: str = "0 seconds",
                    **params) -> DataFrame:
    """Partial sketch rows of each closed window (append mode)."""
    keys = list(keys)
    if name in TASK_STATES:
        return _task_states(stream, value, name, window_seconds, ts, keys, delay, **params)
    marked = events.watermark(stream, ts, delay).withColumn(
        "window", F.window(ts, f"{window_seconds} seconds")
    )
    rows = method(name, log, **params).partials(marked, value, ["window", *keys])
    return _with_window_id(rows, keys, window_seconds)


def _task_states(stream: DataFrame, value: str | Column, name: str, seconds: int, ts: str,
                 keys: list[str], delay: str, **params) -> DataFrame:
    """Tasks reduce their rows to states; the state store merges them per window.

    The states carry the window start as event time.  With a tumbling window and
    no tolerance that closes a window exactly when the rows themselves would, and
    with a tolerance never earlier.
    """
    width = f"{seconds} seconds"
    rows = stream.select(
        F.window(ts, width).getField("start").alias("_start"), *keys,
        as_column(value).alias("_value"),
    )
    reduce_rows, load = TASK_STATES[name]
    states = reduce_rows(rows, "_value", ["_start", *keys], **params)
    # A hot window is held in several states, by share of the tasks.
    marked = events.watermark(states, "_start", delay).select(
        F.window("_start", width).alias("window"), *keys,
        F.pmod("task", F.lit(STATE_SHARES)).alias("_share"), "sketch"
    ).withColumn("_closes", epoch_ms("window.end"))
    number = LongType()
    schema = StructType([
        StructField("window_id", number), *[marked.schema[k] for k in keys],
        StructField("sketch", BinaryType()),
    ])
    held = StructType([StructField("sketch", BinaryType())])

    def absorb(key: tuple, batches: Iterator[pd.DataFrame],
               state: GroupState) -> Iterator[pd.DataFrame]:
        closes = int(key[0])
        if state.hasTimedOut:
            (data,) = state.get
            state.remove()
            out = {"window_id": [closes // (seconds * 1000) - 1]}
            out.update({k: [v] for k, v in zip(keys, key[3:])})
            yield pd.DataFrame({**out, "sketch": [data]})
            return
        total = load(state.get[0]) if state.exists else None
        for batch in batches:
            for data in batch["sketch"]:
                part = load(data)
                if total is None:
                    total = part
                else:
                    total.merge(part)
        state.update((total.to_bytes(),))
        # A state times out when the watermark is past its timestamp.
        state.setTimeoutTimestamp(max(closes - 1, state.getCurrentWatermarkMs() + 1))

    return marked.groupBy("_closes", "window", "_share", *keys).applyInPandasWithState(
        absorb, schema, held, "append", GroupStateTimeout.EventTimeTimeout
    )


def window_quantiles(partials: DataFrame, name: str, keys: Sequence[str] = (),
                     ps: Sequence[float] = QUANTILES, log: bool = False, **params) -> DataFrame:
    """Quantiles of closed windows out of a batch of partial rows."""
    m = method(name, log, **params)
    groups = ["window_id", *keys]
    return m.quantiles(m.finish(partials, groups), groups, ps)


def start_window_query(stream: DataFrame, value: str | Column, name: str, path: str,
                       checkpoint: str, window_seconds: int = WINDOW_SECONDS, ts: str = "ts",
                       keys: Sequence[str] = (), ps: Sequence[float] = QUANTILES,
                       log: bool = False, delay: str = "0 seconds", fmt: str = "parquet",
                       trigger: dict | None = None, state_partitions: int | None = None,
                       table: ResultTable | None = None, **params) -> StreamingQuery:
    """Write the quantiles of each closed window under ``path``, or as lines of ``table``.

    Each micro-batch overwrites its own folder (or its record in the table), so a batch that
    is run again after a failure leaves the same result.  ``state_partitions`` is the number of
    state stores (default: the session's shuffle partitions); it is fixed for the
    life of the checkpoint.
    """
    partials = window_partials(stream, value, name, window_seconds, ts, keys, log, delay,
                               **params)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                wide = window_quantiles(batch, name, keys, ps, log, **params)
                if table is not None:
                    return table.append(result_lines(wide, name), batch_id)
                wide.write.mode("overwrite").format(fmt).save(f"{path}/batch={batch_id}")
        finally:
            batch.unpersist()

    writer = (
        partials.writeStream.outputMode("append").foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "0 seconds"}))
    )
    if state_partitions is None:
        return writer.start()
    # A query takes its settings over from the session when it starts.
    conf, setting = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    with _starting:
        before = conf.get(setting)
        conf.set(setting, str(state_partitions))
        try:
            return writer.start()
        finally:
            conf.set(setting, before)


def stream_query(spark: SparkSession, dataset: str, name: str, source: str, path: str,
                 checkpoint: str, window_seconds: int = WINDOW_SECONDS, fmt: str = "text",
                 trigger: dict | None = None, state_partitions: int | None = None,
                 sink: str = "parquet", **options: str) -> StreamingQuery:
    """The stream query of one dataset (taxi, power, pareto, uniform) and method.

    JSON events -> parse -> event time -> watermark -> window sketch -> quantiles, which
    are written in the format ``sink``.
    """
    field = schemas.VALUE_FIELDS[dataset]
    raw = events.read_json_events(spark, source, fmt, **options)
    if dataset == "taxi":
        parsed = events.project_taxi(events.parse_taxi_event(raw))
    else:
        parsed = events.parse_value_event(raw, field)
    return start_window_query(
        events.assign_event_time(parsed), field, name, path, checkpoint, window_seconds,
        log=uses_log(dataset, name), fmt=sink, trigger=trigger,
        state_partitions=state_partitions,
    )


def read_results(spark: SparkSession, path: str, fmt: str = "parquet",
                 ps: Sequence[float] = QUANTILES) -> DataFrame:
    """All window results written so far; none is an empty table."""
    try:
        return spark.read.format(fmt).load(path).drop("batch")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    columns = [StructField(quantile_column(p), DoubleType()) for p in ps]
    return spark.createDataFrame([], StructType([
        StructField("window_id", LongType()), StructField("n", LongType()), *columns]))
