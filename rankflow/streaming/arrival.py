"""Windows of a stream that close event by event, with counts of what came late.

Spark drops late rows per micro-batch, so what it drops depends on where the batches are cut.
Here the rule is the one of ``operators.late``: an event is late if an event of a later window
arrived before it, whatever batch either is in.  As a window is closed by the first event of a
later one, at most one window is open between batches, and what earlier batches say about an
event is one number: the latest window they have seen.  Within a batch the rule is the
batch operator's.

What the stream carries from batch to batch are tables in its folder, not state in memory:

* ``state/batch=k``: the open window after batch ``k``, and the batch it began in;
* ``parts/batch=k``: the batch's sketch rows (exact: value counts) of its events in time;
* ``counts/batch=k``: per window, all events and the late ones;
* ``events/batch=k``: the events in time, if they are asked for;
* ``results/batch=k``: the quantiles of the windows that the batch closes.

Each batch writes folders of its own number out of its own rows and the state before it, so a
batch that is run again after a failure replaces what the first attempt left.  State in
executors' memory is none, for every method; a window's sketch rows are merged when it closes,
and exact quantiles are found by the two scans of ``operators.exact`` over the kept counts.

Batches must come in the order of arrival; inside a batch the ``arrival`` column orders the
events (unique, not NULL).  ``end_stream`` closes the last window of a bounded run.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from rankflow.functions.scalars import QUANTILES, window_id
from rankflow.operators.late import mark_late
from rankflow.plans.methods import method
from rankflow.streaming.windows import WINDOW_SECONDS

_STATE = "open_window bigint, since bigint"


@dataclass(frozen=True)
class ArrivalWindows:
    """A window query over a stream in order of arrival.

    ``name`` is a method of ``plans.methods``; its rows for a batch are built, stored and
    merged like any other sketches.
    """

    path: str
    value: str | Column
    name: str
    arrival: str
    window_seconds: float = WINDOW_SECONDS
    ts: str = "ts"
    keys: Sequence[str] = ()
    ps: Sequence[float] = QUANTILES
    log: bool = False
    fmt: str = "parquet"
    keep_events: bool = False
    params: dict = field(default_factory=dict)

    def _method(self):
        return method(self.name, self.log, **self.params)

    def _groups(self) -> list[str]:
        return ["window_id", *self.keys]

    def _folder(self, part: str, batch: int) -> str:
        return f"{self.path}/{part}/batch={batch}"

    def start(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(self.absorb).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "0 seconds"})).start()
        )

    def state(self, spark: SparkSession, batch: int) -> tuple[int | None, int]:
        """The open window after a batch and the batch it began in."""
        if batch < 0:
            return None, 0
        row = spark.read.schema(_STATE).parquet(self._folder("state", batch)).first()
        return row.open_window, row.since

    def absorb(self, batch: DataFrame, number: int) -> None:
        """Take one micro-batch in; the sink of the stream."""
        spark = batch.sparkSession
        known, since = self.state(spark, number - 1)
        timed = batch.withColumn("window_id", window_id(self.ts, self.window_seconds)).where(
            F.col("window_id").isNotNull()).persist()
        try:
            latest = timed.agg(F.max("window_id")).first()[0]
            now = max((w for w in (known, latest) if w is not None), default=None)
            if latest is not None:
                closed_before = F.lit(False) if known is None else F.col("window_id") < known
                marked = mark_late(timed, self.arrival).withColumn(
                    "is_late", F.col("is_late") | closed_before)
                self._write(marked.groupBy(*self._groups()).agg(
                    F.count(F.lit(1)).alias("win_size"),
                    F.count_if("is_late").alias("slack_events")), "counts", number)
                in_time = marked.where(~F.col("is_late")).drop("is_late")
                if self.keep_events:
                    self._write(in_time, "events", number)
                rows = self._method().build(in_time, self.value, self._groups())
                self._write(rows, "parts", number)
        finally:
            timed.unpersist()
        if now is not None and now != known:
            first = since if known is not None else number
            self._close(spark, range(first, number + 1), known, now, self._folder("results", number))
            since = number
        spark.createDataFrame([(now, since)], _STATE).coalesce(1).write.mode("overwrite").parquet(
            self._folder("state", number))

    def _write(self, rows: DataFrame, part: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(self._folder(part, number))

    def _parts(self, spark: SparkSession, batches: range) -> DataFrame | None:
        """Sketch rows that the batches left; a batch without rows left none."""
        found = [b for b in batches if _exists(spark, self._folder("parts", b))]
        return spark.read.parquet(*[self._folder("parts", b) for b in found]) if found else None

    def _close(self, spark: SparkSession, batches: range, first: int | None, before: int,
               target: str) -> None:
        """Quantiles of the windows from ``first`` up to ``before``."""
        rows = self._parts(spark, batches)
        if rows is None:
            return
        due = rows.where(F.col("window_id") < before)
        if first is not None:
            due = due.where(F.col("window_id") >= first)
        m = self._method()
        wide = m.quantiles(m.merge(due, self._groups()), self._groups(), self.ps)
        wide.write.mode("overwrite").format(self.fmt).save(target)

    def last_batch(self, spark: SparkSession) -> int | None:
        """The number of the last batch whose state is written."""
        done = _load(spark, f"{self.path}/state", schema=f"{_STATE}, batch bigint")
        return None if done is None else done.agg(F.max("batch")).first()[0]

    def end_stream(self, spark: SparkSession) -> None:
        """Close the last window of a bounded run.

        The result holds until the stream takes in another batch: then it is left aside, and
        the window closes with the others.
        """
        last = self.last_batch(spark)
        if last is None:
            return
        now, since = self.state(spark, last)
        if now is not None:
            self._close(spark, range(since, last + 1), now, now + 1, self._folder("end", last))

    def results(self, spark: SparkSession) -> DataFrame | None:
        """Quantiles of all closed windows; None if no window was closed."""
        closed = _load(spark, f"{self.path}/results", self.fmt)
        last = self.last_batch(spark)
        ended = None if last is None else _load(spark, self._folder("end", last), self.fmt)
        found = [df.drop("batch") for df in (closed, ended) if df is not None]
        return None if not found else found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def counts(self, spark: SparkSession) -> DataFrame:
        """Per window: ``win_size`` (all events so far) and ``slack_events`` (late ones)."""
        return spark.read.parquet(f"{self.path}/counts").groupBy(*self._groups()).agg(
            F.sum("win_size").alias("win_size"), F.sum("slack_events").alias("slack_events"))

    def events_in_time(self, spark: SparkSession) -> DataFrame:
        """The events that were not late, if the stream keeps them."""
        return spark.read.parquet(f"{self.path}/events").drop("batch")


def _load(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None):
    try:
        reader = spark.read.format(fmt)
        return (reader.schema(schema) if schema else reader).load(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _exists(spark: SparkSession, path: str) -> bool:
    return _load(spark, path, schema="window_id bigint") is not None
