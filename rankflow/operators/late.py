"""Late events: what a tumbling window loses to a zero-tolerance watermark.

An event is late when, among the events that arrived before it, one already has
an event time at or past the end of its window.  Such an event belongs to a later
window, so only one number per window matters: the first arrival of any later
window.  That makes the rule a small aggregate per window, a suffix minimum over
the windows and an equi-join, instead of a running maximum over all events in
arrival order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.functions.scalars import as_column, missing_pct
from rankflow.functions.uniform import hash_uniform
from rankflow.scratch import hint_broadcast, is_small, join_groups, stage

#: Windows per block of the suffix minimum.
_BLOCK = 4096


def event_delay(arrival_ms: str | Column, u: Column, mean_ms: float = 150.0) -> Column:
    """Event time: arrival minus a whole-millisecond exponential delay."""
    delay = F.floor(F.lit(-float(mean_ms)) * F.ln(F.lit(1.0) - u)).cast("bigint")
    return as_column(arrival_ms).cast("bigint") - delay


def with_delay(df: DataFrame, arrival_ms: str, id_col: str, mean_ms: float = 150.0,
               missing_data: bool = True, out: str = "event_ms") -> DataFrame:
    """Add an event time; without ``missing_data`` it equals the arrival."""
    if not missing_data:
        return df.withColumn(out, F.col(arrival_ms).cast("bigint"))
    return df.withColumn(out, event_delay(arrival_ms, hash_uniform(id_col), mean_ms))


def closing_arrivals(df: DataFrame, arrival: str, window: str = "window_id") -> DataFrame:
    """Per window the first arrival of any later window: ``window, closed_at``."""
    firsts = df.groupBy(window).agg(F.min(arrival).alias("_first")).withColumn(
        "_block", F.floor(F.col(window) / F.lit(_BLOCK)).cast("bigint")
    )
    # Suffix minimum in two levels, so that no window runs over all rows.
    blocks = firsts.groupBy("_block").agg(F.min("_first").alias("_b"))
    lane = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(
        1, Window.unboundedFollowing)
    blocks = blocks.select("_block", F.min("_b").over(lane).alias("_beyond"))
    inside = Window.partitionBy("_block").orderBy(window).rowsBetween(
        1, Window.unboundedFollowing)
    return (
        join_groups(firsts, blocks, ["_block"])
        .select(window, F.least(F.min("_first").over(inside), F.col("_beyond")).alias("closed_at"))
    )


def mark_late(df: DataFrame, arrival: str, window: str = "window_id") -> DataFrame:
    """Add ``is_late``.  ``arrival`` orders the events (unique, non-null)."""
    closing = stage(closing_arrivals(df, arrival, window), "closing")
    joined = join_groups(df, hint_broadcast(closing, is_small(closing)), [window])
    late = F.coalesce(F.col(arrival) > F.col("closed_at"), F.lit(False))
    return joined.withColumn("is_late", late).drop("closed_at")


def late_drop(df: DataFrame, arrival: str, window: str = "window_id") -> DataFrame:
    """The events a watermark of zero tolerance lets through."""
    return mark_late(df, arrival, window).where(~F.col("is_late")).drop("is_late")


def late_count(df: DataFrame, arrival: str, window: str = "window_id",
               keys: Sequence[str] = ()) -> DataFrame:
    """Per window: ``win_size`` (all events) and ``slack_events`` (late ones)."""
    return mark_late(df, arrival, window).groupBy(window, *keys).agg(
        F.count(F.lit(1)).alias("win_size"), F.count_if("is_late").alias("slack_events")
    )


def missing_data_report(counts: DataFrame) -> DataFrame:
    """Mean share of lost events over the windows that lost any."""
    shares = counts.select(missing_pct("slack_events", "win_size").alias("missing_pct"))
    return shares.where("missing_pct > 0").agg(
        F.count(F.lit(1)).alias("windows"), F.avg("missing_pct").alias("mean_missing_pct")
    )


def drop_last_partial_window(df: DataFrame, window: str = "window_id", run: str = "run_id",
                             num_windows: int = 10) -> DataFrame:
    """Drop the last window of each run that has more than ``num_windows``."""
    per_run = df.groupBy(run).agg(
        F.count(F.lit(1)).alias("_windows"), F.max(window).alias("_last")
    )
    last = (F.col("_windows") > num_windows) & (F.col(window) == F.col("_last"))
    return join_groups(df, per_run, [run]).where(~last).drop("_windows", "_last")
