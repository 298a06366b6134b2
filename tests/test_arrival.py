"""Streams whose windows close event by event: any cut into batches gives the table's rows."""

import random

import pytest
from pyspark.sql import functions as F

from rankflow.functions.scalars import quantile_columns
from rankflow.operators import late
from rankflow.plans.methods import method
from rankflow.streaming.arrival import ArrivalWindows

SECONDS = 10
SCHEMA = "id bigint, k string, v double, ts timestamp"


def delayed(n=240, seed=3):
    rng = random.Random(seed)
    return [(i, "ab"[i % 2], float(rng.randint(1, 60)),
             1_700_000_000 + i // 4 - int(rng.expovariate(1 / 4))) for i in range(n)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, k string, v double, s bigint")
    return df.withColumn("ts", F.timestamp_seconds("s")).drop("s")


def stream_of(spark, rows, cuts, where, name="dds", **more):
    """Feed the rows in arrival order, one micro-batch per cut."""
    query = ArrivalWindows(f"{where}/out", "v", name, "id", SECONDS, keys=["k"], **more)
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        frame(spark, rows[a:b]).coalesce(1).write.mode("append").parquet(f"{where}/in")
        run = query.start(spark.readStream.schema(SCHEMA).parquet(f"{where}/in"), f"{where}/cp",
                          {"availableNow": True})
        run.awaitTermination()
        assert all(not p["stateOperators"] for p in run.recentProgress)
    return query


def plain_late(rows):
    seen, out = None, []
    for i, _, _, s in rows:
        w = s // SECONDS
        out.append(seen is not None and w < seen)
        seen = w if seen is None else max(seen, w)
    return out


@pytest.mark.parametrize("cuts", [[], [1, 17, 100]])
def test_counts_equal_the_batch_rule(spark, tmp_path, cuts):
    rows = delayed()
    query = stream_of(spark, rows, cuts, str(tmp_path), keep_events=True)
    got = {tuple(r) for r in query.counts(spark).select(
        "window_id", "k", "win_size", "slack_events").collect()}
    table = frame(spark, rows).withColumn("window_id", F.floor(
        F.unix_timestamp("ts") / SECONDS).cast("bigint"))
    want = {tuple(r) for r in late.late_count(table, "id", keys=["k"]).select(
        "window_id", "k", "win_size", "slack_events").collect()}
    assert got == want and sum(r[3] for r in got) == sum(plain_late(rows)) > 10
    kept = {r.id for r in query.events_in_time(spark).collect()}
    assert kept == {r[0] for r, is_late in zip(rows, plain_late(rows)) if not is_late}


@pytest.mark.parametrize("name", ["udds", "req", "exact"])
def test_every_window_with_the_last_one(spark, tmp_path, name):
    rows = delayed()
    query = stream_of(spark, rows, [130], str(tmp_path), name)
    columns = ["window_id", "k", "n", *quantile_columns()]
    closed = query.results(spark).select(*columns).collect()
    query.end_stream(spark)
    got = sorted(query.results(spark).select(*columns).collect())
    in_time = [r for r, is_late in zip(rows, plain_late(rows)) if not is_late]
    table = frame(spark, in_time).withColumn("window_id", F.floor(
        F.unix_timestamp("ts") / SECONDS).cast("bigint"))
    want = sorted(method(name).run(table, "v", ["window_id", "k"]).select(*columns).collect())
    last = max(r.window_id for r in want)
    assert {r.window_id for r in want} - {r.window_id for r in closed} == {last}
    assert [r[:3] for r in got] == [r[:3] for r in want]
    for a, b in zip(got, want):
        # These windows are small, so even the sampled sketches hold every value.
        assert a[3:] == pytest.approx(b[3:], rel=0, abs=0)


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    rows = delayed(120)
    query = stream_of(spark, rows, [40], str(tmp_path), "exact")
    before = [sorted(df.collect()) for df in (query.counts(spark), query.results(spark))]
    again = frame(spark, rows[40:])
    query.absorb(again, 1)
    query.absorb(again, 1)
    assert [sorted(df.collect()) for df in (query.counts(spark), query.results(spark))] == before


def test_an_ended_stream_may_go_on(spark, tmp_path):
    rows = delayed(200)
    query = stream_of(spark, rows[:90], [], str(tmp_path), "exact")
    query.end_stream(spark)
    open_window = query.state(spark, query.last_batch(spark))[0]
    assert open_window in {r.window_id for r in query.results(spark).collect()}
    query = stream_of(spark, rows[:90] + rows[90:], [90], f"{tmp_path}/whole", "exact")
    query.end_stream(spark)
    once = sorted(query.results(spark).collect())
    more = ArrivalWindows(f"{tmp_path}/out", "v", "exact", "id", SECONDS, keys=["k"])
    more.absorb(frame(spark, rows[90:]), 1)
    more.end_stream(spark)
    assert sorted(more.results(spark).collect()) == once


def test_nothing_and_batches_without_rows(spark, tmp_path):
    query = ArrivalWindows(str(tmp_path), "v", "kll", "id", SECONDS, keys=["k"])
    assert query.results(spark) is None
    query.end_stream(spark)
    empty = frame(spark, delayed(4)).where("id < 0")
    query.absorb(empty, 0)
    query.absorb(frame(spark, delayed(4)), 1)
    query.absorb(empty, 2)
    assert query.results(spark) is None or query.results(spark).count() >= 0
    query.end_stream(spark)
    assert query.results(spark).agg(F.sum("n")).first()[0] >= 1
    missing = frame(spark, delayed(4)).withColumn("ts", F.lit(None).cast("timestamp"))
    query.absorb(missing, 3)
    assert query.state(spark, 3) == query.state(spark, 2)
