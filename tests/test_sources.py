"""Caps in file order, and the source of generated events."""

import time

import pytest
from pyspark.sql import functions as F

from rankflow.functions import uniform
from rankflow.sources import files, generated


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_row_cap_is_file_order_however_files_are_split(spark, fresh_dir, fmt):
    for n in range(4):
        part = spark.range(n * 500, n * 500 + 500, numPartitions=1).withColumn("text", F.lit("x" * 40))
        part.write.format(fmt).mode("append").save(f"{fresh_dir}/part={n}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = spark.read.schema("id bigint, text string, part int").format(fmt).load(fresh_dir)
            for n in (0, 1, 499, 500, 501, 1733, 2000, 5000):
                got = files.row_cap(df, n)
                assert got.columns == ["id", "text", "part"]
                assert sorted(r.id for r in got.collect()) == list(range(min(n, 2000))), (size, n)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(ValueError):
        files.row_cap(df, -1)


def run(stream, where):
    query = stream.writeStream.format("parquet").option("path", f"{where}/out").option(
        "checkpointLocation", f"{where}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_generated_events_go_on_after_a_restart(spark, fresh_dir):
    for rows in (700, 700, 1900):
        stream = generated.read_event_stream(spark, rows, 1_000_000, 3_000, 150.0, ids_per_task=256)
        run(stream, fresh_dir)
        want = uniform.gen_event_stream(spark.range(rows), "id", 1_000_000, 3_000, 150.0)
        got = spark.read.parquet(f"{fresh_dir}/out")
        assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


def test_ranges_do_not_depend_on_the_attempt():
    reader = generated.IdReader({"rows": "1000", "idsPerTask": "300"})
    assert (reader.initialOffset(), reader.latestOffset()) == ({"id": 0}, {"id": 1000})
    parts = reader.partitions({"id": 100}, {"id": 1000})
    assert [(p.first, p.end) for p in parts] == [(100, 400), (400, 700), (700, 1000)]
    assert reader.partitions({"id": 5}, {"id": 5}) == []
    ids = [i for p in parts for b in reader.read(p) for i in b.column("id").to_pylist()]
    assert ids == list(range(100, 1000))


def test_paced_ids_fall_due_by_the_clock():
    now = int(time.time() * 1000)
    due = lambda start: generated.IdReader(
        {"rows": "5000", "startMs": str(start), "idsPerMs": "2"}).latestOffset()["id"]
    assert due(now + 60_000) == 0 and due(now - 3_600_000) == 5000
    assert 2000 <= due(now - 1000) <= 5000
