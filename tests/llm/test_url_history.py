"""A key that is listed and taken off many times meets its captures in one sort."""

from pyspark.sql import functions as F

from rankflow.llm import url_filter


def test_thousand_intervals_on_a_hot_key(spark):
    ends = [(3 * i, "add") for i in range(1_000)] + [(3 * i + 2, "remove") for i in range(1_000)]
    day = F.expr("date_add(DATE '2000-01-01', d)")
    entries = spark.createDataFrame([("hot.org", "block", a, d) for d, a in ends] + [
        ("hot.org", "allow", "add", 2_990), ("hot.org", "grey", "add", 0)],
        "key string, list string, action string, d int").withColumn("day", day)
    captures = spark.range(30_000).select(
        "id", F.lit("http://hot.org/").alias("url"), (F.col("id") % 3_000).cast("int").alias("d")).withColumn(
        "day", day)
    got = url_filter.filter_urls(captures, entries, "id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
    want = {i: ("allow" if i % 3_000 >= 2_990 else "block" if i % 3 < 2 else "none",
                (i % 3 < 2) + (i % 3_000 >= 2_990)) for i in range(30_000)}
    assert {r.id: (r.decision, r.n_active) for r in got.collect()} == want
