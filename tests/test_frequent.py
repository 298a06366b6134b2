"""Most frequent values by summaries of bounded size."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankflow.operators import req, stats

NAN = float("nan")


def plain(values, k):
    order = lambda v: (v is not None, v != v if v is not None else False, v if v == v else 0)
    counts = Counter("nan" if v is not None and v != v else v for v in values)
    rows = [(NAN if v == "nan" else v, n) for v, n in counts.items()]
    return sorted(rows, key=lambda r: (-r[1], order(r[0])))[:k]


def same(got, want):
    return len(got) == len(want) and all(n == m and (a == b or (a != a and b != b)) for (a, n), (b, m)
                                         in zip(got, want))


@pytest.mark.parametrize("counters", [3, 20, 10_000])
@pytest.mark.parametrize("kind", ["skewed", "flat", "odd"])
def test_equals_a_full_count(spark, counters, kind):
    rng = random.Random(2)
    values = {"skewed": [float(int(rng.paretovariate(0.7))) for _ in range(3000)],
              "flat": [float(i % 400) for i in range(1600)],
              "odd": [None] * 40 + [NAN] * 30 + [0.0, -0.0] * 20 + [float(i) for i in range(300)]}[kind]
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    got = [tuple(r) for r in stats.top_values(df, "v", 7, counters).collect()]
    assert same(got, plain(values, 7)), (got, plain(values, 7))


def test_a_million_distinct_values(spark):
    df = spark.range(1_000_000).select(
        F.when(F.col("id") % 5 == 0, F.col("id") % 45).otherwise(F.col("id")).alias("v"))
    got = [tuple(r) for r in stats.top_values(df, "v", 5).collect()]
    want = df.groupBy("v").count().orderBy(F.desc("count"), "v").limit(5).collect()
    assert got == [tuple(r) for r in want]
    summaries = stats.frequency_summaries(df, "v").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in summaries) <= stats.TOP_COUNTERS + 1


def test_summaries_bound_every_count(spark):
    values = [int(random.Random(i).paretovariate(0.5)) % 500 for i in range(4000)]
    rows = stats.frequency_summaries(spark.createDataFrame([(v,) for v in values], "v int"), "v", 15).collect()
    cut, seen, real = sum(r.cut or 0 for r in rows), Counter(), Counter(values)
    for r in rows:
        if r.cut is None:
            seen[r.value] += r.n
    assert cut > 0
    assert all(real[v] - cut <= seen[v] <= real[v] for v in real)


def test_text_values_and_no_rows(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "v string")
    assert [tuple(r) for r in stats.top_values(df, "v", 2).collect()] == [("a", 2), ("b", 2)]
    assert stats.top_values(df.limit(0), "v").count() == 0


def test_rank_bounds_know_the_number_of_values_and_the_side(spark):
    def bounds(p, n, side="high"):
        lower, upper = req.req_rank_bounds(p, n, side=side)
        return spark.range(1).select(lower, upper).first()

    for p in (.01, .25, .5, .9, .99, .9999):
        error = min(.084 / 30, .1306 / 30 * (1 - p))
        lower, upper = bounds(p, 1_000_000)
        assert math.isclose(upper - p, error, rel_tol=1e-9, abs_tol=1e-15)
        assert math.isclose(p - lower, error, rel_tol=1e-9, abs_tol=1e-15)
        assert math.isclose(upper, req.req_upper_rank(30, p))
        assert bounds(p, 90) == (p, p)  # as many as the first level holds
        low, high = bounds(1 - p, 1_000_000, "low")
        assert math.isclose(high - (1 - p), upper - p, rel_tol=1e-9, abs_tol=1e-12)
    assert bounds(.999, 1_000) == (.999, .999) and bounds(.5, 1_000)[1] > .5
    with pytest.raises(ValueError):
        req.req_rank_bounds(.5, 10, side="middle")
