import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rankflow.functions.scalars import QUANTILES, quantile_column
from rankflow.operators import exact
from tests import brute

NAN, INF = float("nan"), float("inf")


def frame(spark, groups):
    rows = [(g, None if v is None else float(v)) for g, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "g string, v double")


def expected(values, p):
    return brute.exact(values, p)


@pytest.mark.parametrize("plan", [exact.exact_quantiles_small, exact.exact_quantiles_large,
                                  exact.exact_quantiles])
def test_nearest_rank(spark, plan):
    groups = {
        "ten": [1.0, 2, 3, 4, 5, 6, 7, 18, 30, 51],
        "one": [42.5],
        "equal": [3.25] * 17,
        "signed": [-5.0, -0.5, 0.0, 0.0, 2.0, 1e-9, -1e12, 7e300],
        None: [9.0, 8.0, 7.0],
    }
    got = {r.g: r for r in plan(frame(spark, groups), "v", ["g"], places=None).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g].n == len(values)
        for p in QUANTILES:
            assert got[g][quantile_column(p)] == expected(values, p), (g, p)


def test_fixed_values(spark):
    values = [1.0, 2, 3, 4, 5, 6, 7, 18, 30, 51, 10002412, 123.01123333]
    ps = [0.8, 0.85, 0.9, 0.95, 0.99]
    row = exact.exact_quantiles_large(frame(spark, {"a": values}), "v", [], ps, None).first()
    assert [row[quantile_column(p)] for p in ps] == [expected(values, p) for p in ps]


def test_nulls_left_out_nan_and_infinity_sorted(spark):
    df = frame(spark, {"a": [None, 1.0, NAN, INF, -INF, 2.0, None]})
    for plan in (exact.exact_quantiles_small, exact.exact_quantiles_large):
        row = plan(df, "v", ["g"], [0.2, 0.4, 0.6, 0.8, 0.99], None).first()
        assert row.n == 5
        assert (row.pct_20, row.pct_40, row.pct_60, row.pct_80) == (-INF, 1.0, 2.0, INF)
        assert math.isnan(row.pct_99)


def test_values_inside_one_slice(spark):
    """All values within one block, most of them within one slice of it."""
    values = [100.0 + i * 1e-11 for i in range(500)] + [100.9]
    row = exact.exact_quantiles_large(frame(spark, {"a": values}), "v", ["g"], places=None).first()
    for p in QUANTILES:
        assert row[quantile_column(p)] == expected(values, p)


@pytest.mark.parametrize("size", [19, 20, 21, 200])
def test_rows_do_not_depend_on_the_plan(spark, monkeypatch, size):
    monkeypatch.setattr(exact, "ONE_TASK", 1)
    nulls = spark.createDataFrame([("n", None)] * size, "g string, v double")
    row = exact.exact_quantiles(nulls, "v").first()
    assert row.n == 0 and row.pct_50 is None
    assert exact.exact_quantiles(nulls, "v", ["g"]).count() == 0
    both = nulls.unionByName(frame(spark, {"n": [float(i) for i in range(size)]}))
    for keys in ([], ["g"]):
        row = exact.exact_quantiles(both, "v", keys).first()
        assert (row.n, row.pct_50) == (size, expected([float(i) for i in range(size)], 0.5))


@pytest.mark.parametrize("values", [
    [1.7e9 + i for i in range(400)], [1e6] + [1.0001e6 + i * 1e-7 for i in range(300)],
    [5.0] * 500 + [5.0000001, 4.9], [float("nan")] * 3 + [float("inf"), float("-inf"), 0.0, -1.0]])
def test_values_within_one_block(spark, monkeypatch, values):
    monkeypatch.setattr(exact, "SLICES", 8)
    monkeypatch.setattr(exact, "ONE_TASK", 40)
    row = exact.exact_quantiles_large(frame(spark, {"a": values}), "v", ["g"], places=None).first()
    ordered = sorted(values, key=lambda v: (v != v, v))
    for p in QUANTILES:
        want = ordered[max(1, math.ceil(p * len(ordered))) - 1]
        got = row[quantile_column(p)]
        assert got == want or (got != got and want != want)


def test_weighted_counts(spark):
    values = [1.0] * 5 + [2.0] * 3 + [9.0]
    counts = exact.value_counts(frame(spark, {"a": values}), "v", ["g"])
    row = exact.count_quantiles(counts, ["g"], [0.5, 0.6, 0.95]).first()
    assert (row.n, row.pct_50, row.pct_60, row.pct_95) == (9, 1.0, 2.0, 9.0)


def test_empty_input(spark):
    df = frame(spark, {"a": [1.0]}).where("v > 5")
    assert exact.exact_quantiles_large(df, "v", ["g"]).count() == 0


@pytest.mark.parametrize("one_task", [10, 1 << 20])
def test_small_and_hot_groups_together(spark, monkeypatch, one_task):
    monkeypatch.setattr(exact, "ONE_TASK", one_task)
    groups = {"cold": [5.0, 1.0, 3.0], "hot": [100 + float(i * i % 97) / 100 for i in range(600)],
              None: [float(i) for i in range(30)], "cool": [2.0] * 20}
    got = {r.g: r for r in exact.exact_quantiles(frame(spark, groups), "v", ["g"]).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g].n == len(values)
        for p in QUANTILES:
            assert got[g][quantile_column(p)] == expected(values, p)


@pytest.mark.parametrize("one_task,values,second", [
    (10, [100 + i / 1000 for i in range(900)], 1), (1 << 20, [100 + i / 1000 for i in range(900)], 1),
    (10, [float(2 ** (i % 9)) for i in range(900)], 0)])
def test_the_input_is_read_at_most_twice(spark, monkeypatch, fresh_dir, one_task, values, second):
    """Once to locate the ranks, when called, and once more if a rank is then still open."""
    monkeypatch.setattr(exact, "ONE_TASK", one_task)
    frame(spark, {"a": values, "b": values[:300]}).write.parquet(fresh_dir)
    wide = exact.exact_quantiles(spark.read.parquet(fresh_dir), "v", ["g"])
    wide.collect()
    ran = wide._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert ran.count("DataFilters: [isnotnull(v#") == second


def test_one_hot_group_without_keys(spark, monkeypatch):
    monkeypatch.setattr(exact, "ONE_TASK", 3)
    row = exact.exact_quantiles(frame(spark, {"a": [1.0, 2, 3, 4]}), "v").first()
    assert (row.n, row.pct_50, row.pct_75) == (4, 2.0, 3.0)


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=60))
def test_any_doubles(spark, values):
    row = exact.exact_quantiles_large(frame(spark, {"a": values}), "v", [], places=None).first()
    for p in QUANTILES:
        assert row[quantile_column(p)] == expected(values, p)
