"""KLL, REQ and moments: bounds, merging, edge cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankflow.functions.scalars import QUANTILES, quantile_column
from rankflow.operators import kll, moments, req

N = 40_000


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(3)
    return {"pareto": np.round(1 / (1 - rng.random(N)), 4), "normal": rng.normal(50, 9, N),
            "few": np.array([3.0, 1.0, 2.0, 4.0])}


@pytest.fixture(scope="module")
def df(spark, values):
    frames = [pd.DataFrame({"g": g, "part": np.arange(len(v)) % 7, "v": v})
              for g, v in values.items()]
    return spark.createDataFrame(pd.concat(frames)).repartition(6)


def rank_errors(row, ordered):
    out = {}
    for p in QUANTILES:
        q = row[quantile_column(p)]
        lo = np.searchsorted(ordered, q, "left") / len(ordered)
        hi = np.searchsorted(ordered, q, "right") / len(ordered)
        out[p] = max(0.0, lo - p, p - hi)
    return out


def check(rows, values, bound):
    for r in rows:
        ordered = np.sort(values[r.g].astype(np.float32).astype(float))
        assert r.n == len(ordered)
        for p, e in rank_errors(r, ordered).items():
            assert e <= bound(p) + 1 / len(ordered), (r.g, p, e)


def test_kll(df, values):
    whole = kll.kll_build(df, "v", ["g"])
    merged = kll.kll_merge(kll.kll_build(df, "v", ["g", "part"]).drop("part"), ["g"])
    for sketch in (whole, merged):
        rows = kll.kll_quantiles(sketch, ["g"]).collect()
        check(rows, values, lambda p: 2 * kll.kll_rank_error())
        kept = {r.g: r.num_retained for r in rows}
        assert kept["few"] == 4 and kept["pareto"] < 4 * kll.K


def test_kll_exact_below_k(df):
    few = {r.g: r for r in kll.kll_quantiles(kll.kll_build(df, "v", ["g"]), ["g"]).collect()}["few"]
    assert [few.pct_25, few.pct_50, few.pct_75, few.pct_99] == [1.0, 2.0, 3.0, 4.0]


def test_kll_size_and_error():
    assert kll.kll_rank_error() == pytest.approx(0.00772, abs=5e-5)
    assert kll.kll_rank_error(pmf=True) == pytest.approx(0.00974, abs=5e-5)
    for eps in (0.005, 0.01, 0.1):
        k = kll.kll_k_for_error(eps)
        assert kll.kll_rank_error(k) <= eps < kll.kll_rank_error(k - 1)


def test_req(df, values):
    whole = req.req_build(df, "v", ["g"])
    merged = req.req_merge(req.req_build(df, "v", ["g", "part"]).drop("part"), ["g"])
    for sketch in (whole, merged):
        rows = req.req_quantiles(sketch, ["g"]).collect()
        check(rows, values, lambda p: 4 * req.req_rse(req.K, p))
        assert all(r.num_retained < 6000 for r in rows)
        ends = {r.g: r for r in req.req_describe(sketch, ["g"], [0.0, 1.0]).collect()}
        top = float(np.float32(values["pareto"].max()))
        assert ends["pareto"].max_value == top and ends["pareto"].q[1] == top


def test_req_exclusive_ranks(df):
    few = {r.g: r for r in req.req_quantiles(req.req_build(df, "v", ["g"]), ["g"]).collect()}["few"]
    assert [few.pct_01, few.pct_25, few.pct_50, few.pct_75] == [1.0, 2.0, 3.0, 4.0]


def test_req_without_keys_and_with_null_key(spark):
    rows = [(None, 1.0), (None, 2.0), ("a", 5.0), ("a", None), ("a", float("nan"))]
    d = spark.createDataFrame(rows, "g string, v double")
    assert req.req_quantiles(req.req_build(d, "v")).first().n == 3
    sizes = {r.g: r.n for r in req.req_quantiles(req.req_build(d, "v", ["g"]), ["g"]).collect()}
    assert sizes == {None: 2, "a": 1}


def test_req_state_is_repeatable_and_keeps_weight():
    rng = np.random.default_rng(1)
    data = rng.normal(size=300_000).astype(np.float32)
    states = []
    for _ in range(2):
        s = req.ReqState()
        for chunk in np.array_split(data, 11):
            s.add(chunk)
        states.append(s)
    assert states[0].to_bytes() == states[1].to_bytes()
    s = req.ReqState.from_bytes(states[0].to_bytes())
    assert sum(len(i) << h for h, i in enumerate(s.items)) == s.n == len(data)
    other = req.ReqState()
    other.add(data[:1000])
    s.merge(other)
    assert sum(len(i) << h for h, i in enumerate(s.items)) == s.n == len(data) + 1000


def test_many_small_states_merge_within_bound():
    rng = np.random.default_rng(5)
    data = (1 / (1 - rng.random(200_000))).astype(np.float32)
    total = req.ReqState()
    for chunk in np.array_split(data, 400):
        part = req.ReqState()
        part.add(chunk)
        total.merge(part)
    ordered = np.sort(data)
    got = total.quantiles(np.array(QUANTILES))
    for p, q in zip(QUANTILES, got):
        rank = np.searchsorted(ordered, q, "right") / len(ordered)
        assert abs(rank - p) <= 4 * req.req_rse(req.K, p) + 1e-5


def test_task_state_bound(spark, monkeypatch):
    """A task that hands its states on early gives the same sizes."""
    from rankflow.operators import tasks

    d = spark.range(4000).select((F.col("id") % 40).alias("g"), F.col("id").cast("double").alias("v"))
    monkeypatch.setattr(tasks, "BUFFER_ROWS", 100)
    monkeypatch.setattr(tasks, "MAX_STATES", 8)
    rows = req.req_quantiles(req.req_build(d, "v", ["g"]), ["g"]).collect()
    assert sorted(r.n for r in rows) == [100] * 40


def test_moments(df, values):
    for log in (False, True):
        keep = df.where("g <> 'normal'") if log else df
        whole = moments.moments_build(keep, "v", ["g"], log=log)
        parts = moments.moments_build(keep, "v", ["g", "part"], log=log)
        merged = moments.moments_merge(parts, ["g"])
        a = {r.g: r for r in moments.moments_quantiles(whole, ["g"], log=log).collect()}
        b = {r.g: r for r in moments.moments_quantiles(merged, ["g"], log=log).collect()}
        for g in a:
            assert a[g].n == b[g].n == len(values[g])
            if g == "few":
                continue
            for row in (a[g], b[g]):
                assert max(rank_errors(row, np.sort(values[g])).values()) <= 0.02


def test_moments_of_a_constant(spark):
    d = spark.createDataFrame([(7.5,)] * 5, "v double")
    row = moments.moments_quantiles(moments.moments_build(d, "v")).first()
    assert row.n == 5 and row.pct_50 == pytest.approx(7.5) and row.pct_99 == pytest.approx(7.5)


def test_moments_solver_converges_on_smooth_data():
    x = np.random.default_rng(2).normal(10, 2, 200_000)
    z = np.arcsinh(x)
    sums = np.array([np.sum(z**i) for i in range(1, 12)])
    one = [np.array([x], dtype=float) for x in (len(z), z.min(), z.max())]
    got = moments.solve(*one, sums[None, :], np.array(QUANTILES))[0]
    ordered = np.sort(z)
    for p, q in zip(QUANTILES, got):
        assert abs(np.searchsorted(ordered, q) / len(z) - p) < 0.005
    assert all(math.isfinite(v) for v in got)


def test_moments_batch_equals_single_groups():
    rng = np.random.default_rng(8)
    n, lo, hi, sums = [], [], [], []
    for g in range(40):
        z = np.arcsinh(rng.lognormal(g / 9, 0.2 + g / 40, 20 + 30 * g))
        n.append(len(z))
        lo.append(z.min())
        hi.append(z.max())
        sums.append([np.sum(z**i) for i in range(1, 12)])
    args = [np.array(a, dtype=float) for a in (n, lo, hi, sums)]
    whole = moments.solve(*args, np.array(QUANTILES))
    for g in range(40):
        alone = moments.solve(*[a[g : g + 1] for a in args], np.array(QUANTILES))
        assert np.allclose(whole[g], alone[0], atol=1e-6)
    assert (np.diff(whole, axis=1) >= 0).all()
    assert (whole >= args[1][:, None]).all() and (whole <= args[2][:, None]).all()


@pytest.mark.parametrize("name", ["req", "udds"])
def test_merging_does_not_depend_on_the_order_of_task_states(spark, name):
    from rankflow.operators import buckets
    from rankflow.operators.tasks import merge_states

    df = spark.range(0, 40_000, 1, 16).selectExpr("id % 3 AS g", "pow(id % 997, 1.5D) AS v")
    partials, load = {
        "req": (req.req_partials, req.ReqState.from_bytes),
        "udds": (buckets.udds_partials, buckets.BucketState.from_bytes)}[name]
    states = spark.createDataFrame(partials(df, "v", ["g"]).collect())
    merged = [
        {r.g: bytes(r.sketch) for r in merge_states(s, ["g"], load).collect()}
        for s in (states, states.orderBy("sketch"), states.repartition(5).orderBy(F.desc("task")))]
    assert len(merged[0]) == 3 and merged[0] == merged[1] == merged[2]


def test_moments_tell_what_they_left_out(spark):
    rows = [("a", 1.0), ("a", -1.0), ("a", 0.0), ("a", None), ("b", -3.0), ("c", 2.0), ("c", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    sketch = moments.moments_build(df, "v", ["g"], log=True)
    got = {r.g: r for r in moments.moments_quantiles(
        moments.moments_merge(sketch, ["g"]), ["g"], [0.5], log=True).collect()}
    assert {g: (r.n, r.skipped) for g, r in got.items()} == {"a": (1, 2), "b": (0, 1), "c": (2, 0)}
    assert got["b"].pct_50 is None and got["a"].pct_50 == pytest.approx(1.0)
    smooth = spark.range(20_000).selectExpr("sqrt(id + 1) AS v")
    row = moments.moments_quantiles(moments.moments_build(smooth, "v")).first()
    assert row.moments_used == 12 and row.converged
