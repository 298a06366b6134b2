import random

import pytest

from rankflow.functions.scalars import QUANTILES, quantile_column
from rankflow.operators import buckets as b
from tests import brute


@pytest.fixture(scope="module")
def values():
    rnd = random.Random(7)
    skew = [round(rnd.paretovariate(1), 4) for _ in range(3000)]
    signed = [round(rnd.gauss(0, 2), 4) for _ in range(1500)] + [0.0] * 40
    tiny = [10 ** rnd.uniform(-12, 12) for _ in range(1500)]
    return {"skew": skew, "signed": signed, "tiny": tiny, "one": [5.0], None: [1.5, -2.5]}


@pytest.fixture(scope="module")
def df(spark, values):
    rows = [(g, i % 5, v) for g, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "g string, part int, v double").repartition(4)


def by_group(sketch):
    out = {}
    for r in sketch.collect():
        out.setdefault(r.g, {})[(r.sgn, r.idx)] = r.n
    return out


def test_dds_build_and_merge(df, values):
    whole = by_group(b.dds_build(df, "v", ["g"]))
    merged = by_group(b.dds_merge(b.dds_build(df, "v", ["g", "part"]).drop("part"), ["g"]))
    assert whole == merged
    for g, vs in values.items():
        assert whole[g] == dict(brute.buckets(vs, 0.01))


def test_dds_quantiles_close_to_order_statistic(df, values):
    wide = {r.g: r for r in b.dds_quantiles(b.dds_build(df, "v", ["g"]), ["g"]).collect()}
    for g, vs in values.items():
        ordered = sorted(vs)
        for p in QUANTILES:
            got = wide[g][quantile_column(p)]
            assert got == pytest.approx(brute.walk(brute.buckets(vs, 0.01), p, 0.01))
            real = ordered[int(p * (len(vs) - 1))]
            assert abs(got - real) <= 0.0100001 * abs(real)


def test_dds_minmax(df, values):
    rows = b.dds_minmax(b.dds_build(df, "v", ["g"]), ["g"]).collect()
    for r in rows:
        lo, hi = min(values[r.g]), max(values[r.g])
        assert abs(r.min_value - lo) <= 0.0100001 * abs(lo)
        assert abs(r.max_value - hi) <= 0.0100001 * abs(hi)


def test_unusable_values_left_out(spark):
    rows = [(float("nan"),), (None,), (float("inf"),), (float("-inf"),), (2.0,)]
    sketch = b.dds_build(spark.createDataFrame(rows, "v double"), "v")
    assert [r.n for r in sketch.collect()] == [1]


@pytest.mark.parametrize("limit", [1, 7, 64, 1024])
def test_ddsc_fold(df, values, limit):
    whole = by_group(b.ddsc_build(df, "v", ["g"], max_buckets=limit))
    parts = b.ddsc_build(df, "v", ["g", "part"], max_buckets=limit).drop("part")
    assert by_group(b.ddsc_merge(parts, ["g"], max_buckets=limit)) == whole
    for g, vs in values.items():
        assert whole[g] == dict(brute.fold(brute.buckets(vs, 0.01), limit))


@pytest.mark.parametrize("limit", [4, 50, 1024])
def test_udds_build_merge_and_stream_path_agree(df, values, limit):
    whole = b.udds_build(df, "v", ["g"], max_buckets=limit)
    parts = b.udds_build(df, "v", ["g", "part"], max_buckets=limit).drop("part")
    merged = b.udds_merge(parts, ["g"], max_buckets=limit)
    native = b.udds_collapse(b.udds_counts(df, "v", ["g"]), ["g"], max_buckets=limit)
    expect, levels = by_group(whole), {r.g: r.level for r in whole.collect()}
    assert by_group(merged) == expect
    assert by_group(native) == expect
    assert {r.g: r.level for r in native.collect()} == levels
    assert {r.g: r.level for r in merged.collect()} == levels
    for g, vs in values.items():
        level, counts = brute.collapse(brute.buckets(vs, b.uniform_alpha()), limit)
        assert levels[g] == level
        assert expect[g] == dict(counts)


def test_udds_level_across_blocks(spark):
    """Neighbours far apart merge only at levels past the block width."""
    base = b.gamma(b.uniform_alpha())
    values = [base ** (k * 70_000 + 0.5) for k in range(-9, 10)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    native = b.udds_collapse(b.udds_counts(df, "v"), [], max_buckets=4)
    level, counts = brute.collapse(brute.buckets(values, b.uniform_alpha()), 4)
    assert {(r.level, r.sgn, r.idx, r.n) for r in native.collect()} == {
        (level, s, i, n) for (s, i), n in counts.items()}


def test_udds_quantiles_accuracy(df, values):
    wide = b.udds_quantiles(b.udds_build(df, "v", ["g"]), ["g"]).collect()
    for r in wide:
        ordered = sorted(values[r.g])
        for p in QUANTILES:
            real = ordered[int(p * (len(ordered) - 1))]
            assert abs(r[quantile_column(p)] - real) <= (r.alpha + 1e-9) * abs(real)


def test_smoke_values(spark):
    """Ten fixed values at 0.8 and 0.9: both sketches near the order statistic."""
    rows = [(float(v),) for v in (1, 2, 3, 4, 5, 6, 7, 18, 30, 51)]
    df = spark.createDataFrame(rows, "v double")
    dds = b.dds_quantiles(b.dds_build(df, "v"), [], [0.8, 0.9]).first()
    udds = b.udds_quantiles(b.udds_build(df, "v"), [], [0.8, 0.9]).first()
    assert dds.pct_80 == pytest.approx(18, rel=0.01)
    assert dds.pct_90 == pytest.approx(30, rel=0.01)
    assert udds.pct_80 == pytest.approx(18, rel=1e-4)
    assert udds.pct_90 == pytest.approx(30, rel=1e-4)


def test_bucket_state_bytes():
    import numpy as np

    s = b.BucketState(8)
    s.add(np.array([b._SHIFT + i for i in range(40)] + [0], dtype=np.int64))
    t = b.BucketState.from_bytes(s.to_bytes())
    assert (t.level, list(t.codes), list(t.n)) == (s.level, list(s.codes), list(s.n))
    assert t.n.sum() == 41


def test_a_bound_that_no_store_can_meet(spark):
    df = spark.createDataFrame([(-2.0,), (-0.5,), (0.5,), (2.0,)], "v double")
    for call in (lambda: b.udds_build(df, "v", max_buckets=3),
                 lambda: b.udds_collapse(b.udds_counts(df, "v"), max_buckets=3),
                 lambda: b.udds_merge(b.udds_build(df, "v"), max_buckets=3),
                 lambda: b.BucketState(1)):
        with pytest.raises(ValueError):
            call()
    assert b.udds_build(df, "v", max_buckets=4).count() == 4
