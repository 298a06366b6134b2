"""Sketches of many small groups, made and merged by columns: the same bytes as state by state."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankflow.operators import buckets, req, tasks
from rankflow.operators.buckets import BucketState, SmallBuckets
from rankflow.operators.req import ReqState, SmallReq


def state_of(values, k):
    state = ReqState(k)
    state.add(np.array(values, dtype=np.float32))
    return state


GROUPS = st.lists(st.lists(st.floats(-1e6, 1e6, width=32), min_size=1, max_size=30), min_size=1, max_size=8)


@settings(max_examples=80, deadline=None)
@given(GROUPS, st.sampled_from([4, 30]))
def test_packed_groups_are_the_states(groups, k):
    groups = [g[:ReqState.first_capacity(k) - 1] for g in groups]
    sizes = np.array([len(g) for g in groups])
    packed = SmallReq(k).pack(np.array(sum(groups, []), dtype=np.float32), np.cumsum(sizes) - sizes)
    assert packed.to_pylist() == [state_of(g, k).to_bytes() for g in groups]


@settings(max_examples=80, deadline=None)
@given(st.lists(GROUPS, min_size=1, max_size=5), st.integers(0, 3), st.sampled_from([4, 30]))
def test_joined_groups_are_the_merged_states(parts, skipped, k):
    """Each group's states in order; those that were or would be compacted are left alone."""
    blobs = [[state_of(values, k).to_bytes() for values in group] for group in parts]
    flat = pa.array([b"pad!"] * skipped + sum(blobs, []), pa.binary()).slice(skipped)
    sizes = np.array([len(b) for b in blobs])
    merged, done = SmallReq().join(flat, np.cumsum(sizes) - sizes)
    want, expected = [], []
    for group in parts:
        n = sum(map(len, group))
        expected.append(n < ReqState.first_capacity(k))
        if expected[-1]:
            total = state_of(group[0], k)
            for values in group[1:]:
                total.merge(state_of(values, k))
            want.append(total.to_bytes())
    assert done.tolist() == expected
    assert merged.to_pylist() == want


def test_groups_of_other_shapes_are_left_to_the_states():
    empty, other = ReqState(30).to_bytes(), state_of([1.0], 4).to_bytes()
    mixed = pa.array([state_of([1.0], 30).to_bytes(), other, empty, state_of([2.0], 30).to_bytes()])
    merged, done = SmallReq().join(mixed, np.array([0, 2, 3]))
    assert done.tolist() == [False, False, True] and merged.to_pylist() == [mixed[3].as_py()]


@pytest.mark.parametrize("key", ["number", "text", "double", "pair"])
def test_a_build_with_and_without_the_small_form(spark, monkeypatch, key):
    """Many groups of one to a few values and one of a third of all rows; NULL and NaN keys."""
    plain = {
        "number": F.expr("IF(id % 7 = 3, NULL, id % 9000)"),
        "text": F.expr("IF(id % 7 = 3, NULL, concat('g', id % 9000))"),
        "double": F.expr("CASE WHEN id % 7 = 3 THEN double('NaN') WHEN id % 7 = 4 THEN -0D "
                         "WHEN id % 7 = 5 THEN NULL ELSE double(id % 9000) END"),
        "pair": F.expr("IF(id % 3 = 0, 0, id % 9000)")}[key]
    keys = ["g", "h"] if key == "pair" else ["g"]
    rows = spark.range(0, 60_000, 1, 4).select(
        plain.alias("g"), F.expr("IF(id % 5 = 0, NULL, 'h')").alias("h"),
        F.pmod(F.xxhash64("id"), F.lit(10_000)).cast("double").alias("v"))

    def built(form, joins):
        partial = tasks.reduce_tasks(rows.select(*keys, F.col("v").cast("float").alias("_v")), keys, "_v",
                                     lambda: ReqState(30), form)
        merged = tasks.merge_states(partial, keys, ReqState.from_bytes, small=joins)
        found = {tuple(str(x) for x in r[:-1]): ReqState.from_bytes(bytes(r.sketch))
                 for r in merged.select(*keys, "sketch").collect()}
        return found, partial.agg(F.max("seq")).first()[0]

    by_states, last = built(None, None)
    assert last == 0
    monkeypatch.setattr(tasks, "MAX_STATES", 100)
    # The packed groups of a buffer are handed on first, the states of large ones after them.
    by_columns, last = built(SmallReq(30), SmallReq())
    assert last == 1
    assert by_states.keys() == by_columns.keys()
    for name, a in by_states.items():
        b = by_columns[name]
        assert (a.n, a.lo, a.hi) == (b.n, b.lo, b.hi)
        if a.n < ReqState.first_capacity(30):
            assert sorted(a.items[0]) == sorted(b.items[0])
    assert req.req_quantiles(req.req_build(rows, "v", keys), keys).count() == len(by_states)


CODES = st.lists(st.lists(st.integers(-9, 9), min_size=1, max_size=8), min_size=1, max_size=6)


def buckets_of(codes, bound):
    state = BucketState(bound)
    state.add(np.array(codes, dtype=np.int64) * 1000)
    return state


@settings(max_examples=80, deadline=None)
@given(CODES)
def test_packed_bucket_groups_are_the_states(groups):
    sizes = np.array([len(g) for g in groups])
    packed = SmallBuckets(8).pack(np.array(sum(groups, []), dtype=np.int64) * 1000,
                                  np.cumsum(sizes) - sizes)
    assert packed.to_pylist() == [buckets_of(g, 8).to_bytes() for g in groups]


@settings(max_examples=80, deadline=None)
@given(st.lists(CODES, min_size=1, max_size=5), st.sampled_from([4, 12]))
def test_joined_bucket_groups_are_the_merged_states(parts, bound):
    made = [[buckets_of(codes, bound) for codes in group] for group in parts]
    flat = pa.array([s.to_bytes() for group in made for s in group], pa.binary())
    sizes = np.array([len(group) for group in made])
    merged, done = SmallBuckets().join(flat, np.cumsum(sizes) - sizes)
    fits = [all(s.level == 0 for s in group) and sum(len(s.codes) for s in group) <= bound
            for group in made]
    want = []
    for group in (g for g, few in zip(made, fits) if few):
        for other in group[1:]:
            group[0].merge(other)
        want.append(group[0].to_bytes())
    assert done.tolist() == fits and merged.to_pylist() == want


def test_uniform_buckets_of_many_groups(spark, monkeypatch):
    rows = spark.range(0, 40_000, 1, 4).selectExpr(
        "IF(id % 3 = 0, NULL, id % 9000) AS g", "double(pmod(xxhash64(id), 20000) - 9000) AS v")
    want = buckets.udds_build(rows, "v", ["g"], max_buckets=64).collect()
    monkeypatch.setattr(tasks, "MAX_STATES", 100)
    got = buckets.udds_build(rows, "v", ["g"], max_buckets=64).collect()
    assert len(want) > 20_000 and sorted(map(str, got)) == sorted(map(str, want))
