"""Approximate nearest neighbours: exact scores and order, recall against brute force."""

import numpy as np
import pytest

from rankflow.llm import neighbours, tiles

SCHEMA = "vec_id bigint, embedding array<double>, label int, dims string, rep int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v],
                                   0, "clash", 1) for i, v in rows], SCHEMA)


def sound(v):
    return v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)


def brute(rows, k=20):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and sound(list(v) if v is not None else None)]
    want = {}
    for n, (i, v) in enumerate(rows):
        if i % 20 == 0:
            near = sorted(((-float((v * w).sum()), j) for m, (j, w) in enumerate(rows) if m != n and len(w) == len(v)))
            want.setdefault(i, []).append([(j, -s) for s, j in near[:k]])
    return want


def run(spark, rows, **more):
    df = frame(spark, rows)
    got = neighbours.nearest(df, df.where("vec_id % 20 = 0"), **more)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    lists = {}
    for r in got.orderBy("query_id", "rank").collect():
        lists.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return lists


def test_all_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tiles, "OWNERS", 16)  # so that buckets are cut into parts
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 6)) for i in range(200)]  # many ties
    rows += [(300 + i, rng.integers(-3, 4, 3)) for i in range(30)]
    rows = [(i, v) for i, v in rows if np.any(v)]
    got, want = run(spark, rows, probe_share=1.0), brute(rows)
    assert set(got) == set(want)
    for i, lists in want.items():
        assert [x[1:] for x in got[i]] == lists[0]
        assert [x[0] for x in got[i]] == list(range(1, len(got[i]) + 1))


@pytest.mark.parametrize("kind", ["equal lengths", "other lengths"])
def test_recall(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "other lengths":
        x *= np.exp(rng.normal(0, .5, (len(x), 1)))
    rows = list(enumerate(x))
    got, want = run(spark, rows), brute(rows)
    hits = [len({j for _, j, _ in got[i]} & {j for j, _ in lists[0]}) for i, lists in want.items()]
    assert np.mean(hits) / 20 >= 0.9
    exact = dict(enumerate(x))
    for i, found in got.items():
        assert len(found) == 20
        for _, j, score in found:
            assert abs(score - float(exact[i] @ exact[j])) < 1e-12


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = neighbours.nearest(df, df.where("vec_id % 20 = 0"))
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    want = {i: {j for j, _ in lists[0]} for i, lists in brute(rows).items()}
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(found[i] & w) / len(w) for i, w in want.items()]) >= 0.9


def test_copies_ties_and_repeated_ids(spark):
    same = [1.0, 2.0, 0.0]
    rows = [(i, same) for i in range(60)] + [(20, same), (40, [0.0, 0.0, 1.0]), (100, [-0.0, 0.0, 5.0])]
    got = run(spark, rows)
    assert [j for _, j, _ in got[0][:20]] == [*range(1, 21)]
    # An id that stands twice is a candidate of itself.
    assert [j for r, j, _ in got[20] if r <= 3] == [0, 0, 1, 1, 2, 2]
    assert [(j, s) for _, j, s in got[100]][0] == (40, 5.0)


def test_odd_rows_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]),
            (6, [float("inf"), 1.0]), (None, [1.0, 0.0]), (7, [1.0]), (8, [-2.0, 3.0]), (20, None), (40, [2.0])]
    assert run(spark, rows) == {0: [(1, 8, -2.0)], 40: [(1, 7, 2.0)]}
    assert run(spark, rows[:1]) == {}
    assert run(spark, []) == {}


def test_a_query_that_finds_too_little_looks_at_everything(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(32)) for i in range(100)]
    got = run(spark, rows, tables=1, probe_share=0.001)
    assert all(len(v) == 20 for v in got.values()) and len(got) == 5


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).standard_normal((20, 10))
    turned = neighbours.turned(x, 3)
    assert turned.shape == (20, 16) and np.allclose((turned ** 2).sum(axis=1), 1)
    assert (neighbours.axes(turned, 5)[:, 0] == neighbours.axes(turned, 1)[:, 0]).all()
