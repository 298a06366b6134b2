"""Fingerprints, embeddings and components against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rankflow.llm import embeddings, graph, simhash, tiles


def classes(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


# --- components ------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["chain", "star", "random", "loops"])
def test_components(spark, kind):
    rng = np.random.default_rng(5)
    pairs = {"chain": [(i, i + 1) for i in range(200)], "star": [(0, i) for i in range(1, 300)],
             "random": rng.integers(0, 400, (250, 2)).tolist(), "loops": [(3, 3), (4, 4)]}[kind]
    df = spark.createDataFrame([(int(a), int(b)) for a, b in pairs] + [(None, 1), (2, None)],
                               "u bigint, v bigint")
    got = {r.node: r.root for r in graph.components(df).collect()}
    nodes = sorted({int(x) for a, b in pairs if a != b for x in (a, b)})
    assert sorted(got) == nodes
    want = classes(500, [(int(a), int(b)) for a, b in pairs])
    for a in nodes:
        assert got[a] in nodes
        for b in nodes[:40]:
            assert (got[a] == got[b]) == (want[a] == want[b])


def test_components_of_no_links(spark):
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# --- SimHash ---------------------------------------------------------------------------


def plain_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or (
        [" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


TEXTS = ["a b c d e", "A B C d  e", "", None, " \n", "one", "one two", "ONE two", "é Ä ñ", "x " * 5000,
         "word", "a b c d e f g h i j k l m n o p q r s t u v w x y z", "ä\xa0b"]


def test_fingerprint_definition():
    for text in TEXTS:
        assert simhash.fingerprint(text) == plain_fingerprint(text), text


def test_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tiles, "OWNERS", 4)  # so that tiles are split
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words, 40))) for i in range(60)]
    for i in range(60, 200):
        base = rows[int(rng.integers(0, 60))][1].split()
        for _ in range(int(rng.integers(0, 3))):
            base[int(rng.integers(0, 40))] = str(rng.choice(words))
        rows.append((i, " ".join(base)))
    rows += [(1000 + i, t) for i, t in enumerate(TEXTS)] + [rows[0], (None, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    fps = [plain_fingerprint(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    group = classes(len(rows), near)
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None),
                    default=None) for g in set(group)}
    want = sorted(((rows[i][0], f"{fps[i]:016x}", least[group[i]]) for i in range(len(rows))), key=str)
    assert sorted(map(tuple, simhash.simhash_digest(df).collect()), key=str) == want

    kept = [r.doc_id for r in simhash.drop_near_copies(df).collect()]
    assert len(kept) == len(set(group)) and set(kept) == set(least.values())


def test_split_tiles_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(tiles, "OWNERS", 8)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 20, dtype=np.int64)
    fps = {int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 63, (40, 2))}
    fps = sorted(fps)
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp bigint"))
    at = {f: i for i, f in enumerate(fps)}
    found = [(at[r.u], at[r.v]) for r in links.collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in found)
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert classes(len(fps), found) == classes(len(fps), near)


def test_one_of_a_group_stays_with_all_columns(spark):
    rows = [(2, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (None, None, "z"),
            (None, "other words stand here", "q"), (None, "again other words than these", "q")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    out = simhash.drop_near_copies(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, "a b c d", "y"), *rows[3:]], key=str)
    assert simhash.drop_near_copies(df.limit(0)).count() == 0


# --- embeddings ------------------------------------------------------------------------


def plain_links(rows):
    good = []
    for i, (_, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append((i, np.array(v, dtype=np.float32).astype(float), label))
    pairs = []
    for a, (i, v, k) in enumerate(good):
        for j, w, m in good[:a]:
            if k == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                pairs.append((i, j))
    return pairs


def check_vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    pairs = plain_links(rows)
    links = np.bincount(np.array(pairs, dtype=int).ravel(), minlength=len(rows))
    group = classes(len(rows), pairs)
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None),
                    default=None) for g in set(group)}
    want = sorted(((rows[i][0], int(links[i]), least[group[i]], rows[i][0] == least[group[i]])
                   for i in range(len(rows))), key=str)
    got = embeddings.near_vectors(df)
    assert sorted(map(tuple, got.collect()), key=str) == want
    return len(pairs)


def vectors(n, dims, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(1, n // 6), dims))
    rows = []
    for i in range(n):
        v = centres[int(rng.integers(0, len(centres)))] + spread * rng.standard_normal(dims)
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(0, 3))))
    return rows


@pytest.mark.parametrize("dims,spread", [(64, 0.25), (64, 0.28), (10, 0.2), (3, 0.1), (1, 0.1)])
def test_vectors_equal_brute_force(spark, monkeypatch, dims, spread):
    monkeypatch.setattr(tiles, "OWNERS", 16)
    rows = vectors(250, dims, spread, dims)
    rows += [(500 + i, rows[0][1], rows[0][2]) for i in range(20)]
    rows += [(600, [2 * x for x in rows[1][1]], rows[1][2])]
    assert check_vectors(spark, rows) > 100


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], None), (3, None, 1), (4, [0.0, 0.0], 1), (5, [], 1),
            (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, 0.0, 0.0], 1),
            (1, [1.0, 0.0], 1), (None, [1.0, 0.1], 1), (12, [-1.0, 0.0], 1), (13, [-0.0, 5.0], 2),
            (14, [0.0, 5.0], 2)]
    check_vectors(spark, rows)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    assert embeddings.near_vectors(df.limit(0)).count() == 0
    clash = df.withColumns({"rep": F.lit("x"), "copies": F.lit(1), "first": F.lit(None)})
    assert embeddings.near_vectors(clash).count() == len(rows)
