"""Greedy string tiling against a plain version, and planted passages."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankflow.llm import decontaminate as dc
from rankflow.llm.words import hashed_words


def words(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())


def plain_tiles(a, b, least):
    used_a, used_b, done = [False] * len(a), [False] * len(b), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while (i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]
                       and not used_a[i + n] and not used_b[j + n]):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return done
        done.append((i, j, n))
        used_a[i:i + n] = [True] * n
        used_b[j:j + n] = [True] * n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=40),
       st.integers(2, 5))
def test_tiles_equal_plain_version(a, b, least):
    got = dc.tiles(np.array(a, dtype=np.uint64) if a else np.zeros(0, np.uint64),
                   np.array(b, dtype=np.uint64) if b else np.zeros(0, np.uint64), least)
    assert got == plain_tiles(a, b, least)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB1é ,\n", max_size=15)), max_size=8))
def test_words_of_columns(texts):
    seen, rows = {}, []
    for first, hashes, cut in hashed_words(pa.array(texts, pa.string())):
        assert first == len(rows)
        rows += [hashes[x:y].tolist() for x, y in zip(cut[:-1], cut[1:])]
    assert [len(r) for r in rows] == [len(words(t)) for t in texts]
    for t, hashes in zip(texts, rows):
        for w, h in zip(words(t), hashes):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [(1, PASSAGE), (2, "some other benchmark passage of nine plain words here"), (3, "too short here"),
         (4, None), (None, "an item whose own id is not known at all"), (2, PASSAGE + " nu xi omicron"),
         (7, "")]
DOCS = [
    (1, "before " + PASSAGE + " after"), (2, "eta theta iota kappa lambda mu, ALPHA beta gamma delta epsilon zeta!"),
    (3, "alpha beta gamma delta epsilon and nothing more"), (4, None), (5, ""), (6, "too short here"),
    (7, "Some other benchmark passage -- of nine plain words, here."), (1, "before " + PASSAGE + " after"),
    (None, PASSAGE), (9, "an item whose own id is not known at all"), (10, "clean " * 20000),
    (11, "x " * 3000 + PASSAGE + " y" * 3000),
]


def plain_coverage(text):
    found = [(sum(n for *_, n in plain_tiles(words(t), words(text), 5)) / len(words(t)), i)
             for i, t in ITEMS if len(words(t)) >= 5]
    return max((c for c, _ in found), default=0.0)


def test_planted_passages(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in DOCS], "doc_id bigint, text string, key string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = dc.mark_contaminated(docs, items).collect()
    assert len(got) == len(DOCS)
    flags = {(r.doc_id, r.contaminated) for r in got}
    assert flags == {(1, True), (2, True), (3, False), (4, False), (5, False), (6, False), (7, True),
                     (None, True), (9, True), (10, False), (11, True)}
    cover = {r.doc_id: r.coverage for r in got}
    for i, t in DOCS[:9]:
        assert cover[i] == pytest.approx(plain_coverage(t), abs=1e-6)
    kept = dc.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 10]


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert dc.mark_contaminated(docs.limit(0), items).count() == 0
    assert not any(r.contaminated for r in dc.mark_contaminated(docs, items.limit(0)).collect())


def test_tiles_of_a_long_text_with_many_parts_of_an_item():
    """60 parts of an item in 200,000 words, and an item repeated to that length."""
    rng = np.random.default_rng(1)
    vocabulary = rng.integers(1, 2**63, 5000).astype(np.uint64)
    item = vocabulary[rng.integers(0, 5000, 360)]
    text = vocabulary[rng.integers(0, 5000, 200_000)]
    for k in range(60):
        text[3000 * k + 7:3000 * k + 13] = item[6 * k:6 * k + 6]
    got = dc.tiles(item, text)
    assert sorted((i, j) for i, j, _ in got) == [(6 * k, 3000 * k + 7) for k in range(60)]
    assert dc.tiles(item, np.tile(item, 556)) == [(0, 0, 360)]
