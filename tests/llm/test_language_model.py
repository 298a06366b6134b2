"""Context-tree weighting against a recursion over whole texts."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rankflow.llm import language_model as lm
from rankflow.llm.words import pieces


def brute(rows, depth):
    """doc_id -> (n_tokens, n_known, base, score) by the definitions."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: [*filter(None, re.split("[\x20\x09-\x0d]+", lower(t))), None] for i, t in rows}
    count = Counter(w for i, ws in tokens.items() if not out(i) for w in ws)
    total, distinct = sum(count.values()), len(count)
    nodes = defaultdict(lambda: [0, 0])

    def steps(text):
        body = b"\0" * depth + lower(text).encode() + b"\0"
        for k in range(depth, len(body)):
            for i in range(8):
                yield body[k - depth:k], (i, body[k] >> (8 - i)), body[k] >> (7 - i) & 1

    for i, t in rows:
        if not out(i):
            for context, place, bit in steps(t):
                for d in range(depth + 1):
                    nodes[place, context[depth - d:]][bit] += 1

    def kt(a, b):
        return (math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1)
                - math.log(math.pi))

    children = defaultdict(list)
    for place, context in list(nodes):
        if context:
            children[place, context[1:]].append((place, context))

    def weighted(node):
        own = kt(*nodes[node])
        if len(node[1]) == depth:
            return own
        under = sum(weighted(c) for c in children[node])
        return np.logaddexp(own, under) - math.log(2)

    stops = {}
    for node in list(nodes):
        if len(node[1]) < depth:
            stops[node] = math.exp(kt(*nodes[node]) - math.log(2) - weighted(node))

    def probability(place, context, bit, d):
        node = (place, context[depth - d:])
        a = nodes.get(node, (0, 0))
        p = (a[bit] + .5) / (sum(a) + 1)
        if d == depth:
            return p
        stop = stops.get(node, .5)
        return stop * p + (1 - stop) * probability(place, context, bit, d + 1)

    result = {}
    for i, t in rows:
        score = sum(math.log10(probability(p, c, b, 0)) for c, p, b in steps(t))
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in tokens[i])
        result[i] = (len(tokens[i]), sum(count[w] > 0 for w in tokens[i]), base, score)
    return result, total


TEXTS = ["The cat sat on the mat", "the dog sat", "", None, "A cat, a dog\nand\ta mat", "é ñ 😀",
         "the the the the", "abab" * 20, "x", " ", "the cat sat on the mat", "zebra quagga", "a\0b"]


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 4])
def test_scores_equal_recursion(spark, depth):
    rows = list(enumerate(TEXTS))
    want, total = brute(rows, depth)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = lm.score_documents(df, depth=depth, block_bytes=60).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-9)
        assert r.score == pytest.approx(score, abs=1e-8)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)


def test_probabilities_of_a_byte_sum_to_one():
    grams = np.array([(x << 8) | y for x in (97, 98, 99) for y in range(256)], dtype=np.int64)
    n = np.random.default_rng(3).integers(0, 5, len(grams))
    total = np.zeros(len(grams))
    for bit in range(8):
        total += np.log(lm.Subtree(grams, n, bit, 1, 0).probabilities(1, 0))
    assert np.exp(total).reshape(3, 256).sum(axis=1) == pytest.approx([1, 1, 1])


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.25, 1e3, 1e9])
    assert lm.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-13, abs=1e-12)


def test_repeats_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b", "x"), (None, "a b", "y"), (3, None, None)],
                               "doc_id bigint, text string, score string")
    rows = lm.score_documents(df).collect()
    assert len(rows) == 3 and not any(r.held_out for r in rows if r.doc_id is None)
    assert {r.train_tokens for r in rows} == {6 if zlib.crc32(b"3") % 7 == 2 else 7}
    assert lm.score_documents(df.limit(0)).count() == 0


def test_often_repeated_rows_are_in_a_block_once(spark, monkeypatch):
    rows = [*enumerate(TEXTS), *[(1, TEXTS[1])] * 150, *[(None, "copies without an id")] * 150]
    sizes, asked = [], lm._asked

    def watched(dealt, depth):
        sizes.append(dict(dealt.groupBy("block").count().collect()))
        return asked(dealt, depth)

    monkeypatch.setattr(lm, "_asked", watched)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = lm.score_documents(df, depth=2, block_bytes=100).collect()
    assert sum(sizes[0].values()) == len(TEXTS) + 1
    plain = lm.score_documents(df, depth=2).collect()
    assert len(sizes) == 2 and sum(sizes[1].values()) == len(rows)
    order = lambda found: sorted(found, key=lambda r: (r.doc_id is None, r.doc_id))
    assert len(got) == len(plain) == len(rows)
    for a, b in zip(order(got), order(plain)):
        assert a[:5] == b[:5] and a.n_bytes == b.n_bytes
        assert (a.base_score, a.score) == pytest.approx((b.base_score, b.score), abs=1e-9)


def test_texts_of_blocks_are_read_once_for_words_and_grams(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    plan = lm.score_documents(df, depth=2)._jdf.queryExecution().optimizedPlan().toString()
    # What is left is the trees' values and the meeting of documents and answers.
    assert plan.count("FlatMapGroupsInArrow") == 1 and plan.count("FlatMapCoGroupsInArrow") == 1


def test_trees_in_shards_of_any_size_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    rows = lm.score_documents(df).orderBy("doc_id").collect()
    monkeypatch.setattr(lm, "TREE_GRAMS", 20)
    for a, b in zip(rows, lm.score_documents(df).orderBy("doc_id").collect(), strict=True):
        assert a[:6] == b[:6] and a.score == pytest.approx(b.score, abs=1e-9)


def test_words_of_pieces_are_those_of_split(monkeypatch):
    texts = ["", None, "  A b\x0b\x0cC\n", "x", " ", "\x1ca\x85 \u3000é", "a\0b "] * 3
    for limit in (1, 9, 1 << 21):
        monkeypatch.setattr(lm, "pieces", lambda at, limit=limit: pieces(at, limit))
        got = [words.slice(a, b - a).to_pylist() for _, words, cuts in lm.word_rows(pa.array(texts[1:]).slice(1))
               for a, b in zip(cuts, cuts[1:])]
        assert got == [(t or "").encode().lower().split() for t in texts[2:]]
