"""The Merkle manifest against a plain tree in memory."""

import zlib
from hashlib import sha256

import pytest

from rankflow.llm import merkle

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree int, pos string, size int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, extra=0):
    doc_id, text, lang, source, n = row[:5]
    n = None if n is None else n + extra
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n, text)])


def tree(nodes):
    """The top, and for every leaf its siblings upwards as ``(sibling is left, digests)``."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 2] for i in range(0, len(nodes), 2)]
        for n, i in enumerate(at):
            ways[n].append((i % 2 == 1, runs[i // 2][1 - i % 2:][:1] if len(runs[i // 2]) == 2 else []))
        nodes, at = [h(*run) for run in runs], [i // 2 for i in at]
    return nodes[0], ways


def fold(value, way):
    for left, other in way:
        value = h(*other, value) if left else h(value, *other)
    return value


def plain(rows):
    if not rows:
        return []
    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append(row)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    out, subroots = [], []
    for lang in order:
        own = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, ways = tree([leaf(r) for r in own])
        subroots.append(top)
        out.append((own, ways))
    root, above = tree(subroots)
    result = []
    for n, (own, ways) in enumerate(out):
        for row, way in zip(own, ways):
            way = way + above[n]
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            folded = fold(leaf(row, int(hit)), way)
            result.append((row[0], leaf(row), subroots[n], root, h(*[d for _, o in way for d in o]), folded,
                           folded == root))
    return sorted(result, key=str)


def run(spark, rows):
    got = merkle.manifest(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOCS))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=str)


def docs(n, lang):
    return [(i * 3 + len(lang or ""), f"text {i}", lang, "s", i) for i in range(n)]


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_equals_a_plain_tree(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BLOCK_BITS", bits)
    rows = docs(37, "en") + docs(8, None) + docs(1, "de") + docs(9, "é") + docs(5, "") + docs(2, "zz")
    assert run(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (7, None, "en", None, None), (7, "", "en", "", 0),
            (7, "", "en", "", 0), (7, "x", "en", "", 0), (None, "a", "en", "s", 1), (-5, "ä€𝄞", "en", "s", 3),
            (1, "long " * 400_000, "en", "s", 9), (2, "t", "en", "s", (1 << 63) - 1)]
    rows += [(3, "same", "en", "s", 1)] * 6
    assert run(spark, rows) == plain(rows)


def test_tampering_is_seen_exactly_where_it_happens(spark):
    rows = docs(300, "en") + docs(40, "de")
    for row in merkle.manifest(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOCS)).collect():
        assert row.verified == (zlib.crc32(str(row.doc_id).encode()) % 7 != 0)


def test_empty_and_single(spark):
    assert run(spark, []) == []
    one = [(3, "t", "en", "s", 1)]
    assert run(spark, one) == plain(one)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 64, 100])
def test_sweeps_of_a_block(n):
    leaves = [h(str(i)) for i in range(n)]
    levels = (n - 1).bit_length()
    top, parents = merkle.sweep_up([x.encode() for x in leaves], levels)
    want, ways = tree(leaves)
    assert top.decode() == want
    assert [p[0] for p in parents] == sorted(p[0] for p in parents)
    for leaf_, path, way in zip(leaves, merkle.sweep_down(n, parents, b""), ways):
        assert merkle.fold(leaf_.encode(), path).decode() == want
        assert merkle.siblings(path).decode() == "".join(d for _, o in way for d in o)
