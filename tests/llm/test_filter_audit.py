"""The filter audit against a plain simulation of every order."""

import re
from itertools import permutations

import pytest

from rankflow.llm import filter_audit

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest int, alone string"


def fails(text, doc_id, rows):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = set()
    if len(words) < 50:
        found.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        found.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
        found.add("C")
    if re.search(r"[#$%&*|]", text):
        found.add("D")
    if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, *_ in rows):
        found.add("E")
    return found


def plain(rows, labels):
    parts = {}
    for doc_id, text, _, source, *_ in rows:
        mine = [x for x in labels if x[0] == doc_id and doc_id is not None]
        parts.setdefault(source or "", []).append(
            (fails(text or "", doc_id, rows), any(q == 1 for _, q, _ in mine), any(t == 1 for *_, t in mine)))
    want = {}
    for part, docs in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            live = docs
            for n, letter in enumerate(order):
                out = [d for d in live if letter in d[0]]
                kept = [d for d in live if letter not in d[0]]
                shapley[letter] += len(out)
                want[part, "".join(order), n + 1] = [
                    len(kept), len(out), sum(letter in d[0] for d in docs) - len(out),
                    sum(d[0] == {letter} for d in docs), sum(d[1] for d in out), sum(d[2] for d in out)]
                live = kept
        for (p, order, step), row in want.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return want


LONG = " ".join(f"word{i}" for i in range(80))


def many_rows():
    rows = [(1, LONG, "en", "a"), (2, LONG, "en", "b"), (2, LONG, "en", "b"), (0, LONG.upper(), "en", "a"),
            (3, "short", None, None), (4, None, "en", ""), (5, "", "de", "a"), (None, LONG, "en", "a"),
            (None, None, None, None), (6, LONG + " 5%", "en", "a"), (7, "one two " * 60, "en", "a"),
            (8, "Ä" * 30 + "AB", "en", "b"), (9, "x\x0bY\x0cz\xa0w " * 70, "en", "c"),
            (10, " ".join(f"k{i}" for i in range(200_000)), "en", "c")]
    rows += [(100 + i, "the same # text", "en", "hot") for i in range(50)]
    return [(*r, 0, i, "clash") for i, r in enumerate(rows)]


LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (0, None, None), (3, 1, 1), (100, 1, 1), (None, 1, 1), (10, 1, 0)]


def test_equals_a_simulation(spark):
    rows = many_rows()
    got = filter_audit.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(
        LABELS, "doc_id bigint, quality int, toxic int")).collect()
    want = plain(rows, LABELS)
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == want
    assert len(got) == len(want) == 600 * 5


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], DOCS), labels).count() == 0
    alone = filter_audit.audit(spark.createDataFrame(many_rows()[:1], DOCS), labels).collect()
    assert len(alone) == 600 and not any(r.good_lost or r.toxic_lost for r in alone)


def test_fields_never_run_over():
    total = filter_audit.PartSum(filter_audit.wide_masks())
    most = (1 << 63) - 1
    for mask in (0, 31):
        total.add(mask, True, True, most if mask else 0)
    batch = total.rows("x").to_pydict()
    for order, step, kept, removed, redundant in zip(*[batch[c] for c in (
            "filter_order", "step", "kept", "removed", "redundant")]):
        assert (kept, removed, redundant) == ((0, most, 0) if step == 1 else (0, 0, most)), order


@pytest.mark.parametrize("mask", range(32))
def test_every_mask_unpacks_to_its_outcomes(mask):
    wide = filter_audit.wide_masks()[mask]
    for name in filter_audit.OUTCOMES:
        fields = filter_audit.unpack(5 * wide[name])
        for n, (order, step) in enumerate(filter_audit.STEPS):
            assert fields[n] == 5 * (name in filter_audit.outcome(mask, order, step))
