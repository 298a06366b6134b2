"""Personal data against a plain-Python scan."""

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rankflow.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    spans = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            found, digits = m.group(), re.sub("[^0-9]", "", m.group())
            ok = {"email": True,
                  "ip": kind != "ip" or all(int(x) <= 255 for x in found.split(".")),
                  "card": 13 <= len(digits) <= 19 and luhn(digits),
                  "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                spans.append((kind, m.start(), m.end()))
    return spans


def check(spark, texts):
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.pii_digest(df).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        spans = brute(text)
        want = ",".join(":".join(map(str, s)) for s in spans)
        assert got[i].spans == want or got[i].spans.startswith(want), (text, got[i].spans, want)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        for kind in PLAIN:
            assert got[i][f"n_{kind}"] == sum(s[0] == kind for s in spans)


CASES = [
    None, "", " ", "no data here", "a@b.c_x@y.z", "a@b.c.@d.e", "x@y", "a@b..c", "é@b.cd ñ a@b.cd",
    "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "0001.002.3.255", "4111 1111 1111 1111",
    "4111-1111-1111-1112", "4111111111111111 4111111111111111", "12345678901234567890123",
    "+1 (743) 555-3824.", "+1 2", "+123456789012345 +1234567890123456", "call +49 30 1234567 now",
    "😀 mail me: joe@example.org 😀 +1 (743) 555-3824", "1-2-3-4 1 2 3", "." * 50, "a" * 5000,
    "9" * 5000, "a@" + "b." * 4000 + "c", "1.2.3.4 " * 300, "x+y@z.w+1@q.r",
]


def test_base_spans_equal_plain_scan(spark):
    check(spark, CASES)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="a1@.+- ()_é9😀\n", max_size=60), min_size=20, max_size=40))
def test_random_texts(spark, texts):
    check(spark, texts)


def test_added_kinds_need_checksum_or_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 ok", "DE88370400440532013000", "call (743) 555-3824",
             "take (743) 555-3824", "GB82WEST12345698765432"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {r.doc_id: r for r in pii.pii_digest(df).collect()}
    assert rows[0].spans == "iban:5:32" and rows[1].n_iban == 0 and rows[4].n_iban == 1
    assert rows[2].n_local == 1 and rows[3].n_local == 0


def test_context_word_before_several_numbers(spark):
    texts = ["Phone: 212-555-0142 or 212-555-0143", "😀 212-555-0142, 212-555-0143 (fax)",
             "Phone: 212-555-0142" + " and so on" * 4 + " 212-555-0143", "212-555-0142 or 212-555-0143"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {r.doc_id: r.spans for r in pii.pii_digest(df).collect()}
    assert rows == {0: "local:7:19,local:23:35", 1: "local:2:14,local:16:28", 2: "local:7:19", 3: ""}
    masked = dict(pii.mask_pii(pii.find_pii(df)).select("doc_id", "text").collect())
    assert masked[0] == "Phone: <LOCAL> or <LOCAL>"


def test_account_numbers_end_with_their_country(spark):
    es, be = "ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034"
    texts = [f"{es} EUR 500", f"{be} BIC GKCCBEBB", f"{be} {be}", f"{be.replace(' ', '')} 2024",
             f"ref XX12 3456 7890 {be}.", f"{es}.", f"{be}1", "SE45 5000 0000 0583 9825 7466 SWIFT",
             "NO93 8601 1117 947 NOK"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {r.doc_id: [s.text for s in r.found] for r in pii.find_pii(df).selectExpr(
        "doc_id", "transform(filter(pii, s -> s.kind = 'iban'), s -> struct(substr(text, int(s.start) + 1, "
        "int(s.end - s.start)) AS text)) AS found").collect()}
    assert rows == {0: [es], 1: [be], 2: [be, be], 3: [be.replace(" ", "")], 4: [be], 5: [es], 6: [],
                    7: [texts[7][:29]], 8: [texts[8][:18]]}


def test_masking(spark):
    texts = ["a@b.cd and 1.2.3.4", "clean", None, "", "+1 (743) 555-3824", "é 4111111111111111 é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = dict(pii.mask_pii(pii.find_pii(df)).select("doc_id", "text").collect())
    assert out == {0: "<EMAIL> and <IP>", 1: "clean", 2: None, 3: "", 4: "<PHONE>", 5: "é <CARD> é"}


def test_empty_table_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a@b.cd", "x"), (1, "a@b.cd", "x"), (None, "1.2.3.4", None)],
                               "doc_id bigint, text string, pii string")
    rows = pii.pii_digest(df).collect()
    assert sorted(r.spans for r in rows) == ["email:0:6", "email:0:6", "ip:0:7"]
    assert pii.pii_digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [300_000])
def test_very_long_text(spark, size):
    check(spark, ["word " * (size // 5) + "a@b.cd", "7 " * 1000, "+1" * 2000])


def test_a_megabyte_of_numbers(spark):
    numbers = [str(i * 7919 % 999_983) for i in range(120_000)]
    numbers[500::1000] = ["4111 1111 1111 1111"] * len(numbers[500::1000])
    text = "é " + ", ".join(numbers)
    assert len(text) > 900_000
    check(spark, [text, "1.2.3.4, " * 20_000])
