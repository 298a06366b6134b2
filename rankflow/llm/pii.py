"""Personal data in texts: patterns propose, checksums confirm, context scores.

Built-in column functions only.  Positions are code points, ends are exclusive.

* Proposals are the leftmost, non-overlapping matches of a pattern per kind.
* Validators drop proposals: at most 255 per part of an ``ip``, Luhn for a
  ``card``, mod 97 for an ``iban``, the number of digits for a ``phone``.
* The score is the kind's own weight, plus ``CHECKED`` where a checksum was met,
  plus ``NEAR`` where a context word stands within ``WINDOW`` characters.  Kinds in
  ``BASE`` are kept at any score; the others need ``MIN_SCORE``.

NULL and empty texts have no spans.  Rows are neither dropped nor merged, so
repeated rows and ids give repeated results.  Only proposals that pass are located, by sums
over blocks of ``BLOCK`` proposals, so the cost of a text is close to linear in its proposals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns and the order of the kinds.  A possessive quantifier at
# the end of a pattern matches what the greedy one does, without recursion; the
# look-behinds only skip starts inside a run that has already failed.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "local")
# Characters of an account number by country, from the IBAN registry and, for countries that
# use the format without being in it, from practice.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK",
    21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL",
    24: "AD|CZ|DJ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "AO|CV|GW|LY|MZ|PT|ST", 26: "DZ|IR|IS|TR",
    27: "BI|CF|CG|CM|FR|GA|GQ|GR|IT|KM|MC|MG|MR|SM|TD",
    28: "AL|AZ|BF|BJ|BY|CI|CY|DO|GT|HN|HU|LB|MA|ML|NE|NI|PL|SN|SV|TG", 29: "BR|EG|PS|QA|UA",
    30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """As many characters as the country has; any number after a code that is not listed,
    up to where a listed head begins."""
    head = f"(?:{'|'.join(IBAN_LENGTHS.values())})[0-9]{{2}}"
    listed = [rf"(?:{codes})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}"
              + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, codes in IBAN_LENGTHS.items()]
    gap = rf"(?:\x20(?!{head}))?"
    other = (rf"(?!{head})[A-Z]{{2}}[0-9]{{2}}(?:{gap}[A-Z0-9]{{4}}){{2,7}}"
             rf"(?:{gap}[A-Z0-9]{{1,3}})?")
    return (rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join([*listed, other])})"
            "(?![A-Za-z0-9])")


PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban(),
    "local": r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
}
WEIGHTS = {"email": 0.8, "ip": 0.5, "card": 0.3, "phone": 0.6, "iban": 0.4, "local": 0.4}
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|whatsapp",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "local": "phone|tel|call|fax|mobile|whatsapp",
}
CHECKED, NEAR, WINDOW, MIN_SCORE = 0.4, 0.2, 40, 0.6
BLOCK = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def _luhn(digits: Column) -> Column:
    """Whether the digits pass: every second one from the right counts double."""
    places = F.sequence(F.lit(1), F.length(digits))
    kept = F.transform(places, lambda i: F.substring(F.reverse(digits), i, 1).cast("int"))
    parts = F.transform(kept, lambda d, i: F.when(i % 2 == 0, d).otherwise(
        F.when(d > 4, d * 2 - 9).otherwise(d * 2)))
    return F.aggregate(parts, F.lit(0), lambda a, d: a + d) % 10 == 0


def _mod97(code: Column) -> Column:
    """Whether an account number passes: letters are 10 to 35, the head goes last."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substring(code, 1, 4))
    chars = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.substring(turned, i, 1))
    rest = F.aggregate(
        chars, F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97)
        .otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return rest == 1


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        code = F.replace(found, F.lit(" "))
        return F.when(F.length(code).between(15, 34), _mod97(code)).otherwise(False)
    return F.lit(True)


def _spans(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind: ``array<struct<kind, start, end, score>>``."""
    pattern = PATTERNS[kind]

    # What stands beside a span is put together from the ends of the gaps and of other matches;
    # matches have two characters at least, so ``reach`` of them fill a window.
    reach = WINDOW // 2
    left, right = (lambda c: F.left(c, F.lit(WINDOW))), (lambda c: F.right(c, F.lit(WINDOW)))

    def with_ends(m: Column) -> Column:
        later = F.slice(m["gaps"], F.lit(2), F.size(m["found"]))
        before = F.slice(m["gaps"], F.lit(1), F.size(m["found"]))
        return F.struct(
            m["found"].alias("found"), m["gaps"].alias("gaps"),
            F.zip_with(before, m["found"], lambda gap, x: F.length(gap) + F.length(x)).alias("sizes"),
            F.zip_with(before, m["found"],
                       lambda gap, x: right(F.concat(right(gap), x))).alias("tails"),
            F.zip_with(m["found"], later, lambda x, gap: left(F.concat(x, left(gap)))).alias("heads"))

    def total(sizes: Column, first: Column, n: Column) -> Column:
        return F.aggregate(F.slice(sizes, first + 1, n), F.lit(0), lambda a, size: a + size)

    def with_blocks(m: Column) -> Column:
        """Adds the place where each block of proposals begins."""
        blocks = F.sequence(F.lit(0), F.floor(F.size(m["found"]) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: total(m["sizes"], b * BLOCK, F.lit(BLOCK)))
        return _let(sums, lambda s: F.struct(
            *[m[name].alias(name) for name in ("found", "gaps", "sizes", "tails", "heads")],
            F.transform(s, lambda _, b: total(s, F.lit(0), b)).alias("places")))

    def located(m: Column) -> Column:
        found, gaps = m["found"], m["gaps"]

        def one(x: Column, i: Column) -> Column:
            start = (m["places"][F.floor(i / BLOCK).cast("int")] + F.length(gaps[i])
                     + total(m["sizes"], i - i % BLOCK, i % BLOCK))
            earlier = F.slice(m["tails"], F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)))
            later = F.slice(m["heads"], i + 2, F.lit(reach))
            around = F.lower(F.concat_ws(
                " ", right(F.concat(F.array_join(earlier, ""), right(gaps[i]))),
                left(F.concat(left(gaps[i + 1]), F.array_join(later, "")))))
            near = around.rlike(rf"\b(?:{CONTEXT[kind]})")
            score = WEIGHTS[kind] + (CHECKED if kind in ("card", "iban") else 0.0)
            return F.when(_valid(kind, x), F.struct(
                F.lit(kind).alias("kind"), start.cast("bigint").alias("start"),
                (start + F.length(x)).cast("bigint").alias("end"),
                F.round(F.least(F.lit(1.0), F.lit(score) + F.when(near, NEAR).otherwise(0.0)), 2)
                .alias("score")))

        return F.transform(found, one)

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
                     F.split(text, pattern, -1).alias("gaps"))
    return F.filter(_let(_let(_let(parts, with_ends), with_blocks), located), lambda s: s.isNotNull())


NO_SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with its spans in ``into``, by kind and then by start.

    A column that is already called ``into`` is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(NO_SPANS)
    numbers, mails = whole.rlike("[0-9]"), whole.contains("@")
    by_kind = {k: F.when(mails if k == "email" else numbers, _spans(k, whole)).otherwise(none)
               for k in (*BASE, *ADDED)}

    def settled(m: Column) -> Column:
        base = [m[k] for k in BASE]

        def extra(kind: str) -> Column:
            clear = lambda s: ~F.exists(F.flatten(F.array(*base)), lambda b: (
                b["start"] < s["end"]) & (s["start"] < b["end"]))
            return F.filter(m[kind], lambda s: (s["score"] >= MIN_SCORE) & clear(s))

        return F.concat(*base, *[extra(k) for k in ADDED])

    held = F.struct(*[c.alias(k) for k, c in by_kind.items()])
    return docs.withColumn(into, F.when(numbers | mails, _let(held, settled)).otherwise(none))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                     s["end"].cast("string"))))


def mask_pii(docs: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """``text`` with each span replaced by its kind, such as ``<EMAIL>``.

    Overlapping spans become one, named by the one that starts first.
    """
    ordered = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")

    def join(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["start"].alias("start"),
                         F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(done) > 0) & (s["start"] < F.try_element_at(done, F.lit(-1))["end"]),
                      F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))) \
            .otherwise(F.concat(done, F.array(s)))

    def cut(merged: Column) -> Column:
        before = lambda i: F.when(i > 0, merged[i - 1]["end"]).otherwise(F.lit(0))
        pieces = F.transform(merged, lambda s, i: F.concat(
            F.substr(F.col(text), (before(i) + 1).cast("int"), (s["start"] - before(i)).cast("int")),
            F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        tail = F.substr(F.col(text), (F.element_at(merged, -1)["end"] + 1).cast("int"))
        return F.concat(F.array_join(pieces, ""), tail)

    hidden = _let(F.aggregate(ordered, empty, join), cut)
    return docs.withColumn(text, F.when(F.size(spans) > 0, hidden).otherwise(F.col(text)))


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans per row of ``doc_id, text``."""
    found = find_pii(docs.select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [of_kind(k) for k in (*BASE, *ADDED)]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"),
                        span_text(F.col("pii")).alias("spans"))
