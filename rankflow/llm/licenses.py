"""License scan: Dice similarity of word bigrams between texts and licence templates.

Each text is looked at as a whole, in blocks (between blank lines) and line by line; a block
or text that is just one line is not looked at twice.  A unit is put in lower case, its
copyright lines are taken out, and all but ASCII letters and digits become spaces.  A unit
and a template match if the Dice coefficient of their *sets* of word bigrams,
``2 |A & B| / (|A| + |B|)``, is at least ``MIN_DICE``.  As ``|A & B|`` is at most the smaller
set, only sizes between ``|B| t / (2 - t)`` and ``|B| (2 - t) / t`` can match: the templates are
joined on the admissible sizes, and no other pair is compared.

A licence need not be a unit: it may span paragraphs of a larger text, stand inside a line or
follow a copyright notice.  So runs of words are looked at, too, whatever the line ends are and
with copyright lines in, but not inside units that match.  A run begins where a stretch of
bigrams of the template begins and ends where one ends, as adding a bigram of the template never
lowers the Dice coefficient.  It has as many bigrams, repeats counted, as its set may have at
most, and at least ``|B| t / (2 - t)`` of the template's, so only texts, and starts, that have as
many ahead are looked at.  From left to right, the best of the runs that begin inside the first
one is kept, the earlier one on ties, and those that overlap it are left out, by licence.

Built-in functions only.  The templates are a fixed list (``TEMPLATES``), so their table and the
sizes that it admits are bounded and broadcast.  NULL texts, empty ones and units of under two
words match nothing.  Repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_DICE = 0.8

_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met: 1. Redistributions of source code "
    "must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. ")
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written "
    "permission. ")
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS "
    "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND "
    "ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
    "THE POSSIBILITY OF SUCH DAMAGE.")

# Published licence texts and the usual notices, as (licence, template, text).
TEMPLATES = (
    ("MIT", "text",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
     "and associated documentation files (the \"Software\"), to deal in the Software without "
     "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
     "Software is furnished to do so, subject to the following conditions: The above copyright "
     "notice and this permission notice shall be included in all copies or substantial portions of "
     "the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
     "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
     "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
     "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
     "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
     "DEALINGS IN THE SOFTWARE."),
    ("MIT", "released", "Released under the MIT License."),
    ("MIT", "licensed", "Licensed under the MIT License."),
    ("MIT", "project", "This project is licensed under the MIT License."),
    ("ISC", "text",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
     "without fee is hereby granted, provided that the above copyright notice and this permission "
     "notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
     "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
     "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
     "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
     "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
     "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "text", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", "text", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "notice",
     "Use of this source code is governed by a BSD-style license that can be found in the LICENSE "
     "file."),
    ("Apache-2.0", "header",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
     "except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
     "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
     "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
     "specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "licensed", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "released", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "header",
     "This program is free software: you can redistribute it and/or modify it under the terms of "
     "the GNU General Public License as published by the Free Software Foundation, either version 3 "
     "of the License, or (at your option) any later version. This program is distributed in the "
     "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
     "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
     "more details."),
    ("GPL-3.0", "work", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "licensed", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "work", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "work",
     "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "header",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
     "of the MPL was not distributed with this file, You can obtain one at "
     "http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "opening",
     "This is free and unencumbered software released into the public domain. Anyone is free to "
     "copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
     "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "work",
     "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "short", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "work",
     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
     "License."),
    ("CC-BY-SA-4.0", "short", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "work",
     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
     "License."),
    ("CC-BY-NC-4.0", "short", "Licensed under CC BY-NC 4.0."),
)

COPYRIGHT_LINE = r"^[ \t]*(?:copyright|\(c\))"
BLANK_LINE = r"\n[ \t]*\n"
_WORD = "[a-z0-9]+"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def words_of(part: Column) -> Column:
    """The words of a part in lower case."""
    return F.regexp_extract_all(part, F.lit(_WORD), F.lit(0))


def line_words(line: Column) -> Column:
    """The words of one line in lower case; a copyright line has none."""
    return F.when(line.rlike(COPYRIGHT_LINE), F.array().cast("array<string>")).otherwise(words_of(line))


def bigrams(words: Column) -> Column:
    """The neighbouring pairs of an array of words, as 64-bit hashes."""
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    heads, tails = F.slice(words, F.lit(1), pairs), F.slice(words, F.lit(2), pairs)
    return F.zip_with(heads, tails, lambda a, b: F.xxhash64(a, b))


def bigram_set(words: Column) -> Column:
    return F.array_distinct(bigrams(words))


def _admissible(size: int, min_dice: float) -> tuple[int, int]:
    """Sizes that a set must have to match one of ``size``."""
    low, high = size * min_dice / (2 - min_dice), size * (2 - min_dice) / min_dice
    return max(1, math.ceil(low - 1e-9)), math.floor(high + 1e-9)


def template_sizes() -> list[int]:
    """The number of distinct bigrams of each template."""
    found = [re.findall(_WORD, body.lower()) for _, _, body in TEMPLATES]
    return [len(set(zip(words, words[1:]))) for words in found]


def template_table(spark: SparkSession, min_dice: float) -> DataFrame:
    """``license, template, grams, own_size`` and a row for each admissible ``size``."""
    rows = [(*t, *_admissible(n, min_dice)) for t, n in zip(TEMPLATES, template_sizes())]
    raw = spark.createDataFrame(
        rows, "license string, template string, body string, low int, high int")
    sets = raw.withColumn("grams", bigram_set(line_words(F.lower("body"))))
    return sets.select("license", "template", "grams", F.size("grams").alias("own_size"),
                       F.explode(F.sequence("low", "high")).alias("size"))


def _least_shared(size: int, min_dice: float) -> int:
    """Bigrams of a template of ``size`` that anything matching it has."""
    return max(1, math.ceil(size * min_dice / (2 - min_dice) - 1e-9))


def template_grams() -> list[list[int]]:
    """The distinct bigrams of each template, as ``xxhash64`` hashes the two words."""
    def pair(a: str, b: str) -> int:
        h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
        return h - (1 << 64) if h >> 63 else h

    found = [re.findall(_WORD, body.lower()) for _, _, body in TEMPLATES]
    return [list(dict.fromkeys(pair(a, b) for a, b in zip(w, w[1:]))) for w in found]


def _template_array(min_dice: float) -> Column:
    """The templates as one constant: ``license, template, grams, size, need, low, high``."""
    def one(name: tuple[str, str, str], grams: list[int]) -> Column:
        low, high = _admissible(len(grams), min_dice)
        return F.struct(
            F.lit(name[0]).alias("license"), F.lit(name[1]).alias("template"),
            F.array(*map(F.lit, grams)).cast("array<bigint>").alias("grams"),
            F.lit(len(grams)).alias("size"), F.lit(_least_shared(len(grams), min_dice)).alias("need"),
            F.lit(low).alias("low"), F.lit(high).alias("high"))

    return F.array(*[one(t, g) for t, g in zip(TEMPLATES, template_grams())])


def _dice(grams: Column, of: Column) -> Column:
    both = F.size(F.array_intersect(grams, of["grams"]))
    return F.round(2.0 * both / (F.size(grams) + of["size"]), 6)


def _outside_units(body: Column, templates: Column, min_dice: float) -> Column:
    """The words of a text; those of units that match a template are empty."""
    def matches(words: Column) -> Column:
        return _let(bigram_set(words), lambda g: F.exists(templates, lambda t: F.when(
            F.size(g).between(t["low"], t["high"]), _dice(g, t) >= min_dice).otherwise(False)))

    def blank(part: Column) -> Column:
        return F.transform(words_of(part), lambda w: F.lit(""))

    def whole(part: Column) -> Column:
        kept = F.flatten(F.transform(F.split(part, "\n"), line_words))
        return F.when(part.contains("\n"), matches(kept)).otherwise(False)

    def of_line(line: Column) -> Column:
        return F.when(matches(line_words(line)), blank(line)).otherwise(words_of(line))

    def of_block(block: Column) -> Column:
        return F.when(whole(block), blank(block)).otherwise(
            F.flatten(F.transform(F.split(block, "\n"), of_line)))

    return F.when(whole(body), F.array().cast("array<string>")).otherwise(
        F.flatten(F.transform(F.split(body, BLANK_LINE), of_block)))


_RUN = "struct<start:int,cost:double,back:int,template:string>"


def _runs(grams: Column, hits: Column, of: Column, min_dice: float) -> Column:
    """The best run from each start, as ``license`` and ``run``; ``hits``: places of its bigrams."""
    starts = F.transform(hits, lambda p, i: F.when(
        F.coalesce(F.get(hits, i - 1) < p - 1, F.lit(True))
        & (F.get(hits, i + of["need"] - 1) - p < of["high"]), p))

    def best(ahead: Column) -> Column:
        def ends(inside: Column) -> Column:
            return F.transform(inside, lambda x, i: F.when(
                x & (i + 1 >= of["need"]) & ~F.coalesce(F.get(inside, i + 1), F.lit(False)), i + 1))

        lengths = _let(F.transform(ahead, lambda g: F.array_contains(of["grams"], g)), ends)
        return F.array_min(F.transform(F.filter(lengths, lambda n: n.isNotNull()), lambda n: F.struct(
            (-_dice(F.array_distinct(F.slice(ahead, F.lit(1), n)), of)).alias("cost"), n.alias("n"))))

    def run(start: Column) -> Column:
        return _let(_let(F.slice(grams, start + 1, of["high"]), best), lambda b: F.struct(
            of["license"].alias("license"), F.struct(
                start.alias("start"), b["cost"].alias("cost"), (-(start + b["n"] + 1)).alias("back"),
                of["template"].alias("template")).cast(_RUN).alias("run")))

    found = F.transform(F.filter(starts, lambda p: p.isNotNull()), run)
    return F.filter(found, lambda r: r["run"]["cost"] <= -min_dice)


def _sweep(runs: Column) -> Column:
    """The runs of one licence that are kept, of any."""
    start = F.struct(F.array().cast(f"array<{_RUN}>").alias("kept"),
                     F.lit(None).cast(_RUN).alias("best"), F.lit(0).alias("limit"))

    def state(kept: Column, best: Column, limit: Column) -> Column:
        return F.struct(kept.alias("kept"), best.alias("best"), limit.alias("limit"))

    def step(a: Column, r: Column) -> Column:
        best = a["best"]
        better = F.when(r["cost"] < best["cost"], r).otherwise(best)
        return (F.when(best.isNull(), state(a["kept"], r, -r["back"]))
                .when(r["start"] < a["limit"], state(a["kept"], better, a["limit"]))
                .when(r["start"] < -best["back"], a)
                .otherwise(state(F.concat(a["kept"], F.array(best)), r, -r["back"])))

    return F.aggregate(F.array_sort(runs), start, step,
                       lambda a: F.concat(a["kept"], F.array(a["best"])))


def scan_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
              min_dice: float = MIN_DICE) -> DataFrame:
    """The rows of ``scan_licenses`` for runs; ``position`` is the number of the first word."""
    templates = _template_array(min_dice)
    known = sorted({g for grams in template_grams() for g in grams})
    least = min(_least_shared(n, min_dice) for n in template_sizes())

    def enough(met: Column, t: Column) -> Column:
        return F.size(F.array_intersect(met, t["grams"])) >= t["need"]

    held = docs.where(F.col(text).isNotNull()).select(
        F.col(id_col).alias("_id"), F.lower(F.col(text)).alias("_body"))
    # One-element explodes keep arrays from being made once per use.
    met = held.select("_id", "_body", F.explode(F.array(F.array_distinct(F.filter(
        _let(words_of(F.col("_body")), bigrams), lambda g: g.isin(known))))).alias("_met")).where(
        F.size("_met") >= least).where(F.exists(templates, lambda t: enough(F.col("_met"), t)))
    grams = met.select("_id", "_met", F.explode(F.array(
        _let(_outside_units(F.col("_body"), templates, min_dice), bigrams))).alias("_g"))
    at = F.filter(F.transform("_g", lambda g, i: F.when(g.isin(known), i)), lambda i: i.isNotNull())
    placed = grams.select("_id", "_met", "_g", F.explode(F.array(at)).alias("_at")).where(
        F.size("_at") >= least)

    def of_template(t: Column) -> Column:
        hits = F.filter("_at", lambda p: F.array_contains(t["grams"], F.get("_g", p)))
        return _let(hits, lambda h: _runs(F.col("_g"), h, t, min_dice))

    found = F.flatten(F.transform(
        F.filter(templates, lambda t: enough(F.col("_met"), t)), of_template))
    runs = placed.select("_id", F.explode(F.array(found)).alias("_f")).where(F.size("_f") > 0)

    def of_license(name: Column) -> Column:
        own = F.transform(F.filter("_f", lambda f: f["license"] == name), lambda f: f["run"])
        return F.transform(_sweep(own), lambda r: F.struct(name.alias("license"), r.alias("run")))

    names = F.array_distinct(F.transform("_f", lambda f: f["license"]))
    return runs.select("_id", F.explode(F.flatten(F.transform(names, of_license))).alias("_r")).select(
        F.col("_id").alias(id_col), F.lit("run").alias("unit"),
        F.col("_r.run.start").cast("bigint").alias("position"), F.col("_r.license").alias("license"),
        F.col("_r.run.template").alias("template"), (-F.col("_r.run.cost")).alias("dice"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                  min_dice: float = MIN_DICE) -> DataFrame:
    """``id_col, unit, position, license, template, dice`` for each match.

    ``unit`` is text, block, line or run; ``position`` counts blocks, lines and, for runs,
    words from 0.
    """
    bounds = [_admissible(n, min_dice) for n in template_sizes()]
    least, most = min(a for a, _ in bounds), max(b for _, b in bounds)
    no_units = F.array().cast("array<struct<unit:string,position:bigint,words:array<string>>>")

    def by_line(part: Column) -> Column:
        return F.transform(F.split(part, "\n"), line_words)

    def unit(kind: str, position: Column, words: Column) -> Column:
        return F.struct(F.lit(kind).alias("unit"), position.cast("bigint").alias("position"),
                        words.alias("words"))

    # A one-element explode keeps the words of a text from being made once per use.
    body = F.lower(F.col(text))
    blocks = F.when(body.rlike(BLANK_LINE), F.transform(
        F.split(body, BLANK_LINE), lambda b, i: F.when(
            b.contains("\n"), unit("block", i, F.flatten(by_line(b))))))
    held = docs.where(F.col(text).isNotNull()).select(
        F.col(id_col).alias("_id"),
        F.explode(F.array(F.struct(by_line(body).alias("lines"), blocks.alias("blocks"))))
        .alias("_t")).select("_id", "_t.*")
    units = F.concat(
        F.transform("lines", lambda w, i: unit("line", i, w)),
        F.coalesce(F.filter("blocks", lambda u: u.isNotNull()), no_units),
        F.when(F.size("lines") > 1, F.array(unit("text", F.lit(0), F.flatten("lines"))))
        .otherwise(no_units))

    # No set is larger than its words allow, nor smaller than that of its opening words.
    def may_match(u: Column) -> Column:
        n = F.size(u["words"])
        opening = F.size(bigram_set(F.slice(u["words"], 1, most + 2)))
        return F.when(n <= least, False).when(n <= most + 1, True).otherwise(opening <= most)

    cut = held.select("_id", F.explode(F.filter(units, may_match)).alias("_u")).select("_id", "_u.*")
    grams = cut.select("_id", "unit", "position",
                       F.explode(F.array(bigram_set(F.col("words")))).alias("_grams"))
    table = template_table(docs.sparkSession, min_dice)
    both = F.size(F.array_intersect("_grams", "grams"))
    dice = F.round(2.0 * both / (F.col("size") + F.col("own_size")), 6)
    whole = grams.withColumn("size", F.size("_grams")).join(F.broadcast(table), "size").withColumn(
        "dice", dice).where(F.col("dice") >= min_dice).select(
        F.col("_id").alias(id_col), "unit", "position", "license", "template", "dice")
    return whole.unionByName(scan_runs(docs, id_col, text, min_dice))


def scan_sql(min_dice: float = MIN_DICE) -> str:
    """The same rows over ``documents`` in DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(a)}, {quote(b)}, {quote(c)})" for a, b, c in TEMPLATES)
    words = ("list_filter(string_split(regexp_replace(lower(regexp_replace({0}, "
             "'(?im)^[ \\t]*(?:copyright|\\(c\\)).*', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'), ' '), "
             "lambda w: w <> '')")
    pairs = "list_transform(range(1, greatest(len({0}), 1)), lambda i: {0}[i] || ' ' || {0}[i + 1])"
    grams = f"list_distinct({pairs})"
    plain = ("list_filter(string_split(regexp_replace({0}, '[^a-z0-9]+', ' ', 'g'), ' '), "
             "lambda w: w <> '')")
    low, high = (f"{op}(m * {x!r}::DOUBLE {e})" for op, x, e in (
        ("ceil", min_dice / (2 - min_dice), "- 1e-9"), ("floor", (2 - min_dice) / min_dice, "+ 1e-9")))
    dice = "round(2.0::DOUBLE * len(list_intersect({0}, t)) / (len({0}) + m), 6)"
    return f"""
WITH RECURSIVE templates AS (
  SELECT license, template, t, len(t) AS m FROM (
    SELECT license, template, {grams.format('w')} AS t FROM (
      SELECT license, template, {words.format('body')} AS w
      FROM (VALUES {rows}) v(license, template, body)))),
docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lower(text) AS text FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT rid, doc_id, 'line' AS unit, unnest(range(len(string_split(text, chr(10))))) AS position,
         unnest(string_split(text, chr(10))) AS body FROM docs
  UNION ALL
  SELECT * FROM (
    SELECT rid, doc_id, 'block', unnest(range(len(string_split_regex(text, '\\n[ \\t]*\\n')))),
           unnest(string_split_regex(text, '\\n[ \\t]*\\n')) AS body
    FROM docs WHERE len(string_split_regex(text, '\\n[ \\t]*\\n')) > 1)
  WHERE contains(body, chr(10))
  UNION ALL
  SELECT rid, doc_id, 'text', 0, text FROM docs WHERE contains(text, chr(10))),
sets AS (
  SELECT rid, doc_id, unit, position, body, {grams.format('w')} AS g
  FROM (SELECT *, {words.format('body')} AS w FROM units)),
whole AS MATERIALIZED (
  SELECT * FROM (
    SELECT rid, doc_id, unit, position, body, license, template, {dice.format('g')} AS dice
    FROM sets JOIN templates ON len(g) BETWEEN {low} AND {high} AND len(g) > 0)
  WHERE dice >= {min_dice!r}),
-- The words outside these units, as one list of bigrams per text.
blocks AS (
  SELECT rid, unnest(range(len(b))) AS b, unnest(b) AS block
  FROM (SELECT rid, string_split_regex(text, '\\n[ \\t]*\\n') AS b FROM docs)),
lines AS (
  SELECT rid, block, b, unnest(range(len(string_split(block, chr(10))))) AS l,
         unnest(string_split(block, chr(10))) AS line FROM blocks),
outside AS (
  SELECT rid, b, l, {plain.format('line')} AS w,
         (rid, line) IN (SELECT (rid, body) FROM whole WHERE unit = 'line')
         OR (rid, block) IN (SELECT (rid, body) FROM whole WHERE unit = 'block')
         OR rid IN (SELECT rid FROM whole WHERE unit = 'text') AS gone
  FROM lines),
texts AS MATERIALIZED (
  SELECT rid, {pairs.format('w')} AS g FROM (
    SELECT rid, flatten(list(CASE WHEN gone THEN list_transform(w, lambda x: '') ELSE w END
                             ORDER BY b, l)) AS w
    FROM outside GROUP BY rid)),
hits AS MATERIALIZED (
  SELECT rid, license, template, p FROM (
    SELECT rid, unnest(range(len(g))) AS p, unnest(g) AS gram FROM texts)
  JOIN (SELECT license, template, unnest(t) AS gram FROM templates) USING (gram)),
edges AS (
  SELECT *, coalesce(lag(p) OVER o < p - 1, true) AS is_start, coalesce(lead(p) OVER o > p + 1, true) AS is_end
  FROM hits WINDOW o AS (PARTITION BY rid, license, template ORDER BY p)),
spans AS (
  SELECT a.rid, license, template, a.p AS start, z.p AS stop, t, m
  FROM edges a JOIN edges z USING (rid, license, template) JOIN templates USING (license, template)
  WHERE a.is_start AND z.p >= a.p AND z.p < a.p + {high} AND (z.is_end OR z.p + 1 = a.p + {high})
    AND z.p - a.p + 1 >= {low}),
scored AS (
  SELECT rid, license, template, start, stop, {dice.format('d')} AS dice
  FROM (SELECT spans.*, list_distinct(g[start + 1:stop + 1]) AS d FROM spans JOIN texts USING (rid))),
runs AS MATERIALIZED (
  SELECT rid, license, template, start, arg_min(stop, (-dice, stop)) + 2 AS stop, max(dice) AS dice
  FROM scored WHERE dice >= {min_dice!r} GROUP BY ALL),
firsts AS (
  SELECT rid, license, start, arg_min(stop, (-dice, -stop, template)) AS until
  FROM runs GROUP BY ALL),
groups AS (
  SELECT f.rid, f.license, f.start AS head, until, arg_min(
    {{'start': r.start, 'stop': r.stop, 'dice': r.dice, 'template': r.template}},
    (-r.dice, r.start, -r.stop, r.template)) AS best
  FROM firsts f JOIN runs r ON f.rid = r.rid AND f.license = r.license
    AND r.start >= f.start AND r.start < f.until
  GROUP BY ALL),
chained AS MATERIALIZED (
  SELECT g.rid, g.license, head, best, min(f.start) AS following
  FROM groups g LEFT JOIN firsts f ON g.rid = f.rid AND g.license = f.license
    AND f.start >= greatest(g.until, best.stop)
  GROUP BY ALL),
kept AS (
  SELECT c.* FROM chained c JOIN (
    SELECT rid, license, min(start) AS head FROM firsts GROUP BY ALL) USING (rid, license, head)
  UNION ALL
  SELECT c.* FROM kept k JOIN chained c
    ON c.rid = k.rid AND c.license = k.license AND c.head = k.following)
SELECT doc_id, unit, position, license, template, dice FROM whole
UNION ALL
SELECT doc_id, 'run', best.start, license, best.template, best.dice FROM kept JOIN docs USING (rid)"""
