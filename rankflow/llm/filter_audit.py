"""What five text filters do in every order they can be applied, by wide packed counters.

A document fails some of the filters ``A`` to ``E``; which ones is a mask of five bits:

* ``A`` under 50 words (a word is a run of anything but ASCII white space);
* ``B`` fewer than 65 distinct words (case counts) in 100;
* ``C`` more than 5 of the letters A-Z in 100 code points;
* ``D`` any of the characters ``#$%&*|``;
* ``E`` the text of some smaller ``doc_id``, anywhere in the table.

There are 120 orders of five steps.  A mask decides what happens to its documents at each of
these 600 steps, so every mask stands for big integers with 600 fields of 64 bits, one
integer per outcome (kept, removed, redundant, the only failure).  Rows are counted per part,
mask and label by Spark, each count times the integer of its mask is added up per part, and
the sum is unpacked.  A field holds at most the number of rows of a part, so it never runs
over into the next one.  A part comes to its task as at most 128 counts, however many rows
it has.

NULL texts are empty texts.  A NULL ``doc_id`` is neither smaller than another nor larger.
Rows that repeat id and text are not copies of each other (neither id is smaller).  A
document is good (toxic) if any label row of its id says 1.  A NULL source is the part "".
An empty table has no parts and gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.scratch import stage

LETTERS = "ABCDE"
ORDERS = ["".join(order) for order in permutations(LETTERS)]
STEPS = [(order, n) for order in ORDERS for n in range(len(LETTERS))]
OUTCOMES = ("kept", "removed", "redundant", "unique")
#: Bytes of a field; a count of rows is a signed 64-bit number, so it fits.
FIELD = 8

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = ("part string, filter_order string, step int, "
          + ", ".join(f"{name} bigint" for name in COUNTS))


# --- masks -----------------------------------------------------------------------------


def with_failures(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Add the bits of the filters that look at the text alone: A is 1, B 2, C 4, D 8."""
    whole, words = F.coalesce(F.col(text), F.lit("")), F.col("_words")
    n = F.size(words).cast("bigint")
    failed = (
        n < MIN_WORDS,
        F.size(F.array_distinct(words)) * 100 < n * MIN_DISTINCT,
        F.regexp_count(whole, F.lit("[A-Z]")).cast("bigint") * 100
        > F.length(whole).cast("bigint") * MAX_CAPITALS,
        whole.rlike(r"[#$%&*|]"),
    )
    bits = [F.when(c, 1 << bit).otherwise(0) for bit, c in enumerate(failed)]
    return docs.withColumn("_words", F.array_remove(F.split(whole, SPACE), "")).withColumn(
        out, bits[0] + bits[1] + bits[2] + bits[3]).drop("_words")


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
          part: str = "source") -> DataFrame:
    """``id, part, mask, good, toxic`` of every row of ``docs``."""
    plain = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"))
    rows = stage(with_failures(plain, "text", "alone").drop("text"), "filters")
    # Both tables that rows are joined with are written first: Spark then splits hot keys.
    firsts = stage(rows.groupBy("digest").agg(
        F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last"),
        "first-of-text")
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = stage(labels.groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(
        flag("quality").alias("good"), flag("toxic").alias("toxic")).where(
        "id IS NOT NULL AND (good OR toxic)"), "flags")
    no = F.lit(False)
    return rows.join(firsts, "digest", "left").join(known, "id", "left").select(
        "id", "part",
        (F.col("alone") + F.when(F.col("id") > F.col("first"), 16).otherwise(0)).alias("mask"),
        F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


# --- wide counters ---------------------------------------------------------------------


def outcome(mask: int, order: str, step: int) -> set[str]:
    """What happens at ``step`` of ``order`` to a document that fails the filters of ``mask``."""
    fails = [bool(mask >> LETTERS.index(letter) & 1) for letter in order]
    gone, here = any(fails[:step]), fails[step]
    happens = {"kept": not gone and not here, "removed": here and not gone,
               "redundant": here and gone, "unique": here and sum(fails) == 1}
    return {name for name, does in happens.items() if does}


def wide_masks() -> list[dict[str, int]]:
    """Per mask one integer per outcome, with a 1 in the field of each step it has it at."""
    wide = [dict.fromkeys(OUTCOMES, 0) for _ in range(1 << len(LETTERS))]
    for mask, integers in enumerate(wide):
        for field, (order, step) in enumerate(STEPS):
            for name in outcome(mask, order, step):
                integers[name] += 1 << (8 * FIELD * field)
    return wide


def unpack(wide: int) -> np.ndarray:
    """The 600 fields of a sum."""
    return np.frombuffer(wide.to_bytes(FIELD * len(STEPS), "little"), dtype="<i8")


class PartSum:
    """Sums of one part: all documents by outcome, good and toxic ones that are removed."""

    def __init__(self, wide: list[dict[str, int]]):
        self.wide = wide
        self.sums = dict.fromkeys((*OUTCOMES, "good", "toxic"), 0)

    def add(self, mask: int, good: bool, toxic: bool, n: int) -> None:
        wide = self.wide[mask]
        for name in OUTCOMES:
            self.sums[name] += n * wide[name]
        for name, is_one in (("good", good), ("toxic", toxic)):
            if is_one:
                self.sums[name] += n * wide["removed"]

    def rows(self, part: str) -> pa.RecordBatch:
        fields = {name: unpack(total) for name, total in self.sums.items()}
        letter = np.array([LETTERS.index(order[step]) for order, step in STEPS])
        shapley = np.zeros(len(LETTERS), dtype=np.int64)
        np.add.at(shapley, letter, fields["removed"])
        counts = (*(fields[name] for name in (*OUTCOMES, "good", "toxic")), shapley[letter])
        return pa.RecordBatch.from_arrays([
            pa.array([part] * len(STEPS), pa.string()), pa.array([o for o, _ in STEPS]),
            pa.array([n + 1 for _, n in STEPS], pa.int32()),
            *(pa.array(c.astype(np.int64)) for c in counts),
        ], names=["part", "filter_order", "step", *COUNTS])


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts sorted by part become the 600 rows of each part."""
    current, total, wide = None, None, wide_masks()
    for batch in batches:
        for part, *counted in zip(*[c.to_pylist() for c in batch.columns]):
            if part != current:
                if total is not None:
                    yield total.rows(current)
                current, total = part, PartSum(wide)
            total.add(*counted)
    if total is not None:
        yield total.rows(current)


def interactions(masked: DataFrame) -> DataFrame:
    """Rows of ``masks`` -> ``part, filter_order, step`` and the counts of that step."""
    counted = masked.groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    return counted.repartition("part").sortWithinPartitions("part").mapInArrow(_sum_parts, SCHEMA)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interaction audit of a table of documents, one row per part, order and step."""
    return interactions(masks(docs, labels))


# --- the same in SQL -------------------------------------------------------------------


def audit_sql() -> str:
    """Outcomes counted one by one over the rows of each mask, without packed integers."""
    words = f"list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda w: w <> '')"
    steps = ", ".join(f"('{order}', {n + 1})" for order, n in STEPS)
    return f"""
WITH flags AS (
  SELECT doc_id, max(coalesce((quality = 1)::INT, 0)) AS good,
         max(coalesce((toxic = 1)::INT, 0)) AS toxic FROM labels GROUP BY doc_id),
worded AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {words} AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(words) < {MIN_WORDS} THEN 'A' ELSE '' END)
         || (CASE WHEN 100 * len(list_distinct(words)) < {MIN_DISTINCT} * len(words) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g'))
                       > {MAX_CAPITALS} * length(text) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN coalesce(worded.doc_id > first, false) THEN 'E' ELSE '' END) AS fails
  FROM worded LEFT JOIN flags USING (doc_id)),
counted AS (SELECT part, fails, sum(good) AS good, sum(toxic) AS toxic, count(*) AS n
            FROM failed GROUP BY part, fails),
steps AS (SELECT col0 AS filter_order, col1 AS step, substr(col0, col1, 1) AS letter,
                 substr(col0, 1, col1 - 1) AS before FROM (VALUES {steps})),
met AS (
  SELECT part, filter_order, step, letter, fails, n, good, toxic,
         contains(fails, letter) AS here,
         length(translate(fails, before, '')) < length(fails) AS gone
  FROM counted, steps),
summed AS (
  SELECT part, filter_order, step, letter,
         sum(n) FILTER (NOT here AND NOT gone) AS kept, sum(n) FILTER (here AND NOT gone) AS removed,
         sum(n) FILTER (here AND gone) AS redundant, sum(n) FILTER (fails = letter) AS unique_fails,
         sum(good) FILTER (here AND NOT gone) AS good_lost,
         sum(toxic) FILTER (here AND NOT gone) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept,
       coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
       coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM summed"""
