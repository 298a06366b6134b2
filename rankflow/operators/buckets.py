"""Relative-error bucket sketches: DDSketch, its collapsing form, UDDSketch.

A sketch is a table with one row per non-empty bucket::

    keys..., sgn, idx, n            (UDDSketch adds ``level``)

Bucket ``idx`` of the positive store (``sgn = 1``) holds values in
``(g**(idx-1), g**idx]`` with ``g = (1+a)/(1-a)``.  Negative values use a
mirrored store (``sgn = -1``), zeros one bucket (``sgn = 0``).

Building is one hash aggregate, so each task sends at most one row per
(group, bucket) whatever the number of input rows, and a hot group spreads over
its buckets.  For accuracy ``a`` there are at most ``1455/ln(g)`` buckets per
sign over the whole double range (73,000 at 1 %), so the windows over buckets of
a group have a fixed bound too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from rankflow.functions.scalars import QUANTILES, as_column, quantile_column
from rankflow.operators.tasks import blobs_of, merge_states, reduce_tasks, words_of
from rankflow.scratch import join_groups

ALPHA = 0.01
MAX_BUCKETS = 1024
COLLAPSES = 12

#: Width (in bits of the bucket number) of the blocks the level search works on.
_BLOCK_BITS = 16
_NEVER = 99
#: Added to bucket numbers so that sign and number fit one signed integer.
_SHIFT = 1 << 40


def checked_bound(max_buckets: int) -> int:
    """A store with both signs, and values on both sides of 1, never has fewer than 4."""
    if max_buckets < 4:
        raise ValueError(f"max_buckets must be at least 4, not {max_buckets}")
    return max_buckets


def gamma(alpha: float) -> float:
    return (1 + alpha) / (1 - alpha)


def uniform_alpha(alpha: float = ALPHA, collapses: int = COLLAPSES) -> float:
    """Starting accuracy that ``collapses - 1`` doublings turn into ``alpha``."""
    return math.tanh(math.atanh(alpha) / 2 ** (collapses - 1))


def bucket_index(x: Column, alpha: float) -> Column:
    """Bucket number of ``|x|``; defined for finite, non-zero ``x``."""
    return F.ceil(F.ln(F.abs(x)) / F.lit(math.log(gamma(alpha)))).cast("bigint")


def bucket_value(alpha: float, idx: Column, level: Column | None = None) -> Column:
    """Representative ``2 g**i / (g+1)`` with ``g`` squared once per level."""
    log_g = math.log(gamma(alpha))
    if level is None:
        return F.lit(2 / (gamma(alpha) + 1)) * F.exp(idx * F.lit(log_g))
    lg = F.lit(log_g) * F.pow(F.lit(2.0), level)
    return F.lit(2.0) * F.exp(idx * lg) / (F.exp(lg) + F.lit(1.0))


def _finite(x: Column) -> Column:
    """Neither NULL, NaN (which sorts above infinity) nor infinite.

    Filters evaluate their input once per mention, so ``x`` is mentioned once.
    """
    return F.abs(x) < F.lit(float("inf"))


def _counts(df: DataFrame, value: str | Column, keys: Sequence[str], alpha: float) -> DataFrame:
    x = as_column(value).cast("double")
    return (
        df.where(_finite(x))
        .select(
            *keys,
            F.signum(x).cast("int").alias("sgn"),
            F.when(x == 0, F.lit(0)).otherwise(bucket_index(x, alpha)).cast("bigint").alias("idx"),
        )
        .groupBy(*keys, "sgn", "idx")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- DDSketch ---------------------------------------------------------------


def dds_build(df: DataFrame, value: str | Column, keys: Sequence[str] = (),
              alpha: float = ALPHA) -> DataFrame:
    """Bucket counts per group.  NULL, NaN and infinite values are left out."""
    return _counts(df, value, keys, alpha)


def dds_merge(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add the counts of sketches that agree on ``keys``."""
    return sketches.groupBy(*keys, "sgn", "idx").agg(F.sum("n").alias("n"))


def _walk(sketch: DataFrame, keys: Sequence[str], ps: Sequence[float],
          rep: Column, extra: Sequence[Column] = ()) -> DataFrame:
    """First bucket whose cumulative count exceeds ``p * (total - 1)``."""
    per_group = Window.partitionBy(*keys)
    ordered = per_group.orderBy("sgn", F.col("sgn") * F.col("idx")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = sketch.select(
        *keys, "n", *extra,
        F.when(F.col("sgn") == 0, F.lit(0.0)).otherwise(F.col("sgn") * rep).alias("_rep"),
        F.sum("n").over(ordered).alias("_cum"),
        F.sum("n").over(per_group).alias("_total"),
    )
    # Representatives rise with the bucket order, so the first bucket past the
    # target is the smallest representative past it.
    picks = [
        F.min(F.when(F.col("_cum") > F.lit(float(p)) * (F.col("_total") - 1), F.col("_rep")))
        .alias(quantile_column(p))
        for p in ps
    ]
    keep = [F.max(name).alias(name) for name in ("level",) if extra]
    return ranked.groupBy(*keys).agg(F.sum("n").alias("n"), *keep, *picks)


def dds_quantiles(sketch: DataFrame, keys: Sequence[str] = (), ps: Sequence[float] = QUANTILES,
                  alpha: float = ALPHA) -> DataFrame:
    """``keys, n, pct_..`` per group, each within ``alpha`` of the order statistic."""
    return _walk(sketch, keys, ps, bucket_value(alpha, F.col("idx")))


def dds_minmax(sketch: DataFrame, keys: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    """Representatives of the lowest and highest bucket of each group."""
    rep = F.when(F.col("sgn") == 0, F.lit(0.0)).otherwise(
        F.col("sgn") * bucket_value(alpha, F.col("idx"))
    )
    return sketch.groupBy(*keys).agg(F.min(rep).alias("min_value"), F.max(rep).alias("max_value"))


# --- DDSketch with a bounded store -------------------------------------------


def ddsc_fold(sketch: DataFrame, keys: Sequence[str] = (),
              max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """Fold every bucket below ``max(idx) - (max_buckets - 1)`` into that one.

    The two signs are separate stores.  Folding once at the end gives what
    folding after every insert gives, so it is done on bucket rows only.
    """
    store = Window.partitionBy(*keys, "sgn")
    floor_idx = F.max("idx").over(store) - F.lit(max_buckets - 1)
    return (
        sketch.select(*keys, "sgn", F.greatest("idx", floor_idx).alias("idx"), "n")
        .groupBy(*keys, "sgn", "idx")
        .agg(F.sum("n").alias("n"))
    )


def ddsc_build(df: DataFrame, value: str | Column, keys: Sequence[str] = (),
               alpha: float = ALPHA, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    return ddsc_fold(dds_build(df, value, keys, alpha), keys, max_buckets)


def ddsc_merge(sketches: DataFrame, keys: Sequence[str] = (),
               max_buckets: int = MAX_BUCKETS) -> DataFrame:
    return ddsc_fold(dds_merge(sketches, keys), keys, max_buckets)


ddsc_quantiles = dds_quantiles


# --- UDDSketch ----------------------------------------------------------------


def udds_counts(df: DataFrame, value: str | Column, keys: Sequence[str] = (),
                alpha: float = ALPHA, collapses: int = COLLAPSES) -> DataFrame:
    """Level-0 bucket counts at the starting accuracy, before any collapse."""
    return _counts(df, value, keys, uniform_alpha(alpha, collapses)).select(
        *keys, F.lit(0).alias("level"), "sgn", "idx", "n"
    )


def _at_level(idx: Column, level: Column) -> Column:
    """``ceil(idx / 2**level)``."""
    return F.call_function("shiftright", idx - F.lit(1), level) + F.lit(1)


def _bit_length(x: Column) -> Column:
    """Bits of a positive whole number; the half keeps log2 off the powers."""
    return F.ceil(F.log2(x + F.lit(0.5))).cast("int")


def _final_levels(buckets: DataFrame, keys: Sequence[str], max_buckets: int) -> DataFrame:
    """Per group the fewest further collapses that leave ``max_buckets`` buckets.

    Two neighbours with numbers ``a < b`` become one bucket at the level that
    equals the bit length of ``(a-1) xor (b-1)``.  So the number of buckets at
    level L is the number of buckets whose merge level with their predecessor
    exceeds L; numbers on either side of zero never meet.  The predecessor is looked up inside blocks of 2**16 bucket
    numbers, then between the blocks; neither window grows with the data.
    """
    # Zeros ride along uncounted: a filter on the sign would be pushed below the
    # aggregation of the input and cost a second scan.
    where = buckets.select(
        *keys, "sgn", (F.col("idx") - 1).alias("_j"),
        (F.col("sgn") != 0).cast("bigint").alias("_one"),
    ).withColumn("_block", F.shiftright("_j", _BLOCK_BITS))

    in_block = Window.partitionBy(*keys, "sgn", "_block").orderBy("_j")
    prev = F.lag("_j").over(in_block)
    marked = where.select(
        *keys, "sgn", "_block", "_one", F.col("_j").bitwiseXOR(prev).alias("_x"),
    )
    # One row per (block, merge level); level 0 marks the first of its block.
    steps = (
        marked.select(
            *keys, "sgn", "_block", "_one",
            F.when(F.col("_x").isNull(), F.lit(0)).otherwise(_bit_length(F.col("_x"))).alias("_at"),
        )
        .groupBy(*keys, "sgn", "_block", "_at")
        .agg(F.sum("_one").alias("_c"))
    )
    between = Window.partitionBy(*keys, "sgn").orderBy("_block", "_at")
    before = F.lag("_block").over(between)
    jump = F.col("_block").bitwiseXOR(F.col("_before"))
    steps = steps.withColumn("_before", before).select(
        *keys,
        F.when(F.col("_at") > 0, F.col("_at"))
        .when(F.col("_before").isNull() | (jump < 0), F.lit(_NEVER))
        .otherwise(F.lit(_BLOCK_BITS) + _bit_length(jump))
        .alias("_at"),
        "_c",
    )
    steps = steps.groupBy(*keys, "_at").agg(F.sum("_c").alias("_c"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_at")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # _tail counts buckets that still stand just below level _at.
    tails = steps.select(
        *keys, "_at", (F.sum("_c").over(later)).alias("_tail"),
    )
    below = Window.partitionBy(*keys).orderBy(F.desc("_at"))
    return (
        tails.withColumn("_after", F.coalesce(F.lag("_tail").over(below), F.lit(0)))
        .groupBy(*keys)
        .agg(
            F.when(F.max("_tail") <= max_buckets, F.lit(0))
            .otherwise(F.min(F.when(F.col("_after") <= max_buckets, F.col("_at"))))
            .cast("int")
            .alias("_up")
        )
    )


def udds_collapse(buckets: DataFrame, keys: Sequence[str] = (),
                  max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """Collapse groups (all rows of a group at one level) to ``max_buckets``."""
    keys = list(keys)
    checked_bound(max_buckets)
    # The filter keeps the counts in both uses of the table, so that both are
    # served by one aggregation of the input.
    buckets = buckets.where(F.col("n") > 0)
    ups = _final_levels(buckets, keys, max_buckets)
    up = F.coalesce(F.col("_up"), F.lit(0))
    return (
        join_groups(buckets, ups, keys, "left")
        .select(
            *keys, (F.col("level") + up).alias("level"), "sgn",
            F.when(F.col("sgn") == 0, F.lit(0).cast("bigint"))
            .otherwise(_at_level(F.col("idx"), up)).alias("idx"),
            "n",
        )
        .groupBy(*keys, "level", "sgn", "idx")
        .agg(F.sum("n").alias("n"))
    )


class BucketState:
    """Bucket counts of a group, collapsed to ``max_buckets`` as it grows."""

    def __init__(self, max_buckets: int) -> None:
        self.max_buckets = checked_bound(max_buckets)
        self.level = 0
        self.codes = np.empty(0, dtype=np.int64)  # sgn * (idx + _SHIFT)
        self.n = np.empty(0, dtype=np.int64)

    def add(self, codes: np.ndarray) -> None:
        fresh, counts = np.unique(codes, return_counts=True)
        self._take(self._raise(fresh, self.level), counts)

    def merge(self, other: BucketState) -> None:
        level = max(self.level, other.level)
        mine, theirs = level - self.level, level - other.level
        self.codes, self.level = self._raise(self.codes, mine), level
        self._take(self._raise(other.codes, theirs), other.n)

    def _take(self, codes: np.ndarray, n: np.ndarray) -> None:
        self._tally(np.concatenate((self.codes, codes)), np.concatenate((self.n, n)))
        while np.count_nonzero(self.codes) > self.max_buckets:
            self.level += 1
            self._tally(self._raise(self.codes, 1), self.n)

    def _tally(self, codes: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
        first = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1))
        self.codes, self.n = codes[first], np.add.reduceat(n, first)

    @staticmethod
    def _raise(codes: np.ndarray, levels: int) -> np.ndarray:
        sgn = np.sign(codes)
        return sgn * (((np.abs(codes) - _SHIFT - 1) >> levels) + 1 + _SHIFT)

    def to_bytes(self) -> bytes:
        head = np.array([self.max_buckets, self.level, len(self.codes)], dtype="<i8")
        return head.tobytes() + self.codes.astype("<i8").tobytes() + self.n.astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BucketState:
        whole = np.frombuffer(data, dtype="<i8")
        state = cls(int(whole[0]))
        state.level, size = int(whole[1]), int(whole[2])
        state.codes, state.n = whole[3 : 3 + size].copy(), whole[3 + size :].copy()
        return state


class SmallBuckets:
    """States that never were collapsed, many at a time: a head, their codes, their counts."""

    def __init__(self, max_buckets: int | None = None) -> None:
        self.max_buckets = max_buckets
        self.limit = 0 if max_buckets is None else max_buckets + 1

    def pack(self, values: np.ndarray, starts: np.ndarray) -> pa.Array:
        group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(values)))
        return self._write(self.max_buckets, group, values, np.ones(len(values), dtype=np.int64),
                           len(starts))

    @staticmethod
    def _write(max_buckets: int, group: np.ndarray, codes: np.ndarray, n: np.ndarray,
               groups: int) -> pa.Array:
        if not groups:
            return pa.array([], pa.binary())
        order = np.lexsort((codes, group))
        group, codes, n = group[order], codes[order], n[order]
        first = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(codes, prepend=0) != 0))
        group, codes, n = group[first], codes[first], np.add.reduceat(n, first)
        sizes = np.bincount(group, minlength=groups)
        ends = np.cumsum(3 + 2 * sizes)
        at = ends - 3 - 2 * sizes
        words = np.empty(int(ends[-1]), dtype="<i8")
        words[at], words[at + 1], words[at + 2] = max_buckets, 0, sizes
        place = np.arange(len(codes)) - (np.cumsum(sizes) - sizes)[group] + at[group] + 3
        words[place], words[place + sizes[group]] = codes, n
        return blobs_of(words, ends)

    def join(self, sketches: pa.Array, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        none = pa.array([], pa.binary()), np.zeros(len(starts), dtype=bool)
        held = words_of(sketches, "<i8")
        if held is None:
            return none
        words, at, length = held
        bound, level, size = words[np.minimum(at + np.arange(3)[:, None], len(words) - 1)]
        plain = (bound == bound[0]) & (level == 0) & (length == 3 + 2 * size)
        size = np.where(plain, size, 0)
        # Together they have at most as many buckets as all of them.
        done = np.logical_and.reduceat(plain, starts) & (np.add.reduceat(size, starts) <= bound[0])
        if not done.any():
            return none
        states = np.diff(starts, append=len(sketches))
        rows = np.repeat(done, states)
        size, at = size[rows], at[rows] + 3
        place = np.arange(int(size.sum())) + np.repeat(at - (np.cumsum(size) - size), size)
        group = np.repeat(np.repeat(np.arange(int(done.sum())), states[done]), size)
        return self._write(int(bound[0]), group, words[place], words[place + np.repeat(size, size)],
                           int(done.sum())), done


def bucket_rows(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """UDDSketch rows out of binary states."""
    schema = StructType([
        *[states.schema[k] for k in keys],
        StructField("level", IntegerType()), StructField("sgn", IntegerType()),
        StructField("idx", LongType()), StructField("n", LongType()),
    ])
    out_schema = to_arrow_schema(schema)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = words_of(batch.column("sketch"), "<i8")
            if held is None:
                continue
            words, at, _ = held
            sizes = words[at + 2]
            if not sizes.sum():
                continue
            rows = np.repeat(np.arange(len(at)), sizes)
            place = np.arange(len(rows)) - (np.cumsum(sizes) - sizes)[rows] + at[rows] + 3
            codes, counts = words[place], words[place + sizes[rows]]
            level = words[at + 1].astype(np.int32)[rows]
            sgn = np.sign(codes)
            columns = [
                *[batch.column(k).take(pa.array(rows)) for k in keys],
                pa.array(level), pa.array(sgn.astype(np.int32)),
                pa.array(np.where(sgn == 0, 0, np.abs(codes) - _SHIFT)),
                pa.array(counts),
            ]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

    return states.mapInArrow(unpack, schema)


def udds_partials(df: DataFrame, value: str | Column, keys: Sequence[str] = (),
                  alpha: float = ALPHA, collapses: int = COLLAPSES,
                  max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """Per input task and group one state of at most ``max_buckets`` buckets.

    At the starting accuracy almost every distinct value has its own bucket, so
    counting before the shuffle saves little unless the task collapses as well.
    A task sees part of a group and so never collapses further than the group
    ends up, which keeps the result exact.
    """
    checked_bound(max_buckets)
    x = as_column(value).cast("double")
    code = F.when(x == 0, F.lit(0)).otherwise(
        F.signum(x).cast("bigint")
        * (bucket_index(x, uniform_alpha(alpha, collapses)) + F.lit(_SHIFT))
    )
    rows = df.where(_finite(x)).select(*keys, code.cast("bigint").alias("_code"))
    return reduce_tasks(rows, keys, "_code", lambda: BucketState(max_buckets),
                        SmallBuckets(max_buckets))


def udds_build(df: DataFrame, value: str | Column, keys: Sequence[str] = (),
               alpha: float = ALPHA, collapses: int = COLLAPSES,
               max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """Uniformly collapsed bucket counts; ``level`` is the collapses applied."""
    return finish_states(udds_partials(df, value, keys, alpha, collapses, max_buckets), keys)


def finish_states(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Merge binary states and spread them out to bucket rows."""
    merged = merge_states(states, keys, BucketState.from_bytes, small=SmallBuckets())
    return bucket_rows(merged, keys)


def udds_merge(sketches: DataFrame, keys: Sequence[str] = (),
               max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """Bring sketches to the highest level among them, add, collapse again."""
    keys = list(keys)
    added = (
        sketches.groupBy(*keys, "level", "sgn", "idx").agg(F.sum("n").alias("n"))
        .where(F.col("n") > 0)
    )
    top = added.groupBy(*keys).agg(F.max("level").alias("_top"))
    up = F.col("_top") - F.col("level")
    aligned = (
        join_groups(added, top, keys)
        .select(
            *keys, F.col("_top").alias("level"), "sgn",
            F.when(F.col("sgn") == 0, F.lit(0).cast("bigint"))
            .otherwise(_at_level(F.col("idx"), up)).alias("idx"),
            "n",
        )
        .groupBy(*keys, "level", "sgn", "idx")
        .agg(F.sum("n").alias("n"))
    )
    return udds_collapse(aligned, keys, max_buckets)


def udds_quantiles(sketch: DataFrame, keys: Sequence[str] = (), ps: Sequence[float] = QUANTILES,
                   alpha: float = ALPHA, collapses: int = COLLAPSES) -> DataFrame:
    """As ``dds_quantiles``, plus ``level`` and the accuracy it stands for."""
    start = uniform_alpha(alpha, collapses)
    rep = bucket_value(start, F.col("idx"), F.col("level"))
    wide = _walk(sketch, keys, ps, rep, [F.col("level")])
    now = F.tanh(F.lit(math.atanh(start)) * F.pow(F.lit(2.0), F.col("level")))
    cols = [F.col(quantile_column(p)) for p in ps]
    return wide.select(*keys, "n", "level", now.alias("alpha"), *cols)
