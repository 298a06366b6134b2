"""Relative-error quantile (REQ) sketches over 32-bit floats, high ranks exact-most.

A sketch table has rows ``keys..., sketch BINARY``.  Each input task reduces its
rows to one small state per group (``mapInArrow``), so only states are
shuffled; states of a group are merged in two steps, by share and then across
the shares, each step streaming over its states.  Ranks are exclusive: the
quantile at ``p`` is the first item whose cumulative weight exceeds ``p * n``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.functions.scalars import QUANTILES, as_column, quantile_column
from rankflow.operators.tasks import SHARES, blobs_of, merge_states, reduce_tasks, words_of

K = 30
SECTIONS = 3

class ReqState:
    """Compactor levels of one sketch.  Level ``h`` items weigh ``2**h``."""

    def __init__(self, k: int = K) -> None:
        self.k = k
        self.n = 0
        self.lo = np.inf
        self.hi = -np.inf
        self.items: list[np.ndarray] = []
        self.rounds: list[int] = []
        self.sections: list[int] = []

    def _grow(self, levels: int) -> None:
        while len(self.items) < levels:
            self.items.append(np.empty(0, dtype=np.float32))
            self.rounds.append(0)
            self.sections.append(SECTIONS)

    @staticmethod
    def first_capacity(k: int) -> int:
        """Values at which the lowest level is compacted for the first time."""
        state = ReqState(k)
        state._grow(1)
        return state._capacity(0)

    def _section_size(self, level: int) -> int:
        """Shrinks by sqrt(2) with each doubling of the sections; even, at least 4."""
        doublings = int(round(np.log2(self.sections[level] / SECTIONS)))
        return max(4, 2 * int(round(self.k / 2 ** (doublings / 2) / 2)))

    def _capacity(self, level: int) -> int:
        return 2 * self.sections[level] * self._section_size(level)

    def add(self, values: np.ndarray) -> None:
        if len(values) == 0:
            return
        self._grow(1)
        self.n += len(values)
        self.lo = min(self.lo, float(values.min()))
        self.hi = max(self.hi, float(values.max()))
        self.items[0] = np.concatenate((self.items[0], values.astype(np.float32)))
        self._compress()

    def merge(self, other: ReqState) -> None:
        if other.n == 0:
            return
        self._grow(len(other.items))
        self.n += other.n
        self.lo, self.hi = min(self.lo, other.lo), max(self.hi, other.hi)
        for h, theirs in enumerate(other.items):
            self.items[h] = np.concatenate((self.items[h], theirs))
            self.rounds[h] |= other.rounds[h]
            self.sections[h] = max(self.sections[h], other.sections[h])
        self._compress()

    def _compress(self) -> None:
        h = 0
        while h < len(self.items):
            if len(self.items[h]) >= self._capacity(h):
                self._grow(h + 2)
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        """Promote every second of the low items; the high ones stay untouched."""
        size, parts, state = self._section_size(h), self.sections[h], self.rounds[h]
        ones = (~state & (state + 1)).bit_length() - 1  # trailing ones of the state
        open_parts = min(ones + 1, parts)
        keep = parts * size + (parts - open_parts) * size
        ordered = np.sort(self.items[h])
        low = len(ordered) - keep
        low -= low & 1
        region = ordered[:low]
        # The coin depends on the data only, so a retried task repeats itself.
        coin = zlib.crc32(region.tobytes(), h) >> 7 & 1
        self.items[h] = ordered[low:]
        self.items[h + 1] = np.concatenate((self.items[h + 1], region[coin::2]))
        self.rounds[h] = state + 1
        if self.rounds[h] >= 1 << (parts - 1) and self._section_size(h) > 4:
            self.sections[h] = parts * 2

    def to_bytes(self) -> bytes:
        head = struct.pack("<iqddi", self.k, self.n, self.lo, self.hi, len(self.items))
        meta = b"".join(
            struct.pack("<qii", r, s, len(i))
            for r, s, i in zip(self.rounds, self.sections, self.items)
        )
        return head + meta + b"".join(i.astype("<f4").tobytes() for i in self.items)

    @classmethod
    def from_bytes(cls, data: bytes) -> ReqState:
        k, n, lo, hi, levels = struct.unpack_from("<iqddi", data)
        state = cls(k)
        state.n, state.lo, state.hi = n, lo, hi
        at = struct.calcsize("<iqddi")
        lengths = []
        for _ in range(levels):
            r, s, length = struct.unpack_from("<qii", data, at)
            state.rounds.append(r)
            state.sections.append(s)
            lengths.append(length)
            at += 16
        for length in lengths:
            state.items.append(np.frombuffer(data, "<f4", length, at).astype(np.float32))
            at += 4 * length
        return state

    @property
    def retained(self) -> int:
        return sum(len(i) for i in self.items)

    def quantiles(self, ranks: np.ndarray) -> np.ndarray:
        values = np.concatenate(self.items)
        weights = np.concatenate(
            [np.full(len(i), 1 << h, dtype=np.int64) for h, i in enumerate(self.items)]
        )
        order = np.argsort(values, kind="stable")
        values, upto = values[order], np.cumsum(weights[order])
        at = np.searchsorted(upto, np.floor(ranks * upto[-1]), side="right")
        out = values[np.minimum(at, len(values) - 1)].astype(float)
        out[ranks <= 0] = self.lo
        out[ranks >= 1] = self.hi
        return out


#: What comes before the items in a state of one level, 4-byte words.
_ONE_LEVEL = np.dtype([("k", "<i4"), ("n", "<i8"), ("lo", "<f8"), ("hi", "<f8"), ("levels", "<i4"),
                       ("rounds", "<i8"), ("sections", "<i4"), ("size", "<i4")])
_HEAD = _ONE_LEVEL.itemsize // 4


class SmallReq:
    """States that never were compacted, many at a time: a head and their values."""

    def __init__(self, k: int | None = None) -> None:
        self.k = k
        self.limit = 0 if k is None else ReqState.first_capacity(k)

    def pack(self, values: np.ndarray, starts: np.ndarray) -> pa.Array:
        values = values.astype("<f4")
        sizes = np.diff(starts, append=len(values))
        if not len(starts):
            return pa.array([], pa.binary())
        return self._write(self.k, values, sizes, np.minimum.reduceat(values, starts),
                           np.maximum.reduceat(values, starts))

    @staticmethod
    def _write(k: int, values: np.ndarray, sizes: np.ndarray, lo: np.ndarray,
               hi: np.ndarray) -> pa.Array:
        head = np.zeros(len(sizes), dtype=_ONE_LEVEL)
        head["k"], head["n"], head["lo"], head["hi"] = k, sizes, lo, hi
        head["levels"], head["sections"], head["size"] = 1, SECTIONS, sizes
        ends = np.cumsum(sizes + _HEAD)
        words = np.empty(int(ends[-1]) if len(ends) else 0, dtype="<u4")
        words[(ends - sizes - _HEAD)[:, None] + np.arange(_HEAD)] = head.view("<u4").reshape(-1, _HEAD)
        heads_before = np.repeat(np.arange(1, len(sizes) + 1) * _HEAD, sizes)
        words[np.arange(len(values)) + heads_before] = values.view("<u4")
        return blobs_of(words, ends)

    def join(self, sketches: pa.Array, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        none = pa.array([], pa.binary()), np.zeros(len(starts), dtype=bool)
        held = words_of(sketches, "<u4")
        if held is None:
            return none
        words, at, length = held
        head = words[np.minimum(at[:, None] + np.arange(_HEAD), len(words) - 1)].view(_ONE_LEVEL)[:, 0]
        k = int(head["k"][0])
        plain = ((head["k"] == k) & (head["levels"] == 1) & (head["rounds"] == 0)
                 & (head["sections"] == SECTIONS) & (length == head["n"] + _HEAD))
        n = np.where(plain, head["n"], 0)
        total = np.add.reduceat(n, starts)
        done = np.logical_and.reduceat(plain, starts) & (total < ReqState.first_capacity(k))
        if not done.any():
            return none
        rows = np.repeat(done, np.diff(starts, append=len(sketches)))
        n, at, total = n[rows], at[rows] + _HEAD, total[done]
        values = words[np.arange(int(n.sum())) + np.repeat(at - (np.cumsum(n) - n), n)].view("<f4")
        lo, hi = (ufunc.reduceat(head[side], starts)[done]
                  for ufunc, side in ((np.minimum, "lo"), (np.maximum, "hi")))
        return self._write(k, values, total, lo, hi), done


def req_partials(df: DataFrame, value: str | Column, keys: Sequence[str] = (),
                 k: int = K) -> DataFrame:
    """One state per input task and group; no shuffle."""
    v = as_column(value).cast("float")
    rows = df.select(*keys, v.alias("_v")).where(F.col("_v") <= F.lit(float("inf")))
    return reduce_tasks(rows, keys, "_v", lambda: ReqState(k), SmallReq(k))


def req_merge(sketches: DataFrame, keys: Sequence[str] = (), shares: int = SHARES) -> DataFrame:
    """Merge sketches that agree on ``keys``."""
    return merge_states(sketches, keys, ReqState.from_bytes, shares, SmallReq())


def req_build(df: DataFrame, value: str | Column, keys: Sequence[str] = (), k: int = K,
              shares: int = SHARES) -> DataFrame:
    return req_merge(req_partials(df, value, keys, k), keys, shares)


def req_describe(sketch: DataFrame, keys: Sequence[str], ranks: Sequence[float]) -> DataFrame:
    """``keys, n, num_retained, min_value, max_value, q`` of each sketch row."""
    wanted = np.array([float(p) for p in ranks])

    @F.pandas_udf("n bigint, num_retained bigint, min_value double, max_value double, "
                  "q array<double>")
    def read(col: pd.Series) -> pd.DataFrame:
        states = [ReqState.from_bytes(b) for b in col]
        return pd.DataFrame({
            "n": [s.n for s in states],
            "num_retained": [s.retained for s in states],
            "min_value": [s.lo for s in states],
            "max_value": [s.hi for s in states],
            "q": [list(s.quantiles(wanted)) for s in states],
        })

    return sketch.select(*keys, read("sketch").alias("_d")).select(*keys, "_d.*")


def req_quantiles(sketch: DataFrame, keys: Sequence[str] = (),
                  ps: Sequence[float] = QUANTILES) -> DataFrame:
    """``keys, n, num_retained, pct_..`` per group."""
    got = req_describe(sketch, keys, ps)
    picks = [F.col("q")[i].alias(quantile_column(p)) for i, p in enumerate(ps)]
    return got.select(*keys, "n", "num_retained", *picks)


def req_size_bytes(sketch: str | Column = "sketch") -> Column:
    return F.octet_length(sketch).cast("bigint")


def req_rse(k: int, p: float) -> float:
    """One-sigma rank error at normalized rank ``p`` (high ranks accurate)."""
    # The published constants of the sketch.
    return min(0.084 / k, 0.1306 / k * (1 - p))


def req_upper_rank(k: int, p: float, sigmas: int = 1) -> float:
    """Upper bound of the true rank of the item returned for ``p``."""
    return p + sigmas * req_rse(k, p)


def req_rank_bounds(p: float | Column, n: int | Column, k: int = K, side: str = "high",
                    sigmas: int = 1) -> tuple[Column, Column]:
    """Lower and upper bound of the true rank of the item returned for rank ``p``.

    ``side`` is the end of the distribution whose ranks the sketch keeps best, ``n`` the number of
    values.  The lowest level never compacts its first ``3 k`` items on that end, so ranks
    there, and all ranks of up to ``3 k`` values, are exact.  Elsewhere the error is the smaller
    of a fixed one and of one that shrinks towards that end.
    """
    if side not in ("high", "low"):
        raise ValueError("the accurate side is high or low")
    p, n = (x if isinstance(x, Column) else F.lit(x) for x in (p, n))
    p = p.cast("double")
    to_end = F.lit(1.0) - p if side == "high" else p
    # The published constants of the sketch.
    error = F.least(F.lit(0.084) / k, F.lit(0.1306) / k * to_end) * sigmas
    kept = F.lit(float(SECTIONS * k)) / n
    exact = (n <= SECTIONS * k) | (p >= F.lit(1.0) - kept if side == "high" else p <= kept)
    error = F.when(exact, F.lit(0.0)).otherwise(error)
    return p - error, p + error
