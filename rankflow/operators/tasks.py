"""Reducing a task's rows to one small state per group, ahead of the shuffle.

Used where a sketch's state cannot be written as a built-in aggregate.  Rows
arrive as Arrow batches; a task keeps a bounded number of states and hands them
on when it reaches the bound, which is sound because states of a group are
merged after the shuffle anyway.

A sketch may have a form for groups of few values (``SmallForm``).  Then the groups of a
buffer that holds many are written and merged together, by operations on whole columns,
and no state is made for any of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    IntegerType,
    MapType,
    StructField,
    StructType,
)

#: Rows a task gathers before it updates its states; more with many states, so
#: that each update brings its state several rows, up to the second number.
BUFFER_ROWS = 1 << 18
MAX_BUFFER_ROWS = 1 << 21
#: States a task holds before it hands them on.
MAX_STATES = 20_000
#: Merged states a task gathers for one output batch.
OUT_ROWS = 4096
#: Small sketches in one output batch.
OUT_SMALL = 1 << 16
#: A group's task states are first merged in this many shares.
SHARES = 64


class SmallForm(Protocol):
    """Sketches of few values as columns; their bytes are those of the states."""

    #: Groups of fewer values can be packed.
    limit: int

    def pack(self, values: np.ndarray, starts: np.ndarray) -> pa.Array:
        """One sketch per group of ``values``, the first of which are at ``starts``."""

    def join(self, sketches: pa.Array, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Merged sketches of the groups for which that is possible, and which these are."""


def words_of(blobs: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Numbers of ``kind`` that blobs consist of, where each blob starts, and how many it has.

    None if a blob is NULL, if all are empty, or if one does not lie on whole numbers.
    """
    blobs = blobs.cast(pa.binary())
    at = np.frombuffer(blobs.buffers()[1], np.int32)[
        blobs.offset:blobs.offset + len(blobs) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    if (at % size).any() or blobs.null_count or not at[-1]:
        return None
    words = np.frombuffer(blobs.buffers()[2], kind, int(at[-1]) // size)
    return words, at[:-1] // size, np.diff(at) // size


def blobs_of(words: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Blobs out of numbers, cut at ``ends``."""
    offsets = (np.r_[0, ends] * words.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(words)])


def group_codes(table: pa.Table | pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """A number per row, equal for equal keys; NULL is a key, and so is NaN."""
    code = np.zeros(table.num_rows, dtype=np.int64)
    for k in keys:
        column = table.column(k)
        if pa.types.is_floating(column.type):
            column = pc.add(column, pa.scalar(0.0, column.type))  # one zero
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        coded = column.dictionary_encode(null_encoding="encode")
        code = code * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
        # Renumber so that the next product cannot overflow.
        code = np.unique(code, return_inverse=True)[1]
    return code


def grouped_rows(table: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in the order of their groups, and where each group starts among them."""
    code = group_codes(table, keys)
    order = np.argsort(code, kind="stable")
    return order, np.flatnonzero(np.diff(code[order], prepend=-1))


def reduce_tasks(rows: DataFrame, keys: Sequence[str], value: str,
                 new: Callable[[], object], small: SmallForm | None = None) -> DataFrame:
    """Feed each group's values to a state: ``keys, sketch BINARY, task, seq`` per task.

    ``task`` is the number of the input partition and ``seq`` counts its hand-overs; a
    task that runs again has the same ones, whatever order its rows come in.

    ``new()`` makes a state with ``add(array)`` and ``to_bytes()``.  A buffer with more groups than
    a task holds states is handed on at once where its groups have the small form.  No shuffle.
    """
    keys = list(keys)
    nested = [k for k in keys if isinstance(rows.schema[k].dataType, (StructType, ArrayType, MapType))]
    if nested:
        raise ValueError(f"group by plain columns (such as window.start), not by {nested}")
    schema = StructType([*[rows.schema[k] for k in keys], StructField("sketch", BinaryType()),
                         StructField("task", IntegerType()), StructField("seq", IntegerType())])
    out_schema = to_arrow_schema(schema)

    def batch_of(columns: list[pa.Array], blobs: pa.Array, seq: int) -> pa.RecordBatch:
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        marks = [pa.array(np.full(len(blobs), n, dtype=np.int32)) for n in (task, seq)]
        return pa.RecordBatch.from_arrays(
            [a.cast(f.type) for a, f in zip([*columns, blobs, *marks], out_schema)],
            schema=out_schema)

    def hand_on(states: dict, seq: int) -> pa.RecordBatch:
        columns = [pa.array([key[i] for key in states], type=out_schema.field(k).type)
                   for i, k in enumerate(keys)]
        return batch_of(columns, pa.array([s.to_bytes() for s in states.values()], pa.binary()), seq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}
        waiting: list[pa.RecordBatch] = []
        held = seq = groups = 0

        def absorb() -> Iterator[pa.RecordBatch]:
            nonlocal seq, groups
            table = pa.Table.from_batches(waiting).combine_chunks()
            order, starts = grouped_rows(table, keys)
            values = table.column(value).to_numpy()[order]
            sizes = np.diff(starts, append=len(order))
            groups = len(starts)
            if small is not None and groups > MAX_STATES:
                few = sizes < small.limit
                blobs = small.pack(values[np.repeat(few, sizes)],
                                   np.cumsum(sizes[few]) - sizes[few])
                first = pa.array(order[starts[few]])
                packed = batch_of([table.column(k).take(first).combine_chunks() for k in keys],
                                  blobs, seq)
                seq += 1
                for at in range(0, packed.num_rows, OUT_SMALL):
                    yield packed.slice(at, OUT_SMALL)
                starts, sizes = starts[~few], sizes[~few]
            for start, size in zip(starts.tolist(), sizes.tolist()):
                key = tuple(table.column(k)[int(order[start])].as_py() for k in keys)
                if key not in states:
                    if len(states) >= MAX_STATES:
                        yield hand_on(states, seq)
                        seq += 1
                        states.clear()
                    states[key] = new()
                states[key].add(values[start:start + size])

        for batch in batches:
            waiting.append(batch)
            held += batch.num_rows
            if held >= min(MAX_BUFFER_ROWS, max(BUFFER_ROWS, 64 * max(len(states), groups))):
                yield from absorb()
                waiting, held = [], 0
        if held:
            yield from absorb()
        if states:
            yield hand_on(states, seq)

    return rows.mapInArrow(run, schema)


def merge_states(states: DataFrame, keys: Sequence[str],
                 load: Callable[[bytes], object], shares: int = SHARES,
                 small: SmallForm | None = None) -> DataFrame:
    """One state per group out of many, by share of the states first.

    A hot group's states are merged by up to ``shares`` tasks.  Each task reads its
    states sorted by group and holds only the current one, whatever the number of
    groups or of states.

    States of ``reduce_tasks`` are dealt and ordered by task, so a task that runs again
    sends its states where the first run did.  Stored sketches have no task; they are
    dealt and ordered by their bytes, which do not change.
    """
    keys = list(keys)
    order = ["task", "seq"] if "task" in states.columns else ["sketch"]
    by = F.col("task") if "task" in states.columns else F.xxhash64("sketch")
    parts = states.withColumn("_share", F.pmod(by, F.lit(shares)).cast("int"))
    return _merge(_merge(parts, [*keys, "_share"], load, order, small), keys, load, ["_share"], small)


def _same(a: tuple, b: tuple) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


def _merge_small(batch: pa.RecordBatch, keys: list[str],
                 small: SmallForm) -> tuple[pa.RecordBatch | None, pa.RecordBatch]:
    """Merge the groups inside a sorted batch by columns; the merged ones, and the rows left.

    The first and the last group stay, as they may go on in the batches beside.
    """
    starts = np.flatnonzero(np.diff(group_codes(batch, keys), prepend=-1))
    if len(starts) < 3:
        return None, batch
    a, b = int(starts[1]), int(starts[-1])
    sketches, done = small.join(batch.column("sketch").slice(a, b - a), starts[1:-1] - a)
    first = pa.array(starts[1:-1][done])
    merged = pa.RecordBatch.from_arrays(
        [*[batch.column(k).take(first) for k in keys], sketches], names=[*keys, "sketch"])
    left = np.ones(batch.num_rows, dtype=bool)
    left[a:b] = np.repeat(~done, np.diff(starts[1:]))
    return merged, batch.filter(pa.array(left))


def _merge(states: DataFrame, keys: list[str], load: Callable[[bytes], object],
           order: list[str], small: SmallForm | None = None) -> DataFrame:
    columns = [*keys, "sketch"]
    schema = StructType([states.schema[c] for c in columns])
    out_schema = to_arrow_schema(schema)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        current, alone, total = None, None, None

        def close() -> None:
            if current is not None:
                done.append((*current, alone if total is None else total.to_bytes()))

        def flush() -> pa.RecordBatch:
            arrays = [pa.array([row[i] for row in done], type=f.type)
                      for i, f in enumerate(out_schema)]
            return pa.RecordBatch.from_arrays(arrays, schema=out_schema)

        for batch in batches:
            if small is not None and keys:
                merged, batch = _merge_small(batch, keys, small)
                if merged is not None:
                    yield merged.cast(out_schema)
            for *key, data in zip(*[batch.column(c).to_pylist() for c in columns]):
                if current is not None and _same(key, current):
                    if total is None:
                        total = load(alone)
                    total.merge(load(data))
                else:
                    close()
                    current, alone, total = key, data, None
            if len(done) >= OUT_ROWS:
                yield flush()
                done = []
        close()
        if done:
            yield flush()

    spread = states.repartition(*keys) if keys else states.repartition(1)
    return spread.sortWithinPartitions(*keys, *order).select(*columns).mapInArrow(combine, schema)
