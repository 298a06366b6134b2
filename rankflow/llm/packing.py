"""Packing documents into sequences: best fit in groups, then a tree over what is underfull.

A document is its token ids and an end id.  One that is longer than a sequence is cut into
full pieces, with the rest as its first piece.  Full pieces are sequences of their own; the
others are packed in rounds.  In a round, groups of about ``GROUP`` items are packed by best
fit, the longest first.  Bins that are nearly full leave; the others are the items of the
next round, in fewer groups, each of which takes in the bins of its children in the tree.
The rounds end when a single group is left, or when a round saves under one bin in
``SAVES``, as more rounds could not help (such as when all items are over half a sequence).

The items of a round are a table in the shared folder.  A group is bounded whatever the
input.  NULL texts are empty, and a document without text is its end id alone.  Repeated
rows are documents of their own.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.words import flat, pieces
from rankflow.scratch import stage

LENGTH = 2048
END_ID = 0
#: Items of a group, on average, and tokens that a nearly full bin may lack.
GROUP = 4_000
LACKS = 8
SAVES = 200
#: Bytes of chunks and ids that a task keeps; the store starts anew beyond.
KEPT = 64 << 20
#: Bytes of text taken together, unless a single text is longer.
TOGETHER = 4 << 20
#: Chunks that are given to the tokenizer at once.
LEARNT = 1000

# White space as the tokenizer's pattern knows it.
WHITE = "\t-\r \x85\xa0  -     　"
#: Chunks that can be encoded together: one sign of ASCII white space and a word.
SINGLE = f"\\A[\t-\r ][^{WHITE}]+\\z"
#: The white space past ASCII, as the numbers that its two or three bytes make.
FAR = np.array([int.from_bytes(chr(c).encode(), "big") for c in (
    0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])

_bytes = np.arange(256)
IS_WHITE = ((_bytes >= 9) & (_bytes <= 13)) | (_bytes == 32)
#: Bytes that may end a word; letters, and signs that never belong to the letters before them.
ENDS_WORD = _bytes > 32
IS_LETTER = ((_bytes >= 65) & (_bytes <= 90)) | ((_bytes >= 97) & (_bytes <= 122))
IS_POINT = np.isin(_bytes, list(b".,;:!?)"))


def chunk_starts(text: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where chunks begin in the bytes of some texts, which themselves begin at ``rows``.

    A chunk begins at each sign of ASCII white space behind a word, at each point or comma behind
    an ASCII letter, and with each text.  The tokenizer never joins a word with the white space
    or letters with the point after them, so the ids of chunks add up.
    """
    begins = IS_WHITE[text]
    begins[1:] &= ENDS_WORD[text[:-1]]
    # Behind white space past ASCII the run of white space goes on.
    foreign = 1 + np.flatnonzero(begins[1:] & (text[:-1] >= 128))
    two = (text[foreign - 2].astype(np.int64) << 8) | text[foreign - 1]
    three = (text[foreign - 3].astype(np.int64) << 16) | two
    begins[foreign[np.isin(two, FAR) | np.isin(three, FAR)]] = False
    begins[1:] |= IS_POINT[text[1:]] & IS_LETTER[text[:-1]]
    begins[rows[rows < len(text)]] = True
    return np.flatnonzero(begins)


class ChunkEncoder:
    """Ids of texts, with the ids of each distinct chunk made once."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        # Whether an id begins with ASCII white space; pieces write those bytes 256 up.
        vocabulary = self.tokenizer.get_vocab()
        white = {chr(256 + b) for b in b"\t\n\v\f\r "}
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for piece, i in vocabulary.items() if piece[0] in white]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids = np.zeros(0, dtype="<u4")
        self.at = np.zeros(1, dtype=np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in found]

    def _learn(self, chunks: pa.Array) -> np.ndarray:
        """Add new chunks and return the order they were added in.  Those of one white sign and

        a word are encoded in one text and told apart by the ids that begin with white space."""
        single = pc.match_substring_regex(chunks, SINGLE).to_numpy(zero_copy_only=False)
        easy, rest = np.flatnonzero(single), [np.flatnonzero(~single)]
        order, found, sizes = [], [self.ids], []
        for start in range(0, len(easy), LEARNT):
            part = easy[start:start + LEARNT]
            ids = self._ids([flat(chunks.take(part))[0].tobytes().decode()])[0]
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) == len(part) and cuts[0] == 0:
                order.append(part)
                found.append(ids)
                sizes.append(np.diff(cuts, append=len(ids)))
            else:
                rest.append(part)
        left = np.concatenate(rest)
        for start in range(0, len(left), LEARNT):
            each = self._ids(chunks.take(left[start:start + LEARNT]).to_pylist())
            found += each
            sizes.append(np.array([len(ids) for ids in each]))
        added = np.concatenate([*order, left])
        self.known = pa.concat_arrays([self.known, chunks.take(added)])
        self.ids = np.concatenate(found)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(sizes))])
        return added

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(first row, little-endian unsigned 32-bit ids, where each row's begin)`` per piece."""
        body, at = flat(column)
        for first, last in pieces(at, TOGETHER):
            text, cut = body[at[first]:at[last]], at[first:last + 1] - at[first]
            if not len(text):
                yield first, self.ids[:0], cut
                continue
            starts = chunk_starts(text, cut[:-1])
            chunks = pa.LargeStringArray.from_buffers(
                len(starts), pa.py_buffer(np.append(starts, len(text))), pa.py_buffer(text)
            ).dictionary_encode()
            if self.known.nbytes + self.ids.nbytes + self.at.nbytes > KEPT:
                self._forget()
            # Where the store has each distinct chunk; those it does not have are added behind.
            place = pc.index_in(chunks.dictionary, value_set=self.known).fill_null(-1).to_numpy().copy()
            new = np.flatnonzero(place < 0)
            if len(new):
                behind = len(self.known) + np.arange(len(new))
                place[new[self._learn(chunks.dictionary.take(new))]] = behind
            place = place[chunks.indices.to_numpy()]
            size = np.diff(self.at)[place]
            ends = np.r_[0, np.cumsum(size)]
            spots = np.repeat(self.at[place] - ends[:-1], size)
            spots += np.arange(len(spots))
            yield first, self.ids[spots], ends[np.searchsorted(starts, cut)]


def cut_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text",
                  length: int = LENGTH) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``."""
    asked = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    doc_id = asked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(tokenizer_path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            rows, piece, start, size, crc = [], [], [], [], []
            for first, found, cuts in encoder.encode(batch.column("text")):
                cuts = cuts.tolist()
                for row, (begin, stop) in enumerate(zip(cuts, cuts[1:]), first):
                    ids = found[begin:stop].tobytes() + end
                    n = len(ids) // 4
                    at, k = 0, 0
                    while at < n:
                        m = (n - 1) % length + 1 if k == 0 else length
                        rows.append(row)
                        piece.append(k)
                        start.append(at)
                        size.append(m)
                        crc.append(zlib.crc32(ids[4 * at:4 * (at + m)]))
                        at, k = at + m, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                 *[pa.array(x, pa.int64()) for x in (start, size, crc)]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return asked.mapInArrow(
        run, f"doc_id {doc_id}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """``(bin, offset)`` of each item: the longest first, each into the fullest bin it fits."""
    open_bins: dict[int, list[int]] = defaultdict(list)  # by room left
    rooms = 0  # bit r is set if a bin has room r
    count, placed = 0, [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen, count = capacity, count, count + 1
        placed[i] = (chosen, capacity - room)
        left = room - need
        if left:
            open_bins[left].append(chosen)
            rooms |= 1 << left
    return placed


def _round(items: DataFrame, number: int, capacity: int) -> DataFrame:
    """``item, bin, offset, filled, grp`` after one round of ``item, length, grp``."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("item", "ascending")])
        lengths = table.column("length").to_pylist()
        placed = best_fit(lengths, capacity)
        bins = np.array([b for b, _ in placed], dtype=np.int64)
        filled = np.bincount(bins, weights=lengths).astype(np.int64)
        grp = table.column("grp")
        name = (number << 56) + (grp.to_numpy() << 24) + bins
        return pa.table({"item": table.column("item"), "bin": name,
                         "offset": np.array([o for _, o in placed], dtype=np.int64),
                         "filled": filled[bins], "grp": grp})

    return items.groupBy("grp").applyInArrow(
        pack, "item bigint, bin bigint, offset bigint, filled bigint, grp bigint")


def pack_items(items: DataFrame, capacity: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``item, sequence_id, offset`` of ``item, length`` (shorter than ``capacity``)."""
    n = items.count()
    groups = max(1, -(-n // group))
    todo = items.select("item", "length", F.pmod(F.xxhash64("item"), F.lit(groups)).alias("grp"))
    rounds: list[DataFrame] = []
    while True:
        placed = stage(_round(todo, len(rounds), capacity), "bins")
        rounds.append(placed)
        bins = placed.groupBy("bin", "grp").agg(F.max("filled").alias("length")).where(
            F.col("length") < capacity - LACKS)
        left = bins.count()
        if groups == 1 or not left or (len(rounds) > 1 and before - left < before / SAVES):
            break
        before, wider = left, max(1, -(-left // group))
        # Neighbouring groups of the tree share a parent.
        parent = F.floor(F.col("grp") * wider / groups).cast("bigint")
        # A shuffle within a parent's reach would bring nothing if it has the same children.
        todo = bins.select(F.col("bin").alias("item"), "length",
                           parent.alias("grp") if wider < groups else
                           F.pmod(F.xxhash64("bin"), F.lit(wider)).alias("grp"))
        groups = wider
    result = rounds[-1].select("item", F.col("bin").alias("sequence_id"), "offset")
    for placed in reversed(rounds[:-1]):
        later = result.select(F.col("item").alias("bin"), "sequence_id",
                              F.col("offset").alias("_shift"))
        result = stage(placed.join(later, "bin", "left").select(
            "item", F.coalesce("sequence_id", "bin").alias("sequence_id"),
            (F.col("offset") + F.coalesce("_shift", F.lit(0))).alias("offset")), "packed")
    return result


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                   text: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    # The number of a piece is fixed by the table it is written to.
    pieces = stage(cut_documents(docs, tokenizer_path, id_col, text, length).withColumn(
        "item", F.monotonically_increasing_id()), "pieces")
    packed = pack_items(pieces.where(F.col("length") < length).select("item", "length"), length)
    return pieces.join(packed, "item", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("sequence_id", -1 - F.col("item")).alias("sequence_id"),
        F.coalesce("offset", F.lit(0)).alias("offset"))
