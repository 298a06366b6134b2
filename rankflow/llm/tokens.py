"""Token counts: pieces are counted once per distinct pre-token and joined to frequencies.

A SentencePiece BPE model with byte fallback never joins a word with the space after it, nor
anything with a line feed, as no piece spans them (``check_model`` asserts it).  So a text falls
into pre-tokens, a run of spaces with the word behind it or a line feed, whose counts add up.
A task counts the pieces of each distinct pre-token once, joins the counts to the pre-token
frequencies of each document, and sums; ids are never made for a whole text.

NULL and empty texts have no tokens.  Every row gets its own result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4096
#: Pre-tokens whose counts a task keeps; the store starts anew beyond.
KEPT = 400_000
#: Texts whose new pre-tokens are counted together.
TOGETHER = 500

# Fixed value: the sign that stands for a space in pieces, which texts may hold as well.
SPACE = "▁"
PRE_TOKEN = f"[ {SPACE}]*[^ {SPACE}\n]+|[ {SPACE}]+|\n"


def check_model(model) -> None:
    """Raise unless no piece of the model spans two pre-tokens."""
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if SPACE in piece.lstrip(SPACE) or "\n" in piece:
            raise ValueError(f"piece {piece!r} spans two pre-tokens")


def piece_counts(model, pre_tokens: list[str]) -> list[int]:
    """Pieces of each pre-token.

    The library puts a space in front of what it encodes, so the first space is left to
    it; what has none is counted behind a line feed, which takes two pieces.
    """
    led = [t[0] in (" ", SPACE) for t in pre_tokens]
    asked = [t[1:] if own else "\n" + t for t, own in zip(pre_tokens, led)]
    # A lone space would be an empty text to the library: it is one piece.
    found = model.encode(asked, num_threads=1)
    return [len(ids) - (0 if own else 2) if a else 1 for ids, a, own in zip(found, asked, led)]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row."""
    asked = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    doc_id = asked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_path)
        check_model(model)
        split = re.compile(PRE_TOKEN).findall
        known: dict[str, int] = {}
        for batch in batches:
            sizes, counts = [], []
            for start in range(0, batch.num_rows, TOGETHER):
                freqs = []
                for value in batch.column("text").slice(start, TOGETHER):
                    body = value.as_py() or ""
                    sizes.append(len(body.encode("utf-8", "surrogatepass")))
                    # The library sees every text but the empty one behind a space.
                    freqs.append(Counter(split(" " + body)) if body else {})
                if len(known) > KEPT:
                    known.clear()
                new = list({t for f in freqs for t in f if t not in known})
                known.update(zip(new, piece_counts(model, new)))
                counts += [sum(known[t] * n for t, n in f.items()) for f in freqs]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return asked.mapInArrow(
        run, f"doc_id {doc_id}, n_bytes bigint, n_tokens bigint, over_limit boolean")
