"""Tokens against the libraries, packing against its rules."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from rankflow.llm import packing, tokens

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

SIGNS = [*"ab  \n\n\t.'s1é　\xa0 ▁😀\x1c\x85ñ<>|", "<|endoftext|>", "<s>", "don't", "  ", "▁▁", " word"]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


TEXTS = [None, "", " ", "\n", "a", "  two  spaces ", "word " * 6000, "x" * 9000, *random_texts(300, 4)]


def frame(spark, texts):
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "a b", None), (0, "a", "b")]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, piece string")


def test_token_counts_equal_the_library(spark):
    rows, df = frame(spark, TEXTS)
    model = SentencePieceProcessor(model_file=PIECES)
    want = sorted(((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096)
                   for i, t, _ in rows), key=str)
    assert sorted(map(tuple, tokens.count_tokens(df, PIECES).collect()), key=str) == want
    assert tokens.count_tokens(df.limit(0), PIECES).count() == 0


def test_store_of_counts_may_start_anew(spark, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 5)
    monkeypatch.setattr(tokens, "TOGETHER", 3)
    test_token_counts_equal_the_library(spark)


def test_pieces_equal_the_library(spark, monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 20)
    monkeypatch.setattr(packing, "TOGETHER", 7)
    rows, df = frame(spark, TEXTS)
    library = Tokenizer.from_file(BPE)
    want = []
    for i, t, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        head = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(head, len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                 for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = packing.pack_documents(df, BPE).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) == -(-sum(r.length for r in got) // 2048)
    assert packing.pack_documents(df.limit(0), BPE).count() == 0


def test_ids_of_a_column_are_those_of_the_library(monkeypatch):
    library = Tokenizer.from_file(BPE)
    texts = [*TEXTS, *random_texts(3000, 11), "Yes, it's (so). No!? e.g. 3.5;a", "a\u3000 b\xa0 c\u2009\n d\u180e e é. ü,"]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts[1:]]
    for together, kept in ((packing.TOGETHER, packing.KEPT), (900, 3000)):
        monkeypatch.setattr(packing, "TOGETHER", together)
        monkeypatch.setattr(packing, "KEPT", kept)
        got = [ids[a:b].tolist() for _, ids, cuts in packing.ChunkEncoder(BPE).encode(pa.array(texts).slice(1))
               for a, b in zip(cuts, cuts[1:])]
        assert got == want


def test_words_before_points_are_encoded_once():
    encoder = packing.ChunkEncoder(BPE)
    list(encoder.encode(pa.array([" word word, word. word; word! (word) word\n word", " word", " word, "])))
    # Not one for each sign that may stand behind the word.
    assert sorted(encoder.known.to_pylist()) == sorted([" word", ",", ".", ";", "!", " (word", ")", "\n word", " "])


@pytest.mark.parametrize("kind", ["small", "halves", "mixed", "one"])
def test_packing_rounds(spark, kind):
    rng = random.Random(8)
    lengths = {"small": [rng.randint(1, 600) for _ in range(3000)], "halves": [1100] * 500,
               "mixed": [rng.choice([1500, 700, 548, 90]) for _ in range(2000)], "one": [5]}[kind]
    items = spark.createDataFrame(list(enumerate(lengths)), "item bigint, length bigint")
    got = packing.pack_items(items, 2048, 100).collect()
    assert sorted(r.item for r in got) == list(range(len(lengths)))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, lengths[r.item]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    # Hardly more than all items in one group need.
    whole = 1 + max(b for b, _ in packing.best_fit(lengths, 2048))
    assert len(bins) <= whole * 1.02 + 1


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit([6, 5, 4, 5, 3], 10) == [(0, 0), (1, 0), (0, 6), (1, 5), (2, 0)]
    assert packing.best_fit([], 10) == []
