"""Ids and counts against the tokenizers library on whole texts."""

import random
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meshloom.llm import units
from meshloom.llm.pairs import MergeTable, merge_block
from meshloom.llm.token_counts import PieceCounts
from meshloom.llm.units import ByteUnits, WordUnits, kept

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BYTE_LIBRARY, WORD_LIBRARY = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)

ODD = [
    "", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "\n\na\n", "a  b", "a   b", "\x1c a\x1cb", "!\x1c!", "don't  I'LL 'S", "<|endoftext|>", "x<|endoftext|> y <|endoftext|>",
    "<|startoftext|>A<|ENDOFTEXT|>", "a<|b", "Ünïcödé ÉÀ ß İI ı", "é ́a", "ΑΣ Σς οδοσ", "中文 字 テスト", "👍🏽 👩‍👩‍👧", "12345 ½²", "aaaa" * 50, "ab" * 300, "the the the", "՘֋", "\U0010940a",
    "tab\tand\x0bvt\x0cff\rcr", "a  b　c", "x" * 5000, "﻿bom", "a.b,c;d", "  lead", "trail  ",
]


@cache
def made(cls, path):
    """An encoder for all cases; a worker would hold one kind at a time."""
    return cls(path)


def check(texts):
    raw = [t.encode() for t in texts]
    for cls, path, library in ((ByteUnits, BYTE, BYTE_LIBRARY), (WordUnits, WORD, WORD_LIBRARY)):
        ids, sizes = made(cls, path).encode(raw)
        ends = np.cumsum(sizes)
        for t, n, b in zip(texts, sizes, ends, strict=True):
            want = library.encode(t, add_special_tokens=False).ids
            assert ids[b - n : b].tolist() == want, (cls, t)
            if cls is ByteUnits:
                assert made(cls, path).table.decode(ids[b - n : b]).decode(errors="replace") == library.decode(want, skip_special_tokens=False)
    assert made(PieceCounts, BYTE).count(raw).tolist() == [len(BYTE_LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts]


def test_odd_texts():
    check(ODD)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t aAbeéßÉ'sStl.,<|>endoftext1²İΣ  ́中😀\x1c\x85"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_any_text(texts):
    check(texts)


def test_long_text_in_segments(monkeypatch):
    monkeypatch.setattr(units, "SEGMENT", 50)
    rng = random.Random(1)
    words = ["alpha", "beta\n", "Gamma,", "é", "<|endoftext|>", " ", "", "x|", "y>", "don't"]
    check([" ".join(rng.choice(words) for _ in range(400)) for _ in range(5)])


def test_small_tables_change_nothing():
    texts = [f"word{i} other{i % 7} é{i}" for i in range(200)]
    small = ByteUnits(BYTE, limit=5, pieces_limit=3)
    want = [BYTE_LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert [small.encode([t.encode()])[0].tolist() for t in texts] == want
    assert [PieceCounts(BYTE, limit=5, pieces_limit=3).count([t.encode()])[0] for t in texts[:9]] == [len(w) for w in want[:9]]
    small = PieceCounts(BYTE, limit=5, pieces_limit=3)
    assert [small.count([t.encode()])[0] for t in texts] == list(map(len, want))
    small = WordUnits(WORD, limit=5, pieces_limit=3)
    assert [small.encode([t.encode()])[0].tolist() for t in texts] == [WORD_LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_merge_block_is_plain_merging():
    table = MergeTable(BYTE)
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"aabbcthe ") for _ in range(rng.randrange(0, 12))) for _ in range(500)]

    def plain(piece):
        symbols = [int(table.byte_ids[b]) for b in piece]
        while True:
            ranks = [int(table.rank(np.array([a]), np.array([b]))[0]) for a, b in zip(symbols, symbols[1:], strict=False)]
            known = [r for r in ranks if r >= 0]
            if not known:
                return symbols
            i = ranks.index(min(known))
            symbols[i : i + 2] = [int(table.made[ranks[i]])]

    ids, sizes = merge_block(table, pieces)
    ends = np.cumsum(sizes)
    assert [ids[b - n : b].tolist() for n, b in zip(sizes, ends, strict=True)] == [plain(p) for p in pieces]


@pytest.mark.parametrize("size", [1, 10, 10**9])
def test_blocks_hold_all_rows(size):
    batch = pa.RecordBatch.from_arrays([pa.array([b"abc", b"", b"abcdefgh", b"x"], pa.binary())], names=["utf8"])
    assert [x for b in units.blocks([batch, batch.slice(0, 0)], size) for x in b.column("utf8").to_pylist()] == [b"abc", b"", b"abcdefgh", b"x"]


def test_a_worker_holds_one_encoder():
    first = kept(ByteUnits, BYTE)
    assert kept(ByteUnits, BYTE) is first and len(units._KEPT) == 1
    kept(WordUnits, WORD)
    assert len(units._KEPT) == 1 and kept(ByteUnits, BYTE) is not first
