from __future__ import annotations

import random
import zlib
from itertools import combinations_with_replacement

import numpy as np
import pytest
from tokenizers import Tokenizer

from llm_fixtures import edge_docs, no_docs, small  # noqa: F401  (fixtures)

from pairwright.llm import packing
from pairwright.llm.queries import QUERIES, TOKENIZER


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def check(pieces, texts, tokenizer, capacity=4096):
    """``texts``: one text for each row, in any order, by id."""
    ids = [
        (i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in texts
    ]
    want = sorted(
        (-1 if i is None else i, s, len(v[s : s + capacity]), zlib.crc32(v[s : s + capacity].tobytes()), len(v))
        for i, v in ids
        for s in range(0, len(v), capacity)
    )
    got = sorted(
        (-1 if p.doc_id is None else p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces
    )
    assert got == want
    windows: dict[int, list] = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for placed in windows.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return windows


def test_query_round_trip(spark, small, tokenizer):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    pieces = QUERIES["op6_packing"](spark, small).collect()
    windows = check(pieces, texts, tokenizer)
    used = {s: sum(n for _, n in w) for s, w in windows.items()}
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in used.values())
    assert padding <= 0.03 * sum(used.values())


def test_edge_rows(spark, edge_docs, no_docs, tokenizer):
    pieces = packing.pack(edge_docs, TOKENIZER, bucket=2).collect()
    check(pieces, [(r.doc_id, r.text) for r in edge_docs.collect()], tokenizer)
    assert packing.pack(no_docs, TOKENIZER).count() == 0


def test_words_encode_like_whole_texts(tokenizer):
    words = packing.WordTokenizer(TOKENIZER)
    texts = [
        "It's they're I'LL x's don't.", "naïve CAFÉ ÀÉÎ ſtraße ß ÿ", "１２３ ½ abc123 a1b2", "école école",
        "<|endoftext|> a<|startoftext|>b", "日本語 한국어", "\x00\x01 \x1c \x85 \xa0x y", "###$$$ --- a--b",
        "İstanbul ΣΑΣ", "word.'s (a) [b] {c}", "a" * 3000, "",
    ]
    for text, ids in zip(texts, words.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_best_sum_against_all_multisets():
    draw = random.Random(4)
    for _ in range(60):
        counts = {draw.randint(1, 12): draw.randint(1, 3) for _ in range(4)}
        room = draw.randint(0, 30)
        items = sorted(counts)
        best = max(
            sum(c)
            for k in range(sum(counts.values()) + 1)
            for c in combinations_with_replacement(items, k)
            if sum(c) <= room and all(c.count(x) <= counts[x] for x in items)
        )
        total, used = packing.best_sum(counts, room, ())
        assert total == best == sum(x * n for x, n in used.items())
        assert all(n <= counts[x] for x, n in used.items())


def test_plan_uses_every_piece_once():
    draw = random.Random(5)
    counts = {draw.randint(1, 64): draw.randint(1, 500) for _ in range(40)}
    plan = packing.plan_windows(counts, 64)
    used: dict[int, int] = {}
    for times, window in plan:
        assert sum(x * n for x, n in window.items()) <= 64
        for x, n in window.items():
            used[x] = used.get(x, 0) + times * n
    assert used == counts
    assert packing.plan_windows({}, 64) == []
