"""Collocations against direct counts."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from llm_fixtures import edge_docs, no_docs, small  # noqa: F401  (fixtures)

from pairwright.llm import collocations as C


def phrases(docs, depth=4):
    """Counts by (lang, phrase), and words by lang."""
    counts, words = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in range(1, depth + 1):
                for i in range(len(w) - n + 1):
                    counts[lang, " ".join(w[i : i + n])] += 1
    return counts, words


def direct(docs, least=30, top=2000):
    counts, words = phrases(docs)
    rows = []
    for (lang, phrase), a in counts.items():
        w = phrase.split(" ")
        if a < least or len(w) < 2:
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = counts[lang, " ".join(w[:k])], counts[lang, " ".join(w[k:])]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        covered = any(
            other[0] == lang and f >= least and 100 * f >= 80 * a and f" {phrase} " in f" {other[1]} " and other[1] != phrase
            for other, f in counts.items()
        )
        if not covered:
            rows.append((lang, phrase, a, left, right, words[lang], score))
    rows.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    out, seen = [], Counter()
    for r in rows:
        seen[r[0]] += 1
        if seen[r[0]] <= top:
            out.append((r[0], seen[r[0]], *r[1:]))
    return out


def texts(n=120, seed=3):
    draw = random.Random(seed)
    words = ["Aé", "b", "cc", "d\x0bE", "f", "G\xa0g", "h-h", "日本"]
    weights = [9, 7, 5, 3, 3, 2, 2, 1]
    docs = []
    for i in range(n):
        parts = draw.choices(words, weights, k=draw.randint(0, 60))
        docs.append((draw.choice(["x", "y", None]), "".join(w + draw.choice([" ", " ", "\t", "  ", ", ", ".", "\n"]) for w in parts)))
    return [*docs, ("x", None), (None, ""), ("z", "one two three")]


def rows(frame):
    return sorted((tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("shard_words,buckets,partitions", [(10**6, 10**6, 1), (60, 100, 5), (1, 10**6, 3)])
def test_equals_direct_counts(spark, monkeypatch, shard_words, buckets, partitions):
    monkeypatch.setattr(C, "BUCKET_WORDS", buckets)
    docs = texts()
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(partitions)
    got = rows(C.collocations(frame, least=5, top=40, shard_words=shard_words))
    assert got == direct(docs, 5, 40) and len(got) > 40


def test_extensions_of_phrases(spark):
    docs = texts(60, 5)
    frame = spark.createDataFrame(docs, "lang string, text string")
    counts, words = phrases(docs)
    totals, found = C.ngrams(frame, least=4)
    assert {r["lang"]: r["all_words"] for r in totals.collect()} == {k: v for k, v in words.items() if v}
    got = {(r["lang"], r["phrase"]): (r["n"], r["left"], r["right"]) for r in found.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: n for k, n in counts.items() if n >= 4}
    for (lang, phrase), (_, left, right) in got.items():
        w = phrase.split(" ")
        if len(w) == 2:
            before = sum(n for (l, p), n in counts.items() if l == lang and p.count(" ") == 2 and p.endswith(" " + phrase) and counts[l, " ".join(p.split(" ")[:2])] >= 4)
            after = sum(n for (l, p), n in counts.items() if l == lang and p.count(" ") == 2 and p.startswith(phrase + " ") and counts[l, " ".join(p.split(" ")[1:])] >= 4)
            assert (left, right) == (before, after)


def test_packed_ids():
    ids = np.array([0, 1, 127, 128, 16383, 16384, 1 << 21, (1 << 31) - 1, 5])
    assert (C.unpacked(C.packed(ids)) == ids).all() and len(C.unpacked(b"")) == 0
    keys = np.array([0, 1, (1 << 48) - 1, 1 << 47], np.uint64)
    assert (C.keys_from_bytes(C.keys_to_bytes(keys)) == keys).all()


def test_intervals_count_every_phrase():
    draw = np.random.default_rng(2)
    ids = C.parted(draw.integers(0, 5, 500), np.ones(500, bool))
    index = C.Index(ids)
    found = index.single()
    for left in (False, True, False):
        found = index.extended(found, left)
        k = found.words.shape[1]
        want = Counter(tuple(w) for w in np.lib.stride_tricks.sliding_window_view(ids, k).tolist() if 0 not in w)
        assert {tuple(w): n for w, n in zip(found.words.tolist(), found.size.tolist())} == want


def test_edge_rows(spark, edge_docs, no_docs):
    docs = [(r.lang, r.text) for r in edge_docs.collect()]
    assert rows(C.collocations(edge_docs, least=2)) == direct(docs, 2)
    assert rows(C.collocations(no_docs)) == []
