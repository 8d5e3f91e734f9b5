from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from llm_fixtures import edge_docs, no_docs, small  # noqa: F401  (fixtures)

from pairwright.llm import mixing
from pairwright.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def direct_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            return {s: 2.0 * sizes[s] for s in names}
        level = (total - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in rest)
        over = {s for s in rest if weight[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in names}
        full |= over


def check(rows, texts):
    """``rows``: (doc_id, size, source_size, target, taken); ``texts``: (doc_id, text, source)."""
    sizes = sorted((-1 if i is None else i, len(WORD.findall(t or ""))) for i, t, _ in texts)
    assert sorted((-1 if r[0] is None else r[0], r[1]) for r in rows) == sizes
    by_source: dict = {}
    for _, t, s in texts:
        by_source[s] = by_source.get(s, 0) + len(WORD.findall(t or ""))
    want = direct_targets(by_source)
    source = {i: s for i, _, s in texts}
    taken: dict = {}
    for doc_id, size, source_size, target, words in rows:
        s = source[doc_id]
        assert source_size == by_source[s]
        assert target == pytest.approx(want[s], abs=1e-6)
        assert 0 <= words <= 2 * size
        taken[s] = taken.get(s, 0) + words
    for s, target in want.items():
        assert abs(taken[s] - target) <= 0.5


def test_query_meets_targets_and_repeats(spark, small):
    texts = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    first = sorted(map(tuple, QUERIES["op2_source_mixing"](spark, small).collect()))
    check(first, texts)
    assert first == sorted(map(tuple, QUERIES["op2_source_mixing"](spark, small).collect()))


def test_edge_rows(spark, edge_docs, no_docs):
    texts = [(r.doc_id, r.text, r.source) for r in edge_docs.collect()]
    mix = mixing.mixture(edge_docs, ["doc_id"], block_words=16, bucket_docs=2)
    rows = mix.select("row.doc_id", "size", "source_size", "target", mixing.taken_words(F.col("draws"))).collect()
    check([tuple(r) for r in rows], texts)
    assert mixing.mixture(no_docs, ["doc_id"]).count() == 0
    assert mixing.mixed_documents(no_docs).count() == 0


def test_draws_are_disjoint_and_shards_even(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    draws = mixing.mixture(docs, ["doc_id", "source"], block_words=32, shards=8).selectExpr(
        "row.source", "row.doc_id", "size", "inline(draws)"
    ).collect()
    spans: dict = {}
    blocks: dict = {}
    for d in draws:
        assert 0 <= d.start and d.start + d.words <= d.size
        spans.setdefault((d.doc_id, d["pass"]), []).append((d.start, d.start + d.words))
        blocks.setdefault((d.source, d["pass"], d.block), set()).add(d.shard)
    for parts in spans.values():
        parts.sort()
        assert all(a[1] <= b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert all(len(shards) == 1 for shards in blocks.values())
    each = [0] * 8
    for (shard,) in map(tuple, blocks.values()):
        each[shard] += 1
    assert max(each) - min(each) <= 3  # halves are rounded at each of three levels


def test_mixed_documents_hold_the_words_taken(spark, edge_docs):
    mixed = mixing.mixed_documents(edge_docs, block_words=8)
    assert mixed.columns == edge_docs.columns
    words: dict = {}
    for r in mixed.collect():
        assert r.n_chars == len(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
    rows = mixing.mixture(edge_docs, ["doc_id"], block_words=8).select(
        "row.doc_id", mixing.taken_words(F.col("draws")).alias("n")
    )
    want: dict = {}
    for r in rows.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.n
    assert words == {i: n for i, n in want.items() if n}


def test_hypergeometric_follows_its_distribution(spark):
    good, others, drawn = (F.lit(x).cast("long") for x in (30, 50, 20))
    drawn_rows = spark.range(4000).select(
        mixing.hypergeometric(good, others, drawn, mixing.uniform("id")).alias("x")
    )
    mean, low, high, spread = drawn_rows.agg(F.avg("x"), F.min("x"), F.max("x"), F.stddev("x")).first()
    assert abs(mean - 7.5) < 0.15 and 0 <= low and high <= 20
    assert abs(spread - (20 * 3 / 8 * 5 / 8 * 60 / 79) ** 0.5) < 0.1
    certain = spark.range(1).select(
        *[
            mixing.hypergeometric(*(F.lit(v).cast("long") for v in case), F.lit(0.7))
            for case in ((0, 5, 3), (5, 0, 3), (4, 4, 8), (0, 0, 0), (4, 4, 0))
        ]
    ).first()
    assert tuple(certain) == (0, 3, 4, 0, 0)
