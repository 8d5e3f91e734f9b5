"""Factorisation machine: identity, gradients, learning and edge rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from llm_fixtures import edge_docs, no_docs, small  # noqa: F401  (fixtures)

from pairwright.llm import quality
from pairwright.llm.queries import QUERIES


def some_features():
    texts = ["The cat sat.\nTHE CAT!! 12", "", None, "a a a a a | b | c", "é ü ñ " * 40]
    return quality.features([t.encode() if t is not None else None for t in texts], np.array([5, -1, 0, 1 << 40, 240]))


def test_sum_of_squares_identity():
    draw = np.random.default_rng(1)
    model = quality.Model(0.3, draw.normal(size=quality.WIDTH), draw.normal(size=(quality.WIDTH, 4)))
    x = some_features()
    got = quality.logits(model, x)
    for i, z in enumerate(got):
        at = slice(x.start[i], x.start[i + 1])
        index, value = x.index[at], x.value[at].astype(float)
        want = 0.3 + value @ model.linear[index]
        for a in range(len(index)):
            for b in range(a):
                want += value[a] * value[b] * (model.vectors[index[a]] @ model.vectors[index[b]])
        assert z == pytest.approx(want, rel=1e-5, abs=1e-5)


def test_gradients():
    draw = np.random.default_rng(2)
    model = quality.Model(0.1, draw.normal(size=quality.WIDTH) / 4, draw.normal(size=(quality.WIDTH, 3)) / 4)
    x, y, w = some_features(), np.array([1, 0, 1, 0, 1.0]), np.array([1, 2, 0.5, 1, 1.0])
    loss, bias, linear, vectors = quality.gradients(model, x, y, w)
    step = 1e-4
    for index in draw.choice(np.unique(x.index), 12, replace=False):
        for table, total in ((model.linear, linear[x.index == index].sum()), (model.vectors[:, 1], vectors[x.index == index, 1].sum())):
            table[index] += step
            more = quality.gradients(model, x, y, w)[0]
            table[index] -= 2 * step
            less = quality.gradients(model, x, y, w)[0]
            table[index] += step
            assert (more - less) / (2 * step) == pytest.approx(total, rel=2e-3, abs=2e-4)
    model.bias += step
    assert (quality.gradients(model, x, y, w)[0] - loss) / step == pytest.approx(bias, rel=1e-2, abs=1e-3)


def test_statistics_of_parts():
    """Grouping texts changes no feature, and a shouted stretch in a long text shows."""
    texts = [b"plain words of some text " * 30, b"plain words " * 60 + b"SHOUTED!! WORDS!! " * 20, b"x"]
    sizes = np.array([3, 4, 5])
    whole, parts = quality.features(texts, sizes), quality.features_in_groups(texts, sizes)
    assert (whole.index == parts.index).all() and (whole.value == parts.value).all() and (whole.start == parts.start).all()

    def bin_of(i, name):
        base = (1 << quality.WORD_BITS) + quality.STATISTICS.index(name) * quality.BINS
        own = whole.index[whole.start[i] : whole.start[i + 1]]
        return int(own[(own >= base) & (own < base + quality.BINS)][0]) - base

    assert bin_of(0, "worst upper") == 0 and bin_of(1, "worst upper") > bin_of(1, "upper") > 0


def test_query_is_learnt_and_equals_direct_scores(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op13_quality_classifier"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn(docs, labels)
    rows = docs.collect()
    assert len(got) == len(rows)
    want = quality.score_texts(model, [r.text.encode() for r in rows], np.array([r.n_chars for r in rows]))
    for r, score in zip(rows, want, strict=True):
        mine = got[r.doc_id]
        assert mine.score == pytest.approx(score, abs=1e-9) and 0 <= mine.score <= 1
        assert mine.predicted == int(mine.score >= 0.5)
        assert mine.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    judged = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = ([s for s, q in judged if q == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.98


def test_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(11)] + [(None, 1), (3, None)], "doc_id long, quality int")
    scores = quality.score(edge_docs, quality.learn(edge_docs, labels)).collect()
    assert len(scores) == edge_docs.count() and all(0 <= r.score <= 1 for r in scores)
    empty = quality.learn(no_docs, labels)
    assert {r.score for r in quality.score(edge_docs, empty).collect()} == {0.5}
    assert quality.score(no_docs, empty).count() == 0
