from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from llm_fixtures import edge_docs, no_docs, small  # noqa: F401  (fixtures)

from pairwright.llm import toxicity
from pairwright.llm.queries import QUERIES


def test_gradients_are_those_of_the_loss():
    text = toxicity.windows(["you idiot moron this is fine " * 20, "hello world nice day", "", "été à la plage " * 30])
    network = toxicity.Network()
    network.p = {name: value.astype(np.float64) for name, value in network.p.items()}
    picked = np.arange(len(text.slots))
    wanted = (picked % 2).astype(float)
    _, grad = network.gradients(text, picked, wanted)
    for name, value in network.p.items():
        flat, slope = value.reshape(-1), grad[name].reshape(-1)
        for i in np.argsort(-np.abs(slope))[:2]:
            old, step = flat[i], 1e-3
            flat[i] = old + step
            above, _ = network.gradients(text, picked, wanted)
            flat[i] = old - step
            below, _ = network.gradients(text, picked, wanted)
            flat[i] = old
            assert (above - below) / (2 * step) == pytest.approx(slope[i], rel=0.01, abs=1e-5), name


def test_windows_cover_every_word():
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(333)]
    text = toxicity.windows([" ".join(words), None, "one"])
    assert text.doc.tolist().count(1) == 1 and text.doc.tolist().count(2) == 1
    seen = set(text.slots[text.doc == 0].ravel().tolist()) - {-1}
    assert len(seen) == len(set(words))
    starts = np.flatnonzero(text.doc == 0)
    assert len(starts) == 1 + -(-(333 - toxicity.WINDOW) // toxicity.STRIDE)


def synthetic(n, seed):
    draw = random.Random(seed)
    plain = "the house and river under green tall quiet mountain road with some old stones".split()
    texts, labels = [], []
    for i in range(n):
        words = [draw.choice(plain) for _ in range(draw.randint(1, 300))]
        if i % 3 == 0:
            for _ in range(draw.randint(1, 4)):
                words.insert(draw.randrange(len(words) + 1), "grumpf" + draw.choice("aeiou") * draw.randint(1, 3))
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return texts, np.array(labels)


def test_held_out_texts_are_told_apart():
    texts, labels = synthetic(240, 1)
    model = toxicity.train(texts, labels)
    fresh, truth = synthetic(150, 2)
    score = toxicity.score_texts(model, fresh)
    assert ((score >= toxicity.THRESHOLD) == (truth == 1)).mean() >= 0.95
    # one toxic window in a very long text is found, and order of texts does not matter
    long = " ".join([*["quiet river"] * 4000, "grumpfaa", *["green stones"] * 4000])
    assert toxicity.score_texts(model, [long])[0] >= toxicity.THRESHOLD
    assert np.allclose(toxicity.score_texts(model, fresh[::-1])[::-1], score, atol=1e-5)


def test_query_and_edge_rows(spark, small, edge_docs, no_docs):
    rows = QUERIES["op4_toxicity"](spark, small).collect()
    assert len(rows) == 200
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    texts, labels = synthetic(60, 3)
    model = toxicity.train(texts, labels, epochs=2)
    got = toxicity.score(edge_docs, model).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(no_docs, model).count() == 0
    labels = spark.createDataFrame([(1, None, None), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    nothing = toxicity.learn(edge_docs, labels)
    assert nothing.network is None
    assert {r.score for r in toxicity.score(edge_docs, nothing).collect()} == {0.0}


def test_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    """Many and huge texts of an id, an id with both labels: what reaches the driver is bounded."""
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"text {i} of some words", 0) for i in ids]
    rows += [(ids[0], f"another text {n}", 0) for n in range(500)]
    rows += [(ids[1], "x" * 4_001, 0), (ids[2], "y" * 100_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    labels = spark.createDataFrame(
        [(i, int(i % 4 == 0)) for i in ids] + [(ids[3], 0), (ids[3], 1)], "doc_id long, toxic int"
    )
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: seen.append((texts, toxic.tolist())))
    toxicity.learn(docs, labels, sample_bytes=32_000)
    texts, toxic = seen[0]
    assert len(texts) == len(ids) - 1 and f"text {ids[3]} of some words" not in texts
    assert f"text {ids[1]} of some words" in texts and max(map(len, texts)) <= 4_000
    assert toxic == [int(i % 4 == 0) for i in ids if i != ids[3]]
    toxicity.learn(docs, labels, sample_bytes=400)
    assert 0 < sum(map(len, seen[1][0])) <= 400
    toxicity.learn(docs.unionByName(docs), labels, sample_bytes=32_000)
    assert seen[2] == seen[0]
