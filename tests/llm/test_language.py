from __future__ import annotations

import zlib
from itertools import product

import numpy as np

from llm_fixtures import edge_docs, no_docs  # noqa: F401  (fixtures)

from pairwright.llm import language
from pairwright.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op9_language_id"](spark, folder).collect()
    assert len(got) == len(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_viterbi_equals_all_paths():
    draw = np.random.default_rng(2)
    counts = np.array([1, 4, 0, 6, 3])
    scores = draw.normal(size=(counts.sum(), 3)).astype(np.float32) * 3
    path = language.viterbi(scores, counts, 2.0)
    at = 0
    for n in counts:
        part = scores[at : at + n]

        def worth(states, part=part):
            return sum(part[i, s] for i, s in enumerate(states)) - 2.0 * sum(
                a != b for a, b in zip(states, states[1:], strict=False)
            )

        if n:
            best = max(worth(s) for s in product(range(3), repeat=int(n)))
            assert abs(worth(path[at : at + n].tolist()) - best) < 1e-4
        at += n


def test_spans_of_mixed_text(spark):
    docs = spark.createDataFrame(
        [(i, "the house of the king and the other men", "en") for i in range(0, 60)]
        + [(i, "дом короля и другие люди этого города", "ru") for i in range(60, 120)],
        "doc_id long, text string, lang string",
    )
    model = language.learn(docs)
    text = "the king and the men, люди города и дом"
    spans = language.span_labels(text, model)
    assert [lang for _, _, lang in spans] == ["en", "ru"]
    assert text[spans[0][0] : spans[0][1]] == "the king and the men"
    assert text[spans[1][0] : spans[1][1]] == "люди города и дом"


def test_edge_rows(spark, edge_docs, no_docs):
    model = language.learn(edge_docs)
    got = language.label(edge_docs, model)
    assert got.columns == [*edge_docs.columns, "_lang", "_lang_score"]
    found = [(r.doc_id, r._lang, r._lang_score) for r in got.collect()]
    assert len(found) == edge_docs.count()
    assert {lang for i, lang, _ in found if i in (0, 1, 2, 3)} == {"und"}
    assert {lang for i, lang, _ in found if i not in (0, 1, 2, 3)} <= set(model.languages)
    empty = language.label(no_docs, language.learn(no_docs))
    assert empty.count() == 0
    assert {r._lang for r in language.label(edge_docs, language.Model()).collect()} == {"und"}
