"""Language of whole texts, and of the spans of a text that mixes languages.

Script ranges narrow the languages a word can be in. Each word gets the log probability of
its letter trigrams in every language left; Viterbi finds the best sequence of languages
under a penalty for each switch. The language of a document is the one with most letters in
that sequence, ties to the first by name; the score is its share of the letters times the
certainty of its words (the mean log odds against the next language, squashed to 0..1).

Learning: letter trigram counts of at most about ``sample_docs`` labelled documents for each
language, chosen by a digest of doc_id and counted in Spark; the driver gets the table of
``2**bits`` counts by language.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. With nothing to
learn from, every text is ``und``. A text whose script belongs to no learned language gets
the learned language that its trigrams favour, with low score. Rows with a null language are
not learned from. Repeated rows are labelled alike. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairwright.llm.words import SCRIPTS, Words, grouped, split_words, trigrams, trimmed

BITS = 16
SAMPLE_DOCS = 1000
SWITCH = 8.0  # log penalty of a change of language between words
SCRIPT_SHARE = 0.002  # least share of a language's letters for a script to be one of its own
IMPOSSIBLE = np.float32(-1e4)
LABEL_CHARS = 1 << 21  # of texts labelled at once: a step of all costs little more than of few


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    trigram: np.ndarray | None = None  # (2**bits, languages) log probabilities
    own: np.ndarray | None = None  # (scripts, languages) whether a language can hold a script


def held_out(doc_id) -> F.Column:
    """Rows never learned from: CRC-32 of the decimal doc_id leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _count_batches(languages: list[str], bits: int):
    index = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(languages) << bits, np.int64)
        script = np.zeros((len(languages), len(SCRIPTS)), np.int64)
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(0)), 0).to_numpy(False)
            for a, b in grouped(sizes):
                words = split_words(batch.column(0)[a:b].to_pylist())
                if not len(words.doc):
                    continue
                lang = np.array([index[x] for x in batch.column(1)[a:b].to_pylist()])[words.doc]
                gram, _ = trigrams(words, bits)
                counts += np.bincount(
                    (np.repeat(lang, words.sizes) << bits) + gram, minlength=len(counts)
                )
                np.add.at(script, (lang, words.scripts), words.sizes)
        for table, offset in ((counts, 0), (script.ravel(), len(counts))):
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at + offset), pa.array(table[at])], ["cell", "n"]
            )

    return run


def learn(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
    bits: int = BITS,
) -> Model:
    """Trigram tables of the languages in ``lang``, from rows that are not held out."""
    labelled = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    ).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    there = dict(labelled.groupBy("lang").count().collect())
    languages = sorted(there)
    if not languages:
        return Model()
    # a digest below this share of its range: about sample_docs of each language
    share = F.create_map(
        *[F.lit(x) for name in languages for x in (name, min(1.0, sample_docs / there[name]))]
    )
    digest = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 40)) / float(1 << 40)
    sample = labelled.filter(F.coalesce(digest < share[F.col("lang")], F.lit(False)))
    cells = (
        sample.select("text", "lang")
        .mapInArrow(trimmed(_count_batches(languages, bits)), "cell long, n long")
        .groupBy("cell")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    k = len(languages)
    table = np.zeros((k << bits) + k * len(SCRIPTS))
    table[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    counts = table[: k << bits].reshape(k, 1 << bits)
    script = table[k << bits :].reshape(k, len(SCRIPTS))
    smooth = 0.05
    total = counts.sum(axis=1, keepdims=True)
    trigram = np.log((counts + smooth) / (total + smooth * (1 << bits))).T.astype(np.float32)
    own = (script >= SCRIPT_SHARE * script.sum(axis=1, keepdims=True)) & (script > 0)
    return Model(languages, np.ascontiguousarray(trigram), own.T.copy())


def word_scores(words: Words, model: Model) -> np.ndarray:
    """``(words, languages)`` log probabilities; languages without the script are ruled out."""
    bits = len(model.trigram).bit_length() - 1
    gram, first = trigrams(words, bits)
    scores = np.add.reduceat(model.trigram[gram], first, axis=0)
    ruled_out = ~model.own
    ruled_out[ruled_out.all(axis=1)] = False  # a script of no language rules none out
    scores[ruled_out[words.scripts]] += IMPOSSIBLE
    return scores


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word. ``scores`` holds text after text, ``counts`` words each.

    All texts advance together, one word a step; the longest come first, so the texts still
    running are a prefix.
    """
    n, k = scores.shape
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    starts = (np.cumsum(counts) - counts)[order]
    steps = int(sizes[0]) if len(sizes) else 0
    running = np.searchsorted(-sizes, -np.arange(steps), "left")  # texts with more than t words
    offset = np.cumsum(running) - running
    stay = np.ones((n, k), bool)
    source = np.zeros(n, np.uint16)
    best = scores[starts[: running[0]]] if steps else None
    last = np.zeros(len(sizes), np.int64)
    for t in range(1, steps):
        m = running[t]
        if m < running[t - 1]:
            last[m : running[t - 1]] = best[m:].argmax(axis=1)
            best = best[:m]
        top = best.argmax(axis=1)
        jump = best[np.arange(m), top] - switch
        kept = best >= jump[:, None]
        at = offset[t]
        stay[at : at + m] = kept
        source[at : at + m] = top
        best = np.where(kept, best, jump[:, None]) + scores[starts[:m] + t]
    if steps:
        last[: running[-1]] = best.argmax(axis=1)
    path = np.zeros(n, np.uint16)
    state = last
    for t in range(steps - 1, -1, -1):
        m = running[t]
        path[starts[:m] + t] = state[:m]
        at = offset[t]
        held = stay[np.arange(at, at + m), state[:m]]
        state[:m] = np.where(held, state[:m], source[at : at + m])
    return path


def label_texts(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    labels, certain = ["und"] * len(texts), np.zeros(len(texts))
    words = split_words(texts)
    if not model.languages or not len(words.doc):
        return labels, certain
    k = len(model.languages)
    scores = word_scores(words, model)
    counts = np.bincount(words.doc, minlength=len(texts))
    path = viterbi(scores, counts)
    letters = np.zeros((len(texts), k))
    np.add.at(letters, (words.doc, path), words.sizes)
    totals = np.zeros((len(texts), k))
    np.add.at(totals, words.doc, np.maximum(scores, -200.0))
    some = np.flatnonzero(counts)
    choice = letters[some].argmax(axis=1)
    share = letters[some, choice] / letters[some].sum(axis=1)
    rows = np.arange(len(some))
    own = totals[some, choice]
    others = totals[some].copy()
    others[rows, choice] = -np.inf
    odds = (own - others.max(axis=1)) / np.sqrt(counts[some]) if k > 1 else np.full(len(some), 30.0)
    certain[some] = share / (1 + np.exp(-np.clip(odds, -30, 30)))
    for i, c in zip(some.tolist(), choice.tolist(), strict=True):
        labels[i] = model.languages[c]
    return labels, certain


def span_labels(text: str | None, model: Model) -> list[tuple[int, int, str]]:
    """``(start, end, language)`` of the runs of words in one language, in code points."""
    words = split_words([text])
    if not model.languages or not len(words.doc):
        return []
    path = viterbi(word_scores(words, model), np.array([len(words.doc)]))
    cuts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
    ends = np.r_[cuts[1:], len(path)] - 1
    return [
        (int(words.starts[a]) - 1, int(words.starts[b] + words.sizes[b]) - 1, model.languages[path[a]])
        for a, b in zip(cuts, ends, strict=True)
    ]


def _label_batches(broadcast, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in batches:
            texts = batch.column(text_at)
            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(False)
            for a, b in grouped(sizes, LABEL_CHARS):
                labels, certain = label_texts(texts[a:b].to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, pa.array(labels, pa.string()), pa.array(certain)],
                    [*batch.schema.names, "_lang", "_lang_score"],
                )

    return run


def label(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``_lang`` (string) and ``_lang_score`` (double) after its own columns."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    schema = StructType(list(plain.schema.fields)).add("_lang", "string").add("_lang_score", "double")
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    out = plain.mapInArrow(trimmed(_label_batches(broadcast, docs.columns.index(text))), schema)
    return out.toDF(*docs.columns, "_lang", "_lang_score")
