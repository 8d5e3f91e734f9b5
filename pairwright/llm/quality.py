"""Quality of whole texts: a factorisation machine over words, structure and metadata.

Features of a text: its words, hashed, with the square root of their share as weight;
structure, each statistic cut into bins and one feature a bin; and metadata, the recorded
number of characters in bins. Statistics are taken over the whole text and over its worst
stretch of ``STRETCH`` words, so that junk inside a long text shows. The score is

    bias + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

so all pairwise interactions of low rank cost one pass over the features.

Learning, in numpy on the driver: of the labelled documents that are not held out at most
``sample_docs`` of each class, the first by a digest of doc_id, one row an id, and of those texts
up to ``sample_chars`` characters in all. A quarter is kept to choose the best epoch and to
calibrate. Scoring runs in Spark over every whole text.

Defined cases: a null text or one without words has structure features only. Without labels
of both classes every score is 0.5, the score of no knowledge. Null, missing or negative
metadata have a bin of their own. Repeated rows score alike. Extra columns are not read; labels,
languages, sources and ids are no input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.language import held_out
from pairwright.llm.words import grouped

WORD_BITS = 15
RANK = 6
BINS = 16
STRETCH = 32
SAMPLE_DOCS = 3000
SAMPLE_CHARS = 24 << 20
EPOCHS = 12
BATCH = 128
THRESHOLD = 0.5
PRIOR = 0.5  # of class 1, that the calibration assumes
SHARES = ("upper", "digit", "symbol", "space", "repeat", "known", "short", "long")
#: Structure statistics: shares over the whole text, the same over its worst stretch, sizes.
STATISTICS = (*SHARES, *(f"worst {s}" for s in SHARES), "words", "line words", "worst line", "recorded")
WIDTH = (1 << WORD_BITS) + len(STATISTICS) * BINS


def _byte_kinds() -> np.ndarray:
    """For each byte: 1 upper case, 2 digit, 4 symbol, 8 gap; letters and UTF-8 tails 0."""
    kinds = np.zeros(256, np.uint8)
    for c in range(128):
        char = chr(c)
        if char.isupper():
            kinds[c] = 1
        elif char.isdigit():
            kinds[c] = 2
        elif char.isspace():
            kinds[c] = 8
        elif not char.isalpha():
            kinds[c] = 4
    return kinds


KINDS = _byte_kinds()


@dataclass
class Features:
    """Sparse rows: features ``start[i] : start[i + 1]`` belong to text i."""

    start: np.ndarray
    index: np.ndarray
    value: np.ndarray


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _binned(share: np.ndarray) -> np.ndarray:
    """Bins of a share, finer near zero."""
    return np.minimum((np.sqrt(np.clip(share, 0, 1)) * BINS).astype(np.int64), BINS - 1)


def _octaves(size: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(1 + np.maximum(size, 0)).astype(np.int64), BINS - 1)


def features(texts: list[bytes | None], recorded: np.ndarray) -> Features:
    """Features of some texts; ``recorded`` is the recorded size, negative where there is none."""
    n = len(texts)
    joined = np.frombuffer(b" " + b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    sizes = np.fromiter((len(t or b"") for t in texts), np.int64, n)
    text_start = 1 + np.cumsum(sizes + 1) - sizes - 1
    kind = KINDS[joined]
    gap = kind == 8
    edges = np.diff(gap.view(np.int8))
    starts = np.flatnonzero(edges == -1) + 1
    ends = np.flatnonzero(edges == 1) + 1
    lengths = ends - starts
    doc = np.searchsorted(text_start, starts, "right") - 1
    words = np.bincount(doc, minlength=n)
    # a word's hash is over its letters in lower case
    lower = joined + np.where(kind == 1, 32, 0).astype(np.uint8)
    m = len(starts)
    if m:
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = np.repeat(starts, lengths) + inside
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(lengths.max()) + 1, 0x100000001B3, np.uint64))
            first = np.cumsum(lengths) - lengths
            hashed = _mixed(np.add.reduceat(lower[at].astype(np.uint64) * power[inside], first))
    else:
        hashed = np.zeros(0, np.uint64)
    bucket = (hashed >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    cell, times = np.unique((doc << WORD_BITS) + bucket, return_counts=True)
    cell_doc = cell >> WORD_BITS
    weight = np.sqrt(times / np.maximum(words, 1)[cell_doc])

    # what each word adds to the shares
    def counted(which: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(which)])
        return (total[ends] - total[starts]).astype(np.float64)

    order = np.lexsort((np.arange(m), hashed, doc))
    again = np.zeros(m, bool)
    again[order[1:]] = (hashed[order[1:]] == hashed[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    back = np.zeros(m, bool)
    back[1:] = (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])
    per_word = np.stack(
        [
            counted(kind == 1),
            counted(kind == 2),
            counted(kind == 4),
            np.concatenate([starts[1:] - ends[:-1] - 1, [0]])[:m] * 1.0,
            back * 1.0,
            again * 1.0,
            (lengths <= 2) * 1.0,
            (lengths >= 14) * 1.0,
        ],
        axis=1,
    )
    over = np.stack([lengths] * 4 + [np.ones(m)] * 4, axis=1)

    def shares(key: np.ndarray, size: int) -> np.ndarray:
        top = np.stack([np.bincount(key, per_word[:, i], size) for i in range(len(SHARES))], axis=1)
        under = np.stack([np.bincount(key, over[:, i], size) for i in range(len(SHARES))], axis=1)
        return top / np.maximum(under, 1)

    whole = shares(doc, n)
    word_start = np.cumsum(words) - words
    stretches = np.maximum(1, -(-words // STRETCH))
    stretch_start = np.cumsum(stretches) - stretches
    stretch = stretch_start[doc] + (np.arange(m) - word_start[doc]) // STRETCH
    worst = np.maximum.reduceat(shares(stretch, int(stretches.sum())), stretch_start, axis=0) if n else whole
    breaks = np.concatenate([[0], np.cumsum(joined == 10)])
    text_end = text_start + sizes
    lines = breaks[text_end] - breaks[text_start] + 1
    line = breaks[starts] if m else np.zeros(0, np.int64)
    line_words = np.bincount(line + doc, minlength=1)  # a text ends a line
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc, line_words[line + doc])
    bins = np.concatenate(
        [
            _binned(whole),
            _binned(worst),
            np.stack(
                [
                    _octaves(words),
                    _octaves(words / lines),
                    _octaves(most),
                    np.where(recorded < 0, BINS - 1, np.minimum(_octaves(recorded), BINS - 2)),
                ],
                axis=1,
            ),
        ],
        axis=1,
    )
    base = (1 << WORD_BITS) + np.arange(len(STATISTICS)) * BINS
    index = np.concatenate([cell & ((1 << WORD_BITS) - 1), (base + bins).ravel()])
    value = np.concatenate([weight, np.full(bins.size, 1 / np.sqrt(len(STATISTICS)))])
    row = np.concatenate([cell_doc, np.repeat(np.arange(n), len(STATISTICS))])
    order = np.argsort(row, kind="stable")
    start = np.searchsorted(row[order], np.arange(n + 1))
    return Features(start, index[order], value[order].astype(np.float32))


def features_in_groups(texts: list[bytes], recorded: np.ndarray) -> Features:
    """The same, with working memory for a group of texts at a time."""
    parts = [features(texts[a:b], recorded[a:b]) for a, b in grouped(np.array([len(t) for t in texts]))]
    counts = np.concatenate([np.diff(x.start) for x in parts])
    return Features(
        np.concatenate([[0], np.cumsum(counts)]),
        np.concatenate([x.index.astype(np.int32) for x in parts]),
        np.concatenate([x.value for x in parts]),
    )


@dataclass
class Model:
    """``bias``, linear weights, vectors of rank ``RANK``; slope and shift of the calibration."""

    bias: float = 0.0
    linear: np.ndarray | None = None
    vectors: np.ndarray | None = None
    slope: float = 1.0
    shift: float = 0.0


def logits(model: Model, x: Features) -> np.ndarray:
    """The sum-of-squares identity, in time linear in the features. No text is without any."""
    first = x.start[:-1]
    if not len(first):
        return np.zeros(0)
    at = x.value[:, None] * model.vectors[x.index]
    total = np.add.reduceat(at, first, axis=0)
    squares = np.add.reduceat(at * at, first, axis=0)
    line = np.add.reduceat(x.value * model.linear[x.index], first)
    return model.bias + line + 0.5 * (total * total - squares).sum(axis=1)


def gradients(model: Model, x: Features, y: np.ndarray, weight: np.ndarray):
    """Loss and its gradients: bias, and for each feature of ``x`` the linear weight and vector."""
    counts = np.diff(x.start)
    row = np.repeat(np.arange(len(counts)), counts)
    at = x.value[:, None] * model.vectors[x.index]
    total = np.add.reduceat(at, x.start[:-1], axis=0)
    line = np.add.reduceat(x.value * model.linear[x.index], x.start[:-1])
    z = model.bias + line + 0.5 * (total * total - np.add.reduceat(at * at, x.start[:-1], axis=0)).sum(axis=1)
    loss = float((weight * (np.logaddexp(0, z) - y * z)).sum())
    pull = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
    own = (pull[row] * x.value)[:, None]
    return loss, pull.sum(), own[:, 0], own * (total[row] - at)


def _taken(x: Features, rows: np.ndarray) -> Features:
    counts = np.diff(x.start)[rows]
    ends = np.cumsum(counts)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(x.start[rows] - ends + counts, counts)
    return Features(np.concatenate([[0], ends]), x.index[at], x.value[at])


def _calibrated(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0.1) and shift of a logistic line through the scores kept aside."""
    line = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(line[0] * z + line[1], -30, 30)))
        pull, bend = weight * (p - y), weight * p * (1 - p)
        gradient = np.array([(pull * z).sum(), pull.sum()]) + 0.05 * (line - [1, 0])
        curve = np.array([[(bend * z * z).sum(), (bend * z).sum()], [(bend * z).sum(), bend.sum()]]) + 0.05 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        line = line - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(max(line[0], 0.1)), float(line[1])


def train(
    texts: list[bytes], recorded: np.ndarray, good: np.ndarray, epochs: int = EPOCHS, seed: int = 7, rank: int = RANK
) -> Model:
    """Fit by adaptive gradient steps on the features of each batch; classes weigh alike."""
    good = np.asarray(good, np.float64)
    if len(set(good.tolist())) < 2:
        return Model()
    draw = np.random.default_rng(seed)
    x = features_in_groups(texts, recorded)
    share = good.mean()
    weight = np.where(good > 0, PRIOR / share, (1 - PRIOR) / (1 - share))
    aside = draw.random(len(texts)) < 0.25
    if len(set(good[aside].tolist())) < 2 or len(set(good[~aside].tolist())) < 2:
        aside[:] = False
    model = Model(
        0.0, np.zeros(WIDTH, np.float32), (draw.standard_normal((WIDTH, rank)) * 0.05).astype(np.float32)
    )
    seen_linear, seen_vectors, seen_bias = np.full(WIDTH, 1e-3, np.float32), np.full((WIDTH, rank), 1e-3, np.float32), 1e-3
    learnt = np.flatnonzero(~aside)
    judged = np.flatnonzero(aside) if aside.any() else learnt
    held = _taken(x, judged)
    best, kept = np.inf, model
    for epoch in range(epochs):
        order = draw.permutation(learnt)
        rate = 0.15 * (1 - epoch / epochs) + 0.02
        for begin in range(0, len(order), BATCH):
            rows = order[begin : begin + BATCH]
            part = _taken(x, rows)
            _, of_bias, of_linear, of_vectors = gradients(model, part, good[rows], weight[rows] / len(rows))
            index, where = np.unique(part.index, return_inverse=True)
            linear = np.bincount(where, of_linear, len(index)) + 1e-5 * model.linear[index]
            vectors = np.stack([np.bincount(where, of_vectors[:, f], len(index)) for f in range(rank)], axis=1)
            vectors += 1e-4 * model.vectors[index]
            seen_linear[index] += linear**2
            seen_vectors[index] += vectors**2
            seen_bias += of_bias**2
            model.linear[index] -= rate * linear / np.sqrt(seen_linear[index])
            model.vectors[index] -= rate * 0.5 * vectors / np.sqrt(seen_vectors[index])
            model.bias -= rate * of_bias / np.sqrt(seen_bias)
        z = logits(model, held)
        loss = (weight[judged] * (np.logaddexp(0, z) - good[judged] * z)).sum()
        if loss < best:
            best, kept = loss, Model(model.bias, model.linear.copy(), model.vectors.copy())
    z = logits(kept, held).astype(np.float64)
    kept.slope, kept.shift = _calibrated(z, good[judged], weight[judged])
    return kept


def score_texts(model: Model, texts: list[bytes | None], recorded: np.ndarray) -> np.ndarray:
    if model.linear is None:
        return np.full(len(texts), 0.5)
    z = logits(model, features(texts, recorded)).astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -30, 30)))


def _recorded(n_chars: str | None) -> F.Column:
    if n_chars is None:
        return F.lit(-1).cast("long")
    size = F.col(n_chars).cast("long")
    return F.when(size >= 0, size).otherwise(-1)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    sample_docs: int = SAMPLE_DOCS,
    sample_chars: int = SAMPLE_CHARS,
    doc_id: str = "doc_id",
    text: str = "text",
    n_chars: str | None = "n_chars",
    quality: str = "quality",
) -> Model:
    """Train on a bounded sample of the labelled documents that are not held out."""
    digest = F.xxhash64("doc_id", F.lit("quality"))
    labelled = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(quality).cast("int").alias("quality"))
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
        .filter("quality = _most")
        .drop("_most")
    )

    def some(value: int) -> DataFrame:
        return labelled.filter(F.col("quality") == value).orderBy(digest, "doc_id").limit(sample_docs)

    sample = some(0).unionByName(some(1))
    # at most 2 * sample_docs rows, one of each id: the text with the smallest digest
    rows = (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _recorded(n_chars).alias("recorded"))
        .filter(F.col("text").isNotNull())
        .join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "quality")
        .agg(F.min_by(F.struct("text", "recorded"), F.xxhash64("text", "recorded")).alias("row"))
        .select("doc_id", "quality", "row.text", "row.recorded", F.octet_length("row.text").alias("size"))
    )
    sofar = Window.orderBy(digest, "doc_id")
    taken = rows.withColumn("upto", F.sum("size").over(sofar)).filter(F.col("upto") <= sample_chars)
    found = taken.drop("upto", "size").toArrow().sort_by("doc_id")
    return train(found["text"].cast(pa.binary()).to_pylist(), found["recorded"].to_numpy(), found["quality"].to_numpy())


def _score_batches(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(False)
            for a, b in grouped(sizes):
                texts = batch.column(1)[a:b].cast(pa.binary()).to_pylist()
                scores = score_texts(model, texts, batch.column(2)[a:b].to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(scores)], ["doc_id", "score"])

    return run


def score(
    docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars"
) -> DataFrame:
    """``(doc_id, score)`` of every document."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), _recorded(n_chars).alias("recorded")
    ).mapInArrow(_score_batches(broadcast), "doc_id long, score double")
