"""Toxicity of whole texts: a bidirectional gated recurrent network over word windows.

A word enters as the sum of vectors of the whole word and of its first letters (hashed) and
the mean of its letter trigram vectors, so unseen words are read through their letters. The network runs over windows of
``WINDOW`` words that overlap; attention pools the states of a window to one logit. A
document's logit is that of its most toxic window, calibrated to a probability.

Learning, in numpy on the driver: a sample of at most ``sample_docs`` labelled documents of
each class (twice that of the clean class), the first by a digest of doc_id: one text of each id, of
texts of at most an eighth of ``sample_bytes`` the first of ``sample_bytes`` in all. Labels hold for
documents, so toxic documents teach by their most toxic windows and clean ones by theirs. A
quarter of the sample is kept for the calibration. Scoring takes place in Spark over all
windows of all texts.

Defined cases: a null text or one without letters has one window without words. Without
labels of both classes every score is 0. An id with both labels teaches nothing, and of several
texts of an id the one with the smallest digest does. Repeated rows score alike. Extra columns are not
read; labels, languages, sources and ids are no input of a score.
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
from pairwright.llm.words import Words, grouped, split_words, trigrams

WINDOW = 48
STRIDE = 32
HIDDEN = 8
WIDTH = 12  # of word and trigram vectors
BITS = 15  # buckets of words and of trigrams
PREFIXES = (4, 6)  # first letters that have a vector of their own
DROPPED = 0.3  # share of whole-word vectors left out in a training step
SAMPLE_DOCS = 700
SAMPLE_BYTES = 32 << 20
EPOCHS = 14
BATCH = 256
PRIOR = 0.1  # share of toxic texts that the calibration assumes
THRESHOLD = 0.7


@dataclass
class Text:
    """Distinct words of some texts, and the windows over them."""

    word: np.ndarray  # buckets of each distinct word and of its first letters
    gram: np.ndarray  # trigram buckets, word by word
    gram_first: np.ndarray
    gram_count: np.ndarray
    slots: np.ndarray  # (windows, WINDOW) distinct words; -1 behind the end
    doc: np.ndarray  # text of each window


def windows(texts: list[str | None]) -> Text:
    words = split_words(texts)
    n = len(words.doc)
    ends = np.cumsum(words.sizes)
    first = ends - words.sizes
    place = np.arange(ends[-1] if n else 0)
    inside = place - np.repeat(first, words.sizes)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(words.sizes.max(initial=0)) + 1, 0x100000001B3, np.uint64))
        code = words.codes[np.repeat(words.starts, words.sizes) + inside].astype(np.uint64)
        code *= power[inside]
        hashes = []
        for letters in (*PREFIXES, None):
            part = code if letters is None else code * (inside < letters)
            mixed = np.add.reduceat(part, first) if n else np.zeros(0, np.uint64)
            mixed += np.uint64(letters or 0)
            mixed ^= mixed >> np.uint64(29)
            hashes.append(mixed * np.uint64(0xBF58476D1CE4E5B9))
    mixed = hashes[-1]
    _, sample, number = np.unique(mixed, return_index=True, return_inverse=True)
    distinct = Words(words.codes, words.starts[sample], words.sizes[sample], words.doc[sample], words.scripts[sample])
    gram, gram_first = trigrams(distinct, BITS)
    counts = np.bincount(words.doc, minlength=len(texts))
    text_first = np.cumsum(counts) - counts
    shown = np.maximum(1, 1 + -(-np.maximum(counts - WINDOW, 0) // STRIDE))  # windows of each text
    doc = np.repeat(np.arange(len(texts)), shown)
    turn = np.arange(len(doc)) - np.repeat(np.cumsum(shown) - shown, shown)
    start = turn * STRIDE
    at = start[:, None] + np.arange(WINDOW)
    there = at < counts[doc][:, None]
    slots = np.full(at.shape, -1, np.int32)
    if n:
        slots[there] = number[(text_first[doc][:, None] + at)[there]]
    return Text(
        (np.stack(hashes, axis=1)[sample] >> np.uint64(64 - BITS)).astype(np.int64), gram, gram_first, distinct.sizes, slots, doc
    )


class Network:
    """Parameters and the two passes. Gates are in the order update, reset, candidate."""

    def __init__(self, seed: int = 3):
        self.draw = draw = np.random.default_rng(seed)
        h = HIDDEN

        def start(*shape, scale):
            return (draw.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "word": start(1 << BITS, WIDTH, scale=0.1),
            "gram": start(1 << BITS, WIDTH, scale=0.3),
            "in_f": start(WIDTH, 3 * h, scale=0.4),
            "in_b": start(WIDTH, 3 * h, scale=0.4),
            "bias_f": np.zeros(3 * h, np.float32),
            "bias_b": np.zeros(3 * h, np.float32),
            "rec_f": start(h, 3 * h, scale=0.3),
            "rec_b": start(h, 3 * h, scale=0.3),
            "attend": start(2 * h, scale=0.3),
            "out": start(2 * h, scale=0.3),
            "out_bias": np.zeros(1, np.float32),
        }

    def inputs(self, text: Text, which: np.ndarray | None = None, dropped: float = 0.0) -> np.ndarray:
        """Vectors of the distinct words (or of some); a last row of zeros for no word."""
        if which is None:
            gram, first, count, word = text.gram, text.gram_first, text.gram_count, text.word
        else:
            count, word = text.gram_count[which], text.word[which]
            first = np.cumsum(count) - count
            gram = text.gram[
                np.repeat(text.gram_first[which] - first, count) + np.arange(count.sum())
            ]
        out = np.zeros((len(word) + 1, WIDTH), np.float32)
        if len(word):
            out[:-1] = np.add.reduceat(self.p["gram"][gram], first, axis=0) / count[:, None]
            kept = np.ones(word.shape, np.float32)
            if dropped:
                kept[:, -1] = self.draw.random(len(word)) >= dropped
            for i in range(word.shape[1]):
                out[:-1] += self.p["word"][word[:, i]] * kept[:, i, None]
            self._used = (word, gram, first, count, kept)
        return out

    def _run(self, table: np.ndarray, slots: np.ndarray, there: np.ndarray, way: str, keep: list | None):
        """States ``(WINDOW, windows, HIDDEN)`` in one direction; ``table`` holds projections."""
        steps, n = slots.shape
        h = HIDDEN
        state = np.zeros((n, h), np.float32)
        states = np.empty((steps, n, h), np.float32)
        rec = self.p[f"rec_{way}"]
        for t in range(steps) if way == "f" else reversed(range(steps)):
            x = table[slots[t]]
            from_state = state @ rec
            gates = np.tanh((x[:, : 2 * h] + from_state[:, : 2 * h]) * 0.5)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * from_state[:, 2 * h :])
            before = state
            state = new + z * (state - new)
            state *= there[t][:, None]
            states[t] = state
            if keep is not None:
                keep.append((t, before, gates, new, from_state[:, 2 * h :]))
        return states

    def logits(self, table_f, table_b, slots: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """One logit for each window of ``slots`` (windows, WINDOW)."""
        turned = np.ascontiguousarray(slots.T)
        there = (turned >= 0).astype(np.float32)
        kept_f, kept_b = ([], []) if keep is not None else (None, None)
        h = HIDDEN
        forward = self._run(table_f, turned, there, "f", kept_f)
        backward = self._run(table_b, turned, there, "b", kept_b)
        attend, out = self.p["attend"], self.p["out"]
        weight = forward @ attend[:h] + backward @ attend[h:]
        value = forward @ out[:h] + backward @ out[h:]
        weight = np.exp(weight - weight.max(axis=0)) * there
        total = weight.sum(axis=0)
        weight /= np.maximum(total, 1e-20)
        if keep is not None:
            keep |= {"f": kept_f, "b": kept_b, "states": (forward, backward), "slots": turned,
                     "there": there, "weight": weight, "value": value}
        return (weight * value).sum(axis=0) + self.p["out_bias"][0]

    def tables(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.p
        return vectors @ p["in_f"] + p["bias_f"], vectors @ p["in_b"] + p["bias_b"]

    def gradients(
        self, text: Text, picked: np.ndarray, wanted: np.ndarray, dropped: float = 0.0
    ) -> tuple[float, dict]:
        """Loss and gradients over some windows with wanted values 0 or 1."""
        p, h = self.p, HIDDEN
        slots = text.slots[picked]
        some, number = np.unique(slots, return_inverse=True)
        some, number = (some[1:], number - 1) if len(some) and some[0] < 0 else (some, number)
        slots = number.reshape(slots.shape)
        vectors = self.inputs(text, some, dropped)
        keep: dict = {}
        logit = self.logits(*self.tables(vectors), slots, keep)
        chance = 1 / (1 + np.exp(-logit))
        loss = float(-np.mean(np.log(np.where(wanted > 0, chance, 1 - chance) + 1e-9)))
        grad = {name: np.zeros_like(value) for name, value in p.items()}
        d_logit = ((chance - wanted) / len(wanted)).astype(np.float32)
        weight, value = keep["weight"], keep["value"]
        grad["out_bias"][0] = d_logit.sum()
        d_value = weight * d_logit
        d_weight = value * d_logit
        d_weight = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_vectors = np.zeros_like(vectors)
        for i, way in enumerate("fb"):
            states = keep["states"][i]
            part = slice(i * h, (i + 1) * h)
            grad["attend"][part] = np.einsum("tn,tnh->h", d_weight, states)
            grad["out"][part] = np.einsum("tn,tnh->h", d_value, states)
            d_states = d_weight[:, :, None] * p["attend"][part] + d_value[:, :, None] * p["out"][part]
            d_table = np.zeros((len(vectors), 3 * h), np.float32)
            carried = np.zeros((slots.shape[0], h), np.float32)
            rec = p[f"rec_{way}"]
            for t, before, gates, new, candidate in reversed(keep[way]):
                z, r = gates[:, :h], gates[:, h:]
                d_state = (d_states[t] + carried) * keep["there"][t][:, None]
                d_new = d_state * (1 - z) * (1 - new * new)
                d_z = d_state * (before - new) * z * (1 - z)
                d_r = d_new * candidate * r * (1 - r)
                d_in = np.concatenate([d_z, d_r, d_new], axis=1)
                d_from = np.concatenate([d_z, d_r, d_new * r], axis=1)
                grad[f"rec_{way}"] += before.T @ d_from
                carried = d_state * z + d_from @ rec.T
                np.add.at(d_table, keep["slots"][t], d_in)
            grad[f"in_{way}"] = vectors.T @ d_table
            grad[f"bias_{way}"] = d_table.sum(axis=0)
            d_vectors += d_table @ p[f"in_{way}"].T
        if len(some):
            word, gram, _, count, kept = self._used
            for i in range(word.shape[1]):
                np.add.at(grad["word"], word[:, i], d_vectors[:-1] * kept[:, i, None])
            np.add.at(grad["gram"], gram, np.repeat(d_vectors[:-1] / count[:, None], count, axis=0))
        return loss, grad


@dataclass
class Model:
    network: Network | None = None
    slope: float = 1.0
    shift: float = 0.0


def window_logits(network: Network, text: Text) -> np.ndarray:
    return network.logits(*network.tables(network.inputs(text)), text.slots)


def text_logits(network: Network, text: Text, n_texts: int) -> np.ndarray:
    most = np.full(n_texts, -np.inf, np.float32)
    np.maximum.at(most, text.doc, window_logits(network, text))
    return most


def _fit_line(logit: np.ndarray, wanted: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, toxic texts weighing ``PRIOR`` of all.

    Newton steps, halved until the loss falls; a prior keeps the slope near one where the
    classes lie apart.
    """
    logit = np.clip(logit.astype(np.float64), -30, 30)
    share = wanted.mean()
    weight = np.where(wanted > 0, PRIOR / share, (1 - PRIOR) / (1 - share)) / 20
    x = np.stack([logit, np.ones_like(logit)], axis=1)
    sign = np.where(wanted > 0, 1.0, -1.0)
    start, pull = np.array([1.0, 0.0]), np.array([1.0, 0.01])
    line = start.copy()

    def loss(line: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, -sign * (x @ line))).sum() + (pull * (line - start) ** 2).sum() / 2)

    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        slope = x.T @ (weight * (chance - wanted)) + pull * (line - start)
        bend = (x * (weight * chance * (1 - chance))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(bend, slope)
        size = 1.0
        while size > 1e-6 and loss(line - size * step) > loss(line):
            size /= 2
        line = line - size * step
        if np.abs(step).max() * size < 1e-9:
            break
    return float(max(line[0], 0.1)), float(line[1])


def train(texts: list[str], toxic: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """Fit the network and its calibration; a trivial model unless both classes are there."""
    toxic = np.asarray(toxic, np.float32)
    if len(set(toxic.tolist())) < 2:
        return Model()
    draw = np.random.default_rng(seed)
    text = windows(texts)
    network = Network()
    aside = draw.random(len(texts)) < 0.25
    if len(set(toxic[aside].tolist())) < 2 or len(set(toxic[~aside].tolist())) < 2:
        aside = np.zeros(len(texts), bool)
    mine = np.flatnonzero(~aside[text.doc])
    doc = text.doc[mine]
    first = {name: np.zeros_like(v) for name, v in network.p.items()}
    second = {name: np.zeros_like(v) for name, v in network.p.items()}
    step = 0
    for epoch in range(epochs):
        # the windows a document teaches by: at first any, then its most toxic ones
        worth = draw.random(len(mine)).astype(np.float32)
        if epoch > 1:
            logit = window_logits(network, text)[mine]
            worth = np.where((toxic[doc] == 0) & (draw.random(len(mine)) < 0.1), 1e3 + worth, logit)
        order = np.lexsort((-worth, doc))
        begin = np.flatnonzero(np.r_[True, np.diff(doc[order]) > 0])
        rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.r_[begin, len(order)]))
        most = np.where(toxic[doc[order]] > 0, 2 if epoch > 1 else 4, 4)
        chosen = draw.permutation(mine[order[rank < most]])
        for start in range(0, len(chosen), BATCH):
            picked = chosen[start : start + BATCH]
            _, grad = network.gradients(text, picked, toxic[text.doc[picked]], DROPPED)
            step += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            for name, g in grad.items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                ahead = first[name] / (1 - 0.9**step)
                network.p[name] -= rate * ahead / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)
    judged = np.flatnonzero(aside) if aside.any() else np.arange(len(texts))
    logit = text_logits(network, text, len(texts))[judged]
    return Model(network, *_fit_line(logit, toxic[judged]))


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    if model.network is None:
        return np.zeros(len(texts))
    logit = text_logits(model.network, windows(texts), len(texts)).astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(model.slope * logit + model.shift, -30, 30)))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    sample_docs: int = SAMPLE_DOCS,
    doc_id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    sample_bytes: int = SAMPLE_BYTES,
) -> Model:
    """Train on a bounded sample of the labelled documents that are not held out."""
    digest = F.xxhash64("doc_id", F.lit("toxicity"))
    labelled = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
        .filter("toxic = _most")
        .drop("_most")
    )

    def some(value: int, most: int) -> DataFrame:
        return labelled.filter(F.col("toxic") == value).orderBy(digest, "doc_id").limit(most)

    sample = some(1, sample_docs).unionByName(some(0, 2 * sample_docs))
    # at most 3 * sample_docs rows, one of each id
    texts = (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        .filter(F.octet_length("text") <= sample_bytes // 8)
        .join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    )
    sofar = F.sum(F.octet_length("text")).over(Window.orderBy(digest, "doc_id"))
    rows = texts.withColumn("upto", sofar).filter(F.col("upto") <= sample_bytes).drop("upto").toArrow().sort_by("doc_id")
    return train(rows["text"].to_pylist(), rows["toxic"].to_numpy())


def _score_batches(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(False)
            for a, b in grouped(sizes):
                scores = score_texts(model, batch.column(1)[a:b].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(scores)], ["doc_id", "score"]
                )

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every document."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _score_batches(broadcast), "doc_id long, score double"
    )
