"""Phrase collocations from FM-indexes over word ids, one a shard, counts summed over shards.

Text: A-Z lower-cased, cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
``[^\\x20\\x09]+``. A shard holds the word ids of at most about ``SHARD_WORDS`` words of one
language, pieces parted by id 0. Its index is the Burrows-Wheeler transform of the id sequence
and that of the reversed sequence. A phrase is an interval in both; the symbols in front of
its rows are its left extensions, those of the other transform its right ones, and the
interval in the other index moves by the number of smaller symbols. Rows are sorted by
``DEPTH`` symbols only, which is exact for phrases up to that length.

Passes, each over stored shards, taken in batches of about ``SHARD_WORDS`` words: words are
counted; batches count pairs of frequent words; batches keep the words that stand in a frequent
pair (others part pieces too) and enumerate all phrases up to ``DEPTH`` words by extending to
the right, to the left and to the right. After the first two passes, the counts of all batches
meet by buckets of keys, and each bucket tells every batch which of its own keys are frequent.
A phrase is frequent only if its words and pairs are, so nothing is lost: keys are digests whose
collisions can only keep more, and the last counts are by text.

How it stays bounded: shards are cut where the texts lie, so a hot language has many; a task
holds one batch's ids, and a single text longer than that makes a longer shard. The number of
batches and buckets follows the number of words. Nothing comes to the driver.

Defined cases: a null text has no words, a null language is ``und``. Repeated rows count
each. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.durable import reread

DEPTH = 4
LEAST = 30  # occurrences of a candidate
SHARD_WORDS = 1_200_000
BUCKET_WORDS = 1_000_000  # a bucket of keys is for so many words of the corpus
TOP = 2000
SCALE = 2_000_000
COVERED = (80, 100)  # a phrase goes if 100 * f(longer) >= 80 * f

#: Cuts between pieces to line feeds, tabs to blanks; A-Z to a-z.
_FOLD = bytes(
    10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)


def pieces(text: bytes) -> list[bytes]:
    """Words of a text; ``b"\\n"`` parts pieces, and empty ones are to be left out."""
    return text.translate(_FOLD).replace(b"\n", b" \n ").split(b" ")


# --- id sequences as bytes: seven bits each, low ones first


def packed(ids: np.ndarray) -> bytes:
    ids = ids.astype(np.int64)
    widths = 1 + sum((ids >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    first = np.cumsum(widths) - widths
    out = np.zeros(int(widths.sum()), np.uint8)
    for k in range(5):
        some = np.flatnonzero(widths > k)
        if not len(some):
            break
        more = (widths[some] > k + 1).astype(np.int64) << 7
        out[first[some] + k] = (ids[some] >> 7 * k & 127) | more
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    cells = np.frombuffer(data, np.uint8)
    if not len(cells):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(cells < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    ids = np.zeros(len(first), np.int64)
    widths = last - first + 1
    for k in range(int(widths.max())):
        some = np.flatnonzero(widths > k)
        ids[some] |= (cells[first[some] + k].astype(np.int64) & 127) << 7 * k
    return ids


# --- the index


@dataclass
class Half:
    """One transform: the symbol before each row, and the rows of each symbol in order."""

    before: np.ndarray
    rows: np.ndarray  # symbol * size + row, sorted
    solid: np.ndarray  # rows before each row whose symbol is a word

    def first_row(self, symbols: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The first row of each symbol put before the phrase whose rows start at ``low``."""
        return np.searchsorted(self.rows, symbols * len(self.before) + low)


def _ranked(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones."""
    order = np.argsort(keys)
    keys = keys[order]
    ranks = np.empty(len(keys), np.int32)
    ranks[order] = np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]]), dtype=np.int32)
    return ranks


def transform(ids: np.ndarray) -> Half:
    """Sorts the rotations by their first ``DEPTH`` symbols; ``DEPTH`` is a power of two."""
    ranks, width = ids.astype(np.int32), 1
    while width < DEPTH:
        wide = int(ranks.max(initial=0)) + 1
        pairs = ranks.astype(np.int64) * wide
        pairs += np.roll(ranks, -width)
        ranks = _ranked(pairs)
        width *= 2
    before = np.roll(ids, 1).astype(np.int32)[np.argsort(ranks, kind="stable")]
    size = len(ids)
    rows = before.astype(np.int64) * size
    rows += np.arange(size)
    rows.sort()
    return Half(before, rows, np.concatenate([[0], np.cumsum(before > 0, dtype=np.int32)]))


@dataclass
class Intervals:
    """Phrases of one length: rows in both halves, and their words in order."""

    low: np.ndarray  # in the transform of the sequence
    back: np.ndarray  # in that of the reversed one
    size: np.ndarray
    words: np.ndarray  # (phrases, length)


class Index:
    """A bidirectional index of one id sequence; id 0 parts pieces."""

    def __init__(self, ids: np.ndarray):
        self.ahead = transform(ids)
        self.behind = transform(ids[::-1])

    def single(self) -> Intervals:
        symbols, counts = np.unique(self.ahead.before, return_counts=True)
        low = np.cumsum(counts) - counts
        some = symbols > 0
        return Intervals(low[some], low[some], counts[some], symbols[some][:, None])

    def extended(self, found: Intervals, left: bool) -> Intervals:
        """All phrases that a word more makes, to the left or to the right."""
        half, low, other = (
            (self.ahead, found.low, found.back) if left else (self.behind, found.back, found.low)
        )
        ends = np.cumsum(found.size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - ends + found.size, found.size)
        wide = int(half.before.max(initial=0)) + 1
        cells = np.repeat(np.arange(len(low)) * wide, found.size)
        cells += half.before[at]
        del at
        cells.sort()
        edges = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else cells
        cell, counts = cells[edges], np.diff(np.concatenate([edges, [len(cells)]]))
        del cells
        parent, symbol = cell // wide, cell % wide
        smaller = np.cumsum(counts) - counts - (ends - found.size)[parent]
        some = symbol > 0
        parent, symbol, counts, smaller = parent[some], symbol[some], counts[some], smaller[some]
        own, moved = half.first_row(symbol, low[parent]), other[parent] + smaller
        words = found.words[parent]
        if left:
            return Intervals(own, moved, counts, np.column_stack([symbol, words]))
        return Intervals(moved, own, counts, np.column_stack([words, symbol]))

    def extensions(self, found: Intervals) -> tuple[np.ndarray, np.ndarray]:
        """How many occurrences have a word on the left, and on the right."""
        left, right = self.ahead.solid, self.behind.solid
        return (
            left[found.low + found.size] - left[found.low],
            right[found.back + found.size] - right[found.back],
        )


def parted(ids: np.ndarray, keep: np.ndarray, cut: np.ndarray | None = None) -> np.ndarray:
    """``ids`` where ``keep``, else 0, without runs of 0; 0 also before positions ``cut``.

    The result starts with a 0, so the rotation behind the end starts a piece of its own.
    """
    kept = np.where(keep, ids, 0)
    if cut is not None:
        kept = np.insert(kept, cut, 0)
    kept = np.concatenate([[0], kept])
    return kept[(kept > 0) | np.concatenate([[True], kept[:-1] > 0])]


# --- shards


def _shard_batches(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        open_shards: dict[str, tuple[dict, list]] = {}
        held = 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            for lang, (numbers, parts) in open_shards.items():
                ids = np.concatenate(parts)
                ids = ids[ids != 1]
                counts = np.bincount(ids, minlength=len(numbers))
                counts[:2] = 0
                order = np.argsort(-counts, kind="stable")
                order = order[: np.count_nonzero(counts)]
                number = np.zeros(len(numbers), np.int64)
                number[order] = np.arange(1, len(order) + 1)  # the parting id becomes 0
                known = list(numbers)
                words = pa.array([known[i] for i in order.tolist()], pa.binary()).cast(pa.string())
                ends = pa.array([0, len(words)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang], pa.string()),
                        pa.array([task << 24 | made], pa.int64()),
                        pa.ListArray.from_arrays(ends, words),
                        pa.ListArray.from_arrays(ends, pa.array(counts[order])),
                        pa.array([packed(number[ids])], pa.binary()),
                    ],
                    ["lang", "shard", "words", "counts", "ids"],
                )
                made += 1
            open_shards.clear()
            held = 0

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if not text.is_valid:
                    continue
                if lang not in open_shards:
                    open_shards[lang] = _Numbers({b"\n": 0, b"": 1}), []
                numbers, parts = open_shards[lang]
                found = pieces(text.as_py())
                found.append(b"\n")
                parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                held += len(found)
                if held >= most:
                    yield from done()
        yield from done()

    return run


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def shards(docs: DataFrame, text: str, lang: str, most: int = SHARD_WORDS) -> DataFrame:
    """``(lang, shard, words, counts, ids)``: word i of a shard is ``words[i - 1]``."""
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(
        _shard_batches(most), "lang string, shard long, words array<string>, counts array<long>, ids binary"
    )


# --- keys: 48 bits of a digest. Equal keys of different texts can only keep more.

KEY_BYTES = 6


def _word_keys(words: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Keys of the words from number 1 on; the parting id 0 has key 0."""
    digest = xxhash.xxh3_64_intdigest
    values = words.cast(pa.binary()).to_pylist()
    keys = np.fromiter(map(digest, values), np.uint64, len(values)) >> np.uint64(64 - 8 * KEY_BYTES)
    return np.concatenate([np.zeros(1, np.uint64), keys])


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The key of each pair of words, from those of the words."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + right
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(64 - 8 * KEY_BYTES)


def keys_to_bytes(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys, "<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def keys_from_bytes(data: bytes) -> np.ndarray:
    cells = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    keys = np.zeros((len(cells), 8), np.uint8)
    keys[:, :KEY_BYTES] = cells
    return keys.view("<u8").ravel().astype(np.uint64)


def among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each key is one of the sorted ``wanted``."""
    if not len(wanted):
        return np.zeros(len(keys), bool)
    return wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys


COUNTS = "lang string, bucket int, batch int, keys binary, counts binary"
KEPT = "lang string, batch int, kind int, keys binary"
PHRASES = "lang string, phrase string, n long, left long, right long"
CELLS = "lang string, bucket int, phrases array<string>, n binary, left binary, right binary"


def _empty(schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    kinds["array<string>"] = pa.list_(pa.string())
    fields = [part.split() for part in schema.split(", ")]
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in fields})


def _bucketed(lang: str, batch: int, buckets: int, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
    """Counts of one batch as a row for each bucket of keys."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, start = np.unique(bucket[order], return_index=True)
    parts = np.split(order, start[1:]) if len(found) else []
    return pa.table(
        {
            "lang": pa.array([lang] * len(found), pa.string()),
            "bucket": pa.array(found, pa.int32()),
            "batch": pa.array([batch] * len(found), pa.int32()),
            "keys": pa.array([keys_to_bytes(keys[p]) for p in parts], pa.binary()),
            "counts": pa.array([packed(counts[p]) for p in parts], pa.binary()),
        }
    )


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards to the counts of their words, by bucket."""
    for shard in batches:
        for i in range(shard.num_rows):
            lang, batch, buckets = (shard.column(c)[i].as_py() for c in ("lang", "batch", "buckets"))
            words, counts = shard.column("words")[i].values, shard.column("counts")[i].values
            table = _bucketed(lang, batch, buckets, _word_keys(words)[1:], counts.to_numpy())
            yield from table.to_batches()


def _frequent(least: int, kind: int):
    """The counts of all batches for one bucket to the frequent keys that each batch has."""

    def run(table: pa.Table) -> pa.Table:
        keys = [keys_from_bytes(k) for k in table["keys"].to_pylist()]
        counts = np.concatenate([unpacked(c) for c in table["counts"].to_pylist()])
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        enough = np.bincount(where, counts, len(distinct)) >= least
        wanted = distinct[enough]
        return pa.table(
            {
                "lang": table["lang"],
                "batch": table["batch"],
                "kind": pa.array([kind] * len(keys), pa.int32()),
                "keys": pa.array([keys_to_bytes(k[among(k, wanted)]) for k in keys], pa.binary()),
            }
        )

    return run


class _Batch:
    """Several shards of a language as one: common word numbers, one id sequence."""

    def __init__(self, shards: pa.Table, kept: pa.Table):
        shards = shards.sort_by("shard")
        self.lang, self.number, self.buckets = (shards[c][0].as_py() for c in ("lang", "batch", "buckets"))
        lists = shards["words"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        coded = pc.dictionary_encode(lists.flatten())
        number = coded.indices.to_numpy().astype(np.int64) + 1
        self.words = coded.dictionary
        counts = shards["counts"].combine_chunks().flatten().to_numpy()
        self.counts = np.bincount(number, counts, len(self.words) + 1).astype(np.int64)
        parts, start = [], 0
        for data, size in zip(shards["ids"].to_pylist(), sizes.tolist(), strict=True):
            own = np.concatenate([[0], number[start : start + size]]).astype(np.int32)
            parts += [own[unpacked(data)], np.zeros(1, np.int32)]
            start += size
        self.ids = np.concatenate(parts)
        self.keys = _word_keys(self.words)
        kinds = kept["kind"].to_numpy()
        lists = kept["keys"].to_pylist()
        self.kept = [
            np.unique(np.concatenate([np.zeros(0, np.uint64), *(keys_from_bytes(lists[i]) for i in np.flatnonzero(kinds == k))]))
            for k in (0, 1)
        ]


def _pairs(shards: pa.Table, kept: pa.Table) -> pa.Table:
    """Counts of the pairs of frequent words in one batch."""
    if not shards.num_rows or not kept.num_rows:
        return _empty(COUNTS)
    batch = _Batch(shards, kept)
    keep = among(batch.keys, batch.kept[0])
    keep[0] = False
    index = Index(parted(batch.ids, keep[batch.ids]))
    found = index.extended(index.single(), left=False)
    pair = pair_keys(batch.keys[found.words[:, 0]], batch.keys[found.words[:, 1]])
    return _bucketed(batch.lang, batch.number, batch.buckets, pair, found.size)


def _phrases(shards: pa.Table, kept: pa.Table) -> pa.Table:
    """Frequent words of one batch, and all phrases whose pairs are frequent, by bucket."""
    if not shards.num_rows or not kept.num_rows:
        return _empty(CELLS)
    batch = _Batch(shards, kept)
    ids, words = batch.ids, batch.words
    known = np.flatnonzero(among(batch.keys, batch.kept[0]))
    known = known[known > 0]
    texts = [words.take(pa.array(known - 1))]
    columns = [np.stack([batch.counts[known], np.zeros_like(known), np.zeros_like(known)])]
    marks = [batch.keys[known]]
    keys = batch.keys[ids]
    tied = among(pair_keys(keys[:-1], keys[1:]), batch.kept[1]) & (ids[:-1] > 0) & (ids[1:] > 0)
    keep = np.concatenate([[False], tied]) | np.concatenate([tied, [False]])
    index = Index(parted(ids, keep, np.flatnonzero(~tied) + 1))
    found = index.single()
    for left in (False, True, False):
        found = index.extended(found, left)
        before, after = index.extensions(found)
        columns.append(np.stack([found.size, before, after]))
        spelled = [words.take(pa.array(found.words[:, i] - 1)) for i in range(found.words.shape[1])]
        texts.append(pc.binary_join_element_wise(*spelled, " "))
        mark = batch.keys[found.words[:, 0]]
        for i in range(1, found.words.shape[1]):
            mark = pair_keys(mark, batch.keys[found.words[:, i]])
        marks.append(mark)
    bucket = (np.concatenate(marks) % np.uint64(batch.buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    counts = np.concatenate(columns, axis=1)[:, order]
    phrases = pa.concat_arrays(texts).take(pa.array(order))
    buckets, start = np.unique(bucket[order], return_index=True)
    ends = [*start.tolist()[1:], len(order)]
    spans = list(zip(start.tolist(), ends, strict=True)) if len(order) else []
    return pa.table(
        {
            "lang": pa.array([batch.lang] * len(spans), pa.string()),
            "bucket": pa.array(buckets, pa.int32()),
            "phrases": pa.ListArray.from_arrays(pa.array([0, *(b for _, b in spans)], pa.int32()), phrases),
            **{
                name: pa.array([packed(counts[i, a:b]) for a, b in spans], pa.binary())
                for i, name in enumerate(("n", "left", "right"))
            },
        }
    )


def _summed(least: int):
    """The phrases of all batches in one bucket to the frequent ones with their counts."""

    def run(cells: pa.Table) -> pa.Table:
        whole = pa.table(
            {
                "phrase": cells["phrases"].combine_chunks().flatten(),
                **{c: np.concatenate([unpacked(x) for x in cells[c].to_pylist()]) for c in ("n", "left", "right")},
            }
        )
        total = whole.group_by("phrase").aggregate([(c, "sum") for c in ("n", "left", "right")])
        total = total.rename_columns([c.removesuffix("_sum") for c in total.column_names])
        total = total.filter(pc.greater_equal(total["n"], least))
        lang = pa.array([cells["lang"][0].as_py()] * total.num_rows, pa.string())
        return total.append_column("lang", lang).select(["lang", "phrase", "n", "left", "right"])

    return run


def ngrams(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, shard_words: int = SHARD_WORDS
) -> tuple[DataFrame, DataFrame]:
    """``(lang, all_words)``, and ``(lang, phrase, n, left, right)`` of phrases and single words.

    Phrases of up to ``DEPTH`` words with at least ``least`` occurrences. ``all_words`` is the
    number of all word occurrences of the language; ``left`` and ``right`` are the occurrences
    of a phrase that go on in that direction by a word that makes a frequent pair.
    """
    cut = reread(shards(docs, text, lang, shard_words), "shards")
    each = cut.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n).alias("n"))
    totals = reread(each.groupBy("lang").agg(F.sum("n").alias("all_words")), "totals")
    sizes = totals.select(
        "lang",
        F.ceil(F.col("all_words") / shard_words).cast("int").alias("batches"),
        F.ceil(F.col("all_words") / BUCKET_WORDS).cast("int").alias("buckets"),
    )
    batch = F.pmod(F.xxhash64("shard"), F.greatest("batches", F.lit(1))).cast("int").alias("batch")
    dealt = cut.join(sizes, "lang").withColumn("buckets", F.greatest("buckets", F.lit(1))).withColumn("batch", batch)

    def frequent(counts: DataFrame, kind: int) -> DataFrame:
        return reread(counts.groupBy("lang", "bucket").applyInArrow(_frequent(least, kind), KEPT), "kept")

    def visited(kept: DataFrame, function, schema: str) -> DataFrame:
        own = kept.withColumnsRenamed({"lang": "its_lang", "batch": "its_batch"}).groupBy("its_lang", "its_batch")
        return dealt.groupBy("lang", "batch").cogroup(own).applyInArrow(function, schema)

    counted = dealt.select("lang", "batch", "buckets", "words", "counts").mapInArrow(_word_counts, COUNTS)
    words = frequent(counted, 0)
    pairs = frequent(visited(words, _pairs, COUNTS), 1)
    found = visited(words.unionByName(pairs), _phrases, CELLS)
    return totals, reread(found.groupBy("lang", "bucket").applyInArrow(_summed(least), PHRASES), "phrases")


# --- collocations


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    top: int = TOP,
    covered: tuple[int, int] = COVERED,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language.

    A phrase's cut is the one with the lowest score, ties to the first. Phrases of which a
    longer candidate covers the share ``covered`` are dropped.
    """
    totals, phrases = ngrams(docs, text, lang, least, shard_words)
    counts = phrases.select("lang", F.col("phrase").alias("part"), "n")
    size = F.size("words")
    candidates = phrases.select(
        "lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words")
    ).filter(size > 1)
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, size - F.col("k")), " ").alias("rest"),
    )
    named = [counts.withColumnsRenamed({"part": side, "n": n}) for side, n in (("first", "l"), ("rest", "r"))]
    both = cuts.join(named[0], ["lang", "first"]).join(named[1], ["lang", "rest"])
    exact = "decimal(20,0)"
    score = F.expr(f"cast(a as {exact}) * {SCALE} div (cast(l as {exact}) + cast(r as {exact}))").cast("long")
    scored = (
        both.withColumn("score", score)
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    )
    # every shorter phrase inside a candidate, with the candidate's count
    inside = candidates.filter(size > 2).select(
        "lang", "words", F.col("a").alias("longer"), F.explode(F.sequence(F.lit(2), size - 1)).alias("length")
    )
    inside = inside.select(
        "lang", "words", "longer", "length", F.explode(F.sequence(F.lit(1), size - F.col("length") + 1)).alias("at")
    ).select("lang", F.array_join(F.slice("words", F.col("at"), F.col("length")), " ").alias("phrase"), "longer")
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    share = F.expr(f"cast(longer as {exact}) * {covered[1]} >= cast(a as {exact}) * {covered[0]}")
    kept = scored.join(most, ["lang", "phrase"], "left").filter(~F.coalesce(share, F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals.withColumnRenamed("all_words", "n"), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
