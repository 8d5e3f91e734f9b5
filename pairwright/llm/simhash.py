"""Near-duplicate documents by SimHash fingerprints, compared in bit-sliced blocks.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of three words with
repeats; a bit is set if it is set in more than half of the shingles' XXH64 values.

Links: fingerprints within ``radius`` bits. Equal fingerprints are folded first. Of
``blocks`` equal bit blocks at least ``blocks - radius`` agree in any linked pair, so each
distinct fingerprint goes to one bucket for every choice of that many blocks. A bucket holds
its fingerprints as vertical bit planes, 64 to a machine word. One fingerprint is compared
with a whole word at a time: the planes are xor-ed one after the other into carry-save
counters, and words in which every lane has passed the radius are abandoned. A bucket above
``lanes`` fingerprints is cut into chunks and each pair of chunks is a task row group of its
own, so no task needs a bucket whole. Buckets hand on only the links of a spanning forest.

Defined cases: a null or empty text, or one without words, has fingerprint zero, and zero is
linked like any other. Fewer than three words are one shingle. Rows that repeat a doc_id are
documents of their own that share the id. A null doc_id never names a group unless all ids
of the group are null. Empty tables give empty tables. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.components import components
from pairwright.llm.durable import settled

SEED = 42
SHINGLE = 3
BATCH_CHARS = 4 << 20  # text bytes whose shingle hashes are held at once

LOW_BITS = np.uint64(0x0101010101010101)
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle of one text, as unsigned 64-bit values."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)),
        np.uint64,
        len(starts),
    )


def majority_bits(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint for each array of hashes: the bits set in over half of them."""
    values = np.concatenate([np.zeros(0, np.uint64), *hashes])
    return majority_of_runs(values, np.array([len(h) for h in hashes], np.int64))


def majority_of_runs(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``majority_bits`` of arrays that lie one behind the other.

    Bits are counted in byte-wide counters, eight to a word: at most 255 hashes are added
    before the counters are read out.
    """
    prints = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return prints
    sizes = sizes[full]
    chunks = (sizes + 254) // 255
    first = np.cumsum(sizes) - sizes
    first_chunk = np.cumsum(chunks) - chunks
    inside = np.arange(chunks.sum()) - np.repeat(first_chunk, chunks)
    starts = np.repeat(first, chunks) + 255 * inside
    counts = np.empty((len(full), 64), np.int64)
    for shift in range(8):
        part = np.add.reduceat((values >> np.uint64(shift)) & LOW_BITS, starts)
        lanes = part.view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts[:, shift::8] = np.add.reduceat(lanes, first_chunk, axis=0)
    bits = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little")
    prints[full] = bits.view(np.uint64).ravel()
    return prints


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.binary())
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + BATCH_CHARS)))
            hashes = [shingle_hashes(t) for t in texts[start:stop].to_pylist()]
            prints = majority_bits(hashes).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(c[start:stop] for c in batch.columns[:-1]), pa.array(prints)],
                [*batch.schema.names[:-1], "print"],
            )
            start = stop


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, print)``: the fingerprint of each document, its 64 bits as a long."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _print_batches, "doc_id long, print long"
    )


# --- links of distinct fingerprints


def bit_planes(prints: np.ndarray, words: np.ndarray, lanes: np.ndarray, n_words: int) -> np.ndarray:
    """Vertical planes ``(64, n_words)``: bit ``lane`` of plane ``b`` is bit ``b`` of a print."""
    cells = np.zeros((n_words, 64), np.uint64)
    cells[words, lanes] = prints
    bits = np.unpackbits(cells.view(np.uint8).reshape(n_words, 64, 8), axis=2, bitorder="little")
    packed = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64).reshape(64, n_words)


def near_lanes(
    planes: np.ndarray, queries: np.ndarray, words: np.ndarray, valid: np.ndarray, radius: int
) -> tuple[np.ndarray, np.ndarray]:
    """Compare each query with all 64 lanes of its word; ``(item, mask)`` of those with hits.

    ``valid`` marks the lanes in use. The counters are the bit-sliced numbers of differing
    bits seen so far; a lane that passes the radius is marked as out, and items with all
    lanes out are abandoned every eight planes.
    """
    n_counters = radius.bit_length()
    item = np.arange(len(queries))
    out = ~valid
    counters = [np.zeros(len(queries), np.uint64) for _ in range(n_counters)]
    for plane in range(64):
        bit = (queries >> np.uint64(plane)) & np.uint64(1)
        carry = planes[plane][words] ^ (np.uint64(0) - bit)
        for i in range(n_counters):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        out |= carry
        # lanes whose number is above the radius
        above = np.zeros_like(out)
        level = np.full_like(out, ALL)
        for i in reversed(range(n_counters)):
            if radius >> i & 1:
                level = level & counters[i]
            else:
                above |= level & counters[i]
                level = level & ~counters[i]
        out |= above
        if plane % 8 == 7:
            keep = np.flatnonzero(out != ALL)
            if len(keep) < len(out):
                item, queries, words, out = item[keep], queries[keep], words[keep], out[keep]
                counters = [c[keep] for c in counters]
            if not len(item):
                break
    return item, ~out


class _Forest:
    """Groups of the rows of one batch of buckets, by smallest index."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            apart = low != high
            if not apart.any():
                return
            a, b, low, high = a[apart], b[apart], low[apart], high[apart]
            np.minimum.at(root, high, low)
            while True:
                jumped = root[root]
                if (jumped == root).all():
                    break
                root[:] = jumped


def bucket_links(
    keys: np.ndarray, prints: np.ndarray, radius: int, items: int = 1 << 16
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the prints within ``radius``, inside runs of equal ``keys``."""
    n = len(keys)
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1])]) if n else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, n])
    alone = sizes < 2
    if alone.all():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = ~np.repeat(alone, sizes)
    prints, sizes = prints[keep], sizes[~alone]
    n = len(prints)
    starts = np.cumsum(sizes) - sizes
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(n) - starts[bucket]
    n_words = (sizes + 63) // 64
    first_word = np.cumsum(n_words) - n_words
    word = first_word[bucket] + place // 64
    total = int(n_words.sum())
    planes = bit_planes(prints.view(np.uint64), word, place % 64, total)
    row_of_word = np.zeros(total, np.int64)
    row_of_word[word[place % 64 == 0]] = np.flatnonzero(place % 64 == 0)
    in_word = np.bincount(word, minlength=total)
    valid = np.where(in_word == 64, ALL, (np.uint64(1) << (in_word % 64).astype(np.uint64)) - np.uint64(1))
    forest = _Forest(n)
    # each print against its own word and the later words of its bucket
    spans = first_word[bucket] + n_words[bucket] - word
    ends = np.cumsum(spans)
    done = 0
    while done < n:
        base = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, base + items, "right")))
        span = spans[done:upto]
        query = np.repeat(np.arange(done, upto), span)
        words = word[query] + np.arange(len(query)) - np.repeat(np.cumsum(span) - span, span)
        hit, mask = near_lanes(planes, prints.view(np.uint64)[query], words, valid[words], radius)
        if len(hit):
            lanes = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, lane = np.nonzero(lanes)
            forest.join(query[hit[at]], row_of_word[words[hit[at]]] + lane)
        done = upto
    tied = np.flatnonzero(forest.root != np.arange(n))
    return prints[tied], prints[forest.root[tied]]


def _link_batches(radius: int):
    """Rows sorted by key, in; links, out. A run of equal keys may cross batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = bucket_links(rows[0], rows[1], radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(np.stack([c.to_numpy(False) for c in batch.columns]))
            rows = np.concatenate(kept, axis=1) if rows_differ(kept) else None
            if rows is not None:
                cut = int(np.flatnonzero(rows[0] != rows[0, -1])[-1]) + 1
                yield from links(rows[:, :cut])
                kept = [rows[:, cut:]]
        if kept:
            yield from links(np.concatenate(kept, axis=1))

    def rows_differ(parts: list[np.ndarray]) -> bool:
        return parts[0][0, 0] != parts[-1][0, -1]

    return run


def print_links(
    prints: DataFrame, radius: int = 2, blocks: int = 4, lanes: int = 1 << 13
) -> DataFrame:
    """``(a, b)``: links that connect all distinct prints within ``radius`` bits.

    ``prints`` has one row per distinct value in column ``print``.
    """
    if blocks <= radius:
        raise ValueError("there must be more blocks than the radius")
    edges = [64 * b // blocks for b in range(blocks + 1)]
    part = [
        F.shiftrightunsigned(F.col("print"), low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        for low, high in zip(edges, edges[1:], strict=False)
    ]
    choices = list(combinations(range(blocks), blocks - radius))
    keys = [
        F.xxhash64(F.lit(i), *[part[b] for b in choice]) for i, choice in enumerate(choices)
    ]
    spread = prints.select("print", F.explode(F.array(*keys)).alias("key"))
    crowded = (
        spread.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .select("key", F.ceil(F.col("n") / lanes).cast("int").alias("chunks"))
    )
    chunk = F.pmod(F.xxhash64("print", F.lit(1)), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    dealt = (
        spread.join(crowded, "key")
        .withColumn("chunk", chunk)
        .select("key", "print", "chunk", other)
        .select(
            F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("key"),
            "print",
        )
    )
    return (
        dealt.repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_link_batches(radius), "a long, b long")
    )


def print_groups(prints: DataFrame, radius: int = 2, blocks: int = 4, lanes: int = 1 << 13) -> DataFrame:
    """``(print, root)`` of all distinct prints: a group's root is its smallest print."""
    distinct = settled(prints.select("print").distinct())
    roots = components(print_links(distinct, radius, blocks, lanes))
    return distinct.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn(
        "root", F.coalesce("root", "print")
    )


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """``(doc_id, print, component_id)``, one row per row of ``docs``."""
    per_doc = settled(fingerprints(docs, doc_id, text))
    distinct = per_doc.groupBy("print").agg(F.min("doc_id").alias("low"))
    rooted = distinct.join(print_groups(per_doc, **options), "print")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("print", "component_id")
    return per_doc.join(named, "print").select("doc_id", "print", "component_id")


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id, null last, of rows that share
    it the one with the smallest text digest, and one of rows equal in both."""
    keys = [
        F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("_doc"),
        F.xxhash64(F.col(text)).alias("_text"),
    ]
    per_doc = settled(
        docs.select(*keys, F.col(text).alias("text")).mapInArrow(
            _print_batches, "_doc long, _text long, print long"
        )
    )
    first = per_doc.groupBy("print").agg(F.min(F.struct("_doc", "_text")).alias("first"))
    kept = (
        first.join(print_groups(per_doc, **options), "print")
        .groupBy("root")
        .agg(F.min("first").alias("first"))
        .select("first._doc", "first._text")
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *keys)
    equal = Window.partitionBy("_doc", "_text").orderBy(F.lit(0))
    return (
        rows.join(kept, ["_doc", "_text"], "left_semi")
        .withColumn("_copy", F.row_number().over(equal))
        .filter(F.col("_copy") == 1)
        .select("row.*")
    )
