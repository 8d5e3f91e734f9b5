"""Token packing by minimum bin slack.

Every document becomes its token ids and an end id. Its ids are cut every ``capacity`` ids;
the rest is a piece of its own, so pieces differ by length only and the lengths form a
multiset of at most ``capacity`` distinct values, whatever the size of the corpus.

Windows are planned on that multiset: the longest length left opens a window, a bitset
subset-sum over the lengths left (counts split into powers of two) finds the sum closest to
the room left, and backtracking gives how often each length is used. The same window is
taken as often as the counts allow, so the plan has a bounded number of rows too. Where the
capacity cannot be met exactly but a power of two can, that window is taken: it needs no
padding.

Pieces find their place by their rank among pieces of their length: a count for each
(length, digest bucket), running totals of those, and a row number inside a bucket. A length
shared by a third of all pieces is cut into as many buckets as it needs.

Defined cases: a null text is empty and gives the end id alone. Rows that repeat a doc_id are
packed each for itself. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.durable import settled
from pairwright.llm.words import grouped, trimmed

CAPACITY = 4096
END = 2
BUCKET = 4096  # pieces of one length that one rank bucket should hold
CACHE = 400_000  # distinct words, and letter words, whose ids a Python worker remembers

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECES + ", sequence_id long, offset long"


# Letters are one word of the tokenizer, the marks behind them another.
MARKS = b".,!?;:#%&$*|()-"
ACCENTED_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
TOGETHER = 512  # distinct letter words encoded as one text


class WordTokenizer:
    """Ids of a text as little-endian bytes.

    White space separates words in this tokenizer and letter case does not matter, so each
    distinct word is encoded once and remembered up to a bound. A word of Latin letters with
    marks behind it is put together from the ids of its letters and of its marks; letter
    words are encoded many at a time and told apart by the tokens that end a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {b"": b""}

    def _whole(self, words: list[str]) -> Iterator[bytes]:
        for encoding in self.tokenizer.encode_batch_fast(words, add_special_tokens=False):
            yield np.array(encoding.ids, "<u4").tobytes()

    def _letters(self, words: list[str]) -> Iterator[bytes]:
        for start in range(0, len(words), TOGETHER):
            part = words[start : start + TOGETHER]
            text = " ".join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) != len(part):
                yield from self._whole(part)
                continue
            data, at = ids.tobytes(), 0
            for stop in stops:
                yield data[at:stop]
                at = stop

    def _learn(self, missing: list[bytes]) -> None:
        split: list[tuple[bytes, bytes, bytes]] = []
        other: list[bytes] = []
        for word in missing:
            letters = word.rstrip(MARKS)
            if letters.isalpha():  # of bytes: A-Z and a-z only
                split.append((word, letters.lower(), word[len(letters) :]))
            elif m := ACCENTED_LETTERS.fullmatch(letters.decode("utf-8", "replace")):
                split.append((word, m[0].lower().encode(), word[len(letters) :]))
            else:
                other.append(word)
        parts = self.parts
        letters = {x for _, x, _ in split if x not in parts}
        if len(parts) + len(letters) > CACHE:
            self.parts = parts = {b"": b""}
            letters = {x for _, x, _ in split}
        letters = list(letters)
        parts.update(zip(letters, self._letters([x.decode() for x in letters]), strict=True))
        marks = list({x for _, _, x in split if x not in parts})
        parts.update(zip(marks, self._whole([x.decode() for x in marks]), strict=True))
        known = self.known
        for word, a, b in split:
            known[word] = parts[a] + parts[b] if b else parts[a]
        texts = [word.decode("utf-8", "replace") for word in other]
        known.update(zip(other, self._whole(texts), strict=True))

    def forget(self) -> None:
        """Give back the memory of the words known."""
        self.known, self.parts = {}, {b"": b""}

    def encode(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Ids of one text after the other."""
        # lower case early makes fewer distinct words; special tokens are told apart by case
        split = [(t if b"<|" in t else t.lower()).split() if t else [] for t in texts]
        fresh = set().union(*split)
        missing = [w for w in fresh if w not in self.known]
        if len(self.known) + len(missing) > CACHE:
            self.known = {w: self.known[w] for w in fresh if w in self.known}
        self._learn(missing)
        ids_of = self.known.__getitem__
        for words in split:
            yield b"".join(map(ids_of, words))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def _piece_batches(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        closing = np.array([end], "<u4").tobytes()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(False)
            for a, b in grouped(sizes, 2 << 20):
                rows: list[tuple] = []
                encoded = tokenizer.encode(texts[a:b].to_pylist())
                for doc_id, ids in zip(batch.column(0)[a:b].to_pylist(), encoded, strict=True):
                    ids += closing
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )
        tokenizer.forget()

    return run


def pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end: int = END,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The pieces of all documents, before packing."""
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")
    ).mapInArrow(trimmed(_piece_batches(tokenizer, capacity, end)), PIECES)


# --- the plan: windows over the multiset of lengths


def best_sum(counts: dict[int, int], room: int, exact: tuple[int, ...]) -> tuple[int, dict[int, int]]:
    """The multiset out of ``counts`` with the sum closest to ``room``, and its sum.

    If ``room`` cannot be met, the largest of the sums ``exact`` that can is preferred.
    """
    mask = (1 << (room + 1)) - 1
    reach = 1
    layers: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left:
            take = min(step, left)
            layers.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    if total < room:
        total = next((x for x in exact if reach >> x & 1), total)
    used: dict[int, int] = {}
    at = total
    for length, take, before in reversed(layers):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return total, used


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """``(times, {length: count})``: windows that use up ``counts`` exactly."""
    left = {length: n for length, n in counts.items() if n}
    powers = [1 << i for i in reversed(range(capacity.bit_length()))]
    plan = []
    while left:
        longest = max(left)
        left[longest] -= 1
        exact = tuple(p - longest for p in powers if p >= longest)
        _, used = best_sum({x: n for x, n in left.items() if n}, capacity - longest, exact)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[x] // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= times * n
            if not left[x]:
                del left[x]
        plan.append((times, used))
    return plan


def _intervals(plan: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """Ranks of each length by window: sorted keys, first rank, first window, count, offset."""
    taken: dict[int, int] = {}
    rows = []
    window = 0
    for times, used in plan:
        offset = 0
        for length in sorted(used, reverse=True):
            rank = taken.get(length, 0)
            rows.append(((length << 48) | rank, rank, window, used[length], offset))
            taken[length] = rank + times * used[length]
            offset += length * used[length]
        window += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return tuple(np.ascontiguousarray(table[:, i]) for i in range(5))


def _place_batches(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, window, count, base = broadcast.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = np.searchsorted(keys, (length << 48) | rank, "right") - 1
            inside = rank - first[row]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(window[row] + inside // count[row]),
                    pa.array(base[row] + (inside % count[row]) * length),
                ],
                [*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end: int = END,
    doc_id: str = "doc_id",
    text: str = "text",
    bucket: int = BUCKET,
) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; ``tokenizer`` is the path of its file."""
    spark = docs.sparkSession
    cut = settled(pieces(docs, tokenizer, capacity, end, doc_id, text))
    # at most one row for each length up to the capacity
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = spark.sparkContext.broadcast(_intervals(plan_windows(counts, capacity)))
    buckets = F.broadcast(
        spark.createDataFrame(
            [(x, -(-n // bucket)) for x, n in sorted(counts.items())], "length long, buckets long"
        )
    )
    dealt = cut.join(buckets, "length").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("buckets"))
    )
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("length", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (
        dealt.withColumn("inside", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "bucket"])
        .select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens",
            (F.col("before") + F.col("inside")).cast("long").alias("rank"),
        )
    )
    return ranked.mapInArrow(_place_batches(places), PLACED)
