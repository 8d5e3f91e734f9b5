"""Words of many texts at once, as numpy arrays of code points.

A word is a run of letters (``str.isalpha``), lower-cased. Everything here works on whole
texts; a list of texts is cut into groups of bounded size by :func:`grouped`.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

# First and last code point of the scripts told apart, in code point order.
SCRIPT_RANGES = (
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
    ("han", 0xF900, 0xFAFF),
    ("han", 0x20000, 0x2FA1F),
)

SCRIPTS = ("none", "other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES))
GROUP_CHARS = 1 << 20


@lru_cache(maxsize=1)
def script_table() -> np.ndarray:
    """Script index of every code point; 0 is no letter, 1 a letter of no listed script."""
    table = np.zeros(0x110000, np.uint8)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = 1
    for name, first, last in SCRIPT_RANGES:
        part = table[first : last + 1]
        part[part > 0] = SCRIPTS.index(name)
    return table


@dataclass
class Words:
    codes: np.ndarray  # code points of all texts, with a zero before each text and at the end
    starts: np.ndarray  # of each word in codes
    sizes: np.ndarray  # letters of each word
    doc: np.ndarray  # the text of each word
    scripts: np.ndarray  # script index of the first letter


@lru_cache(maxsize=1)
def alnum_table() -> np.ndarray:
    """The script table with decimal digits as letters of no listed script."""
    table = script_table().copy()
    table[[c for c in range(0x110000) if chr(c).isdecimal()]] = 1
    return table


def lowered(text: str) -> str:
    """Lower case with every character kept in its place."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


def split_words(texts: list[str | None], digits: bool = False) -> Words:
    joined = "\0" + "\0".join(lowered(t or "").replace("\0", " ") for t in texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    script = (alnum_table() if digits else script_table())[codes]
    letter = script > 0
    edges = np.diff(letter.view(np.int8))
    starts = np.flatnonzero(edges == 1) + 1
    sizes = np.flatnonzero(edges == -1) + 1 - starts
    text_starts = np.flatnonzero(codes == 0)
    doc = np.searchsorted(text_starts, starts) - 1
    return Words(codes, starts, sizes, doc, script[starts])


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(words.sizes):
        return np.zeros(0, np.uint64)
    first = np.cumsum(words.sizes) - words.sizes
    inside = np.arange(words.sizes.sum()) - np.repeat(first, words.sizes)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(words.sizes.max()) + 1, 0x100000001B3, np.uint64))
        code = words.codes[np.repeat(words.starts, words.sizes) + inside].astype(np.uint64)
        mixed = np.add.reduceat(code * power[inside], first)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return mixed ^ (mixed >> np.uint64(32))


def trigrams(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter trigrams of all words, word by word, and the first of each word.

    A word of n letters has n trigrams; its ends count as a letter of their own.
    """
    ends = np.cumsum(words.sizes)
    first = ends - words.sizes
    place = np.repeat(words.starts - first, words.sizes) + np.arange(ends[-1] if len(ends) else 0)
    codes = words.codes
    here = codes[place]
    before = codes[place - 1]
    after = codes[place + 1]
    before[first] = 0
    if len(ends):
        after[ends - 1] = 0
    mixed = (
        before * np.uint32(0x9E3779B1) ^ here * np.uint32(0x85EBCA77) ^ after * np.uint32(0xC2B2AE3D)
    ) * np.uint32(0x27D4EB2F)
    return (mixed >> np.uint32(32 - bits)).astype(np.int32), first


def grouped(sizes: np.ndarray, most: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most ``most`` characters, or of one text."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield start, stop
        start = stop


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, with free memory given back to the system at the end: a Python worker lives on,
    and would hold through all later stages what its largest one took."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
        if trim is not None:
            trim(0)

    return whole
