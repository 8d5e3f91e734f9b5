"""Secrets in whole texts, also behind URL, Unicode, base64 and compressed layers.

A text is scanned for three kinds of secrets. Then a worklist unwraps it: percent and
backslash or character escapes are decoded over the whole layer, each base64 run becomes a
layer of its own, and zlib or gzip data, base64 or percent encoded, is unpacked until nothing
unpacks. Every new layer is scanned and unwrapped in turn, until none is new; a layer text seen
before at the same span of the original is not taken up again, which ends cycles, while equal
runs in other places are. Each character of a layer knows the span of the original text that
it comes from, so what is found in a layer has a span there.

Matches are leftmost and do not overlap within a kind; those that fail their length are
dropped after matching. Spans are code points, end exclusive, of the whole match.

Defined cases: a null text is empty; a text without a secret has no spans and the digest of
the empty string. A base64 run goes on over line breaks, and its lines count on their own too.
If it is not printable text from its first character, it is read from its first four, so a
prefix of the same alphabet does no harm; compressed data may begin at a line or after one of
``/-_+``. Bytes that are not UTF-8 become U+FFFD; if there are NULs, the text without them
(UTF-16 and UTF-32 of ASCII) is a layer too. Compressed data that breaks off gives what comes
before. Unpacked data is read as a stream; beyond ``WINDOW`` bytes it becomes several layers that
share ``OVERLAP`` bytes, so a secret shorter than that is whole in one of them. A run
within is cut there too: base64 text goes on in the next layer, compressed data does not.
Of one run the first ``most_bytes`` (4 GiB) and ``MOST_LEVELS`` levels are read, as data that unpacks to more of
itself has no end. Repeated rows give repeated results. Extra columns are not read.
"""

from __future__ import annotations

import binascii
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.words import grouped

KINDS = ("assign", "access", "hex")
MOST_BYTES = 1 << 32  # read of the unpacked data of one run
MOST_LEVELS = 64  # of compression around one run
PIECE = 1 << 16
WINDOW = 1 << 24  # bytes of unpacked data that are one layer
OVERLAP = 1 << 20

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of hex digits is matched whole
ESCAPE = re.compile(
    r"((?:%[0-9A-Fa-f]{2})+)|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
    r"|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
)
_BREAK = r"[ \t]*(?:\r\n|\n|\r|(?:\\r)?\\n)[ \t]*"
#: The lines of one run; the first has 16 characters or more.
BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}(?:{_BREAK}[A-Za-z0-9+/_-]+)*")
BREAK = re.compile(_BREAK)
#: Anything that may be decoded.
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16}|%[0-9A-Fa-f]{2}|\\[uUx]|&#")
#: Where compressed data may begin in a run: gzip, or the two bytes of a zlib header.
PACKED = re.compile(r"H4sI|(?:^|(?<=[+/_-]))e[AFJN]")
PERCENT_PACKED = re.compile(
    r"(?:(?i:%1f%8b)|(?:x|%78)(?:\^|(?i:%01|%5e|%9c|%da)))(?:%[0-9A-Fa-f]{2}|[^\s%&<>\"])*"
)

_HEX_RUN = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_STRAY = re.compile("[\udc80-\udcff]")
_URL_SAFE = str.maketrans("-_", "+/")

Span = tuple[int, int, int]  # start, index of the kind, end


def scan(text: str) -> list[Span]:
    """The secrets of one layer."""
    found: list[Span] = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"x" * 24 in text.encode("utf-8", "surrogatepass").translate(_HEX_RUN):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A decoded text; character ``i`` comes from ``[low[i], high[i])`` of the original.

    The places are made when they are asked for: most layers hold nothing.
    """

    def __init__(self, text: str, places: Callable[[], tuple[list[int] | range, list[int] | range]]):
        self.text, self._places, self._made = text, places, None

    def _both(self) -> tuple[list[int] | range, list[int] | range]:
        if self._made is None:
            self._made = self._places()
        return self._made

    @property
    def low(self) -> list[int] | range:
        return self._both()[0]

    @property
    def high(self) -> list[int] | range:
        return self._both()[1]

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return min(self.low[start:end]), max(self.high[start:end])


def unescaped(layer: Layer) -> Layer | None:
    """The layer with percent, backslash and character escapes decoded once."""
    text = layer.text
    if "%" not in text and "\\" not in text and "&#" not in text:
        return None
    parts: list[str] = []
    low: list[int] = []
    high: list[int] = []
    at = 0

    def keep(upto: int) -> None:
        parts.append(text[at:upto])
        low.extend(layer.low[at:upto])
        high.extend(layer.high[at:upto])

    def put(chars: str, start: int, end: int) -> None:
        begin, stop = layer.origin(start, end)
        parts.append(chars)
        low.extend([begin] * len(chars))
        high.extend([stop] * len(chars))

    for m in ESCAPE.finditer(text):
        keep(m.start())
        if m[1]:
            # each decoded character keeps the escapes it is made of
            data = bytes.fromhex(m[1].replace("%", ""))
            place = m.start()
            for char in data.decode("utf-8", "surrogateescape"):
                width = 3 * len(char.encode("utf-8", "surrogateescape"))
                put(char.encode("utf-8", "surrogateescape").decode("utf-8", "replace")[:1], place, place + width)
                place += width
        else:
            digits = m[2] or m[3] or m[4] or m[5]
            code = int(digits, 16) if digits else int(m[6])
            fits = code < 0x110000 and not 0xD800 <= code < 0xE000
            put(chr(code) if fits else "�", m.start(), m.end())
        at = m.end()
    if not at:
        return None
    keep(len(text))
    return Layer("".join(parts), lambda: (low, high))


def _packed(head: bytes) -> bool:
    return head[:2] == b"\x1f\x8b" or (head[:1] == b"\x78" and int.from_bytes(head[:2], "big") % 31 == 0)


def _steps(data: bytes, size: int) -> Iterator[bytes]:
    for i in range(0, len(data), size):
        yield data[i : i + size]


def _unpack(unpacker, data: bytes) -> Iterator[bytes]:
    """What ``data`` adds to the output, in pieces; of broken data, what comes before the fault."""
    while True:
        before = unpacker.copy()
        try:
            out = unpacker.decompress(data, PIECE)
        except zlib.error:
            for step in _steps(data, 64):
                yield before.decompress(step)  # fails again, where the fault is
            raise
        yield out
        data = unpacker.unconsumed_tail
        if unpacker.eof or (not data and len(out) < PIECE):
            return


def inflated(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """What zlib data, or all members of gzip data, unpack to, as far as they go; nothing if it is
    neither. Only a piece of either is held."""
    data, unpacker, first = b"", None, True
    for piece in pieces:
        data += piece
        while data:
            if unpacker is None:
                data = data if first else data.lstrip(b"\0")
                if len(data) < 2:
                    break
                if not _packed(data):
                    return
                unpacker, single, first = zlib.decompressobj(wbits=47), data[:1] == b"\x78", False
            try:
                yield from filter(None, _unpack(unpacker, data))
            except zlib.error:
                return
            data = unpacker.unused_data
            if unpacker.eof:
                if single:
                    return
                unpacker = None


def unpacked(data: bytes, most_bytes: int, window: int = WINDOW, overlap: int = OVERLAP) -> Iterator[bytes]:
    """Compressed data, unpacked until nothing unpacks, in windows that overlap."""

    def begun(stream: Iterator[bytes]) -> tuple[bytes, bool, Iterator[bytes]]:
        head = b""
        for piece in stream:
            head += piece
            if len(head) >= PIECE:
                return head, False, chain([head], stream)
        return head, True, iter([head])

    def within(stream: Iterator[bytes]) -> Iterator[bytes]:
        left = most_bytes
        for piece in stream:
            yield piece[:left]
            left -= len(piece)
            if left <= 0:
                return

    seen: set[bytes] = set()
    head, ended, stream = begun(_steps(data, PIECE))
    levels = 0
    while levels < MOST_LEVELS and head not in seen and next(inflated([head]), None):
        if ended:
            seen.add(head)
        head, ended, stream = begun(within(inflated(stream)))
        levels += 1
    if not levels:
        return
    held = bytearray()
    fresh = 0
    for piece in stream:
        held += piece
        fresh += len(piece)
        while len(held) >= window:
            yield bytes(held[:window])
            del held[: window - overlap]
            fresh = len(held) - overlap
    if fresh > 0:
        yield bytes(held)


def printable(text: str) -> bool:
    plain = text.replace("\n", "").replace("\r", "").replace("\t", "")
    return plain.isprintable() and "\ufffd" not in plain


def readings(data: bytes, place: Callable[[int, int], tuple[int, int]]) -> Iterator[Layer]:
    """Data as text, and without its NULs; ``place`` gives the origin of a range of bytes."""
    raw = data.decode("utf-8", "surrogateescape")

    def places() -> tuple[list[int], list[int]]:
        low: list[int] = []
        high: list[int] = []
        byte = 0
        for char in raw:
            last = byte + (1 if char < "\x80" or "\udc80" <= char <= "\udcff" else len(char.encode()))
            begin, stop = place(byte, last)
            low.append(begin)
            high.append(stop)
            byte = last
        return low, high

    whole = Layer(raw if raw.isascii() else _STRAY.sub("\ufffd", raw), places)
    yield whole
    if "\0" in raw:
        keep = [i for i, char in enumerate(raw) if char != "\0"]
        text = whole.text.replace("\0", "")
        yield Layer(text, lambda: ([whole.low[i] for i in keep], [whole.high[i] for i in keep]))


def decoded(layer: Layer, body: str, where: range | list[int]) -> Iterator[Layer]:
    """What a base64 run holds; character ``i`` of it is character ``where[i]`` of the layer."""
    body = body.translate(_URL_SAFE)
    for start in range(4):
        part = body[start : len(body) - ((len(body) - start) % 4 == 1)]
        if len(part) < 2:
            break
        data = binascii.a2b_base64(part + "=" * (-len(part) % 4))

        def place(first: int, last: int, start: int = start, end: int = len(part)) -> tuple[int, int]:
            upto = min(end, 4 * ((last - 1) // 3) + 4)
            return layer.origin(where[start + 4 * (first // 3)], where[start + upto - 1] + 1)

        clean = False
        for below in readings(data, place):
            clean |= printable(below.text)
            yield below
        if clean:
            break


def unwrapped(layer: Layer, most_bytes: int) -> Iterator[Layer]:
    """All layers that are one decoding below this one."""

    def packed(data: bytes, start: int, end: int) -> Iterator[Layer]:
        origin = None
        for below in unpacked(data, most_bytes):
            origin = origin or layer.origin(start, end)
            yield from readings(below, lambda first, last: origin)

    below = unescaped(layer)
    if below is not None:
        yield below
        for m in PERCENT_PACKED.finditer(layer.text):
            yield from packed(unquote_to_bytes(m[0]), m.start(), m.end())
            if "+" in m[0]:
                yield from packed(unquote_to_bytes(m[0].replace("+", " ")), m.start(), m.end())
    for m in BASE64.finditer(layer.text):
        ends = [(x.start(), x.end()) for x in BREAK.finditer(layer.text, *m.span())]
        lines = list(zip([m.start(), *(b for _, b in ends)], [*(a for a, _ in ends), m.end()], strict=True))
        where: range | list[int] = range(*m.span())
        if len(lines) > 1:
            where = [i for a, b in lines for i in range(a, b)]
        body = "".join(layer.text[a:b] for a, b in lines)
        starts = {x.start() for x in PACKED.finditer(body)}
        at = 0
        for a, b in lines:
            if PACKED.match(body[at : at + 4]):
                starts.add(at)
            at += b - a
        for start in sorted(starts):
            part = body[start:].translate(_URL_SAFE)
            part = part[: len(part) - (len(part) % 4 == 1)]
            data = binascii.a2b_base64(part + "=" * (-len(part) % 4))
            yield from packed(data, where[start], m.end())
        yield from decoded(layer, body, where)
        if len(lines) > 1:
            for a, b in lines:
                if b - a >= 16:
                    yield from decoded(layer, layer.text[a:b], range(a, b))


def find(text: str | None, most_bytes: int = MOST_BYTES) -> tuple[list[Span], list[Span]]:
    """The spans of the text itself, and those of the text and all its layers."""
    text = text or ""
    base = scan(text)
    spans = set(base)
    seen: set[tuple[str, int, int]] = set()
    work = [Layer(text, lambda: (range(len(text)), range(1, len(text) + 1)))]
    while work:
        for below in unwrapped(work.pop(), most_bytes):
            found = scan(below.text)
            if not found and not WRAPPED.search(below.text):
                continue
            key = (below.text, *below.origin(0, len(below.text)))
            if key in seen:
                continue
            seen.add(key)
            work.append(below)
            for start, kind, end in found:
                begin, stop = below.origin(start, end)
                spans.add((begin, kind, stop))
    return base, sorted(spans)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


SCHEMA = (
    "doc_id long, base array<struct<kind:string,start:long,end:long>>, "
    "spans array<struct<kind:string,start:long,end:long>>"
)
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _find_batches(most_bytes: int):
    def listed(spans: list[Span]) -> list[dict]:
        return [{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(False)
            for a, b in grouped(sizes):
                found = [find(text, most_bytes) for text in batch.column(1)[a:b].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        pa.array([listed(base) for base, _ in found], _SPAN),
                        pa.array([listed(spans) for _, spans in found], _SPAN),
                    ],
                    ["doc_id", "base", "spans"],
                )

    return run


def secret_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_bytes: int = MOST_BYTES
) -> DataFrame:
    """``(doc_id, base, spans)``: spans of the plain text, and of it with all its layers."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _find_batches(most_bytes), SCHEMA
    )


def joined(spans: str):
    """``kind:start:end`` of each span, comma-joined, as a column."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def digest(base: list[Span]) -> str:
    return hashlib.sha256(written(base).encode()).hexdigest()
