"""Compressed layers of any size, as streams."""

from __future__ import annotations

import base64
import gzip
import random
import zlib

import pytest

from pairwright.llm import secrets

SECRET = b"token = 'Zm9vYmFyYmF6'"


def wrapped(data: bytes) -> str:
    return "see " + base64.b64encode(data).decode() + " ."


def kinds(text: str) -> list[str]:
    base, spans = secrets.find(text)
    last = len(text.rstrip(" .").rstrip("="))  # padding is no part of a run
    assert not base and all((start, end) == (4, last) for start, _, end in spans)
    return [secrets.KINDS[kind] for _, kind, _ in spans]


@pytest.mark.parametrize("padding", [0, 2_000, secrets.WINDOW - 9, (1 << 26) + 5])
@pytest.mark.parametrize("pack", [zlib.compress, gzip.compress])
def test_secret_behind_padding_of_any_length(padding, pack):
    assert kinds(wrapped(pack(b" " * padding + SECRET))) == ["assign"]


def test_windows_hold_every_byte_and_overlap():
    data = random.Random(3).randbytes(300_000)
    parts = list(secrets.unpacked(zlib.compress(data), 1 << 30, window=65_000, overlap=1_000))
    assert parts[0] + b"".join(p[1_000:] for p in parts[1:]) == data
    assert all(len(p) <= 65_000 for p in parts)
    exact = list(secrets.unpacked(zlib.compress(data[:65_000]), 1 << 30, window=65_000, overlap=1_000))
    assert exact == [data[:65_000]]


def test_members_and_levels():
    members = gzip.compress(b"z" * 90_000) + b"\0\0" + gzip.compress(SECRET)
    assert kinds(wrapped(members)) == ["assign"]
    deep = SECRET
    for pack in (zlib.compress, gzip.compress, zlib.compress, gzip.compress):
        deep = pack(deep)
        text = wrapped(deep)
        # an inner stream may be found in the run by itself, so there may be more spans
        assert (4, 0, len(text.rstrip(" .").rstrip("="))) in secrets.find(text)[1]


@pytest.mark.parametrize("size", [300, 200_000])
def test_broken_data_gives_what_comes_before(size):
    draw = random.Random(size)
    data = SECRET + b" " + bytes(draw.choices(b"ghijklmnop \n", k=size))
    cut = bytearray(gzip.compress(data))
    assert kinds(wrapped(bytes(cut[: len(cut) // 2]))) == ["assign"]
    cut[2 * len(cut) // 3 :] = b"\xff" * (len(cut) - 2 * len(cut) // 3)
    assert kinds(wrapped(bytes(cut))) == ["assign"]
    got = b"".join(secrets.inflated([bytes(cut)]))
    assert got[: size // 3] == data[: size // 3]


def test_inflated_is_the_same_for_any_pieces():
    draw = random.Random(8)
    data = bytes(draw.choices(b"abcdefgh", k=150_000))
    packed = gzip.compress(data[:50_000]) + gzip.compress(data[50_000:])
    for size in (1, 7, 4_096, len(packed)):
        pieces = [packed[i : i + size] for i in range(0, len(packed), size)]
        assert b"".join(secrets.inflated(pieces)) == data


def test_what_is_not_compressed():
    assert list(secrets.unpacked(b"x^ plain text, no stream at all", 100)) == []
    assert list(secrets.unpacked(b"", 100)) == []
    assert list(secrets.unpacked(zlib.compress(b""), 100)) == []
    inner = b"x\x9c is how this text begins"
    assert list(secrets.unpacked(zlib.compress(inner), 1_000)) == [inner]
