"""License scan: MinHash bands over overlapping windows find templates, shingles verify.

Texts and templates are words (runs of letters and digits, lower-cased) and shingles of five
words; a template of fewer words is one shingle of its own width. Windows have 1, 4, 16 or 64
shingles and overlap: they start at every quarter of their length. A template is cut into
windows of the largest length that is at most ``SPAN`` of it, so every text that holds
``containment`` of it has room for such windows. Window MinHashes are split into ``BANDS``
bands of ``ROWS`` values; a window that shares a band with a template's window makes the
template a candidate there.

Bands: windows with Jaccard similarity s meet with probability ``1 - (1 - s**ROWS)**BANDS``:
0.99999 at 0.75 and 0.99 at 0.5. A window that starts nearest to a template's own is off by
at most an eighth of its length, similarity 0.78 for a verbatim copy. Windows of one shingle
meet exactly. A template long enough for several windows can meet by any of them.

A candidate is verified on the words themselves: the share of the template's shingles in the
text around the place, which must be at least ``containment``. Matches of one template that
overlap are one match, the span from its first to its last shared shingle.

Defined cases: a null or empty text has no match. Repeated rows give repeated results. Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.words import grouped, split_words, word_hashes

# The wording of public license notices.
TEMPLATES = {
    "all_rights_reserved": "All rights reserved.",
    "apache_2_line": "Licensed under the Apache License, Version 2.0.",
    "apache_2_header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this '
        "file except in compliance with the License. You may obtain a copy of the License at"
    ),
    "bsd_conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:"
    ),
    "cc_by_line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc_by_nc_line": "Licensed under CC BY-NC 4.0.",
    "gpl_3_line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl_3_notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version."
    ),
    "mit_line": "Released under the MIT License.",
    "mit_permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:"
    ),
    "mpl_2_notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If "
        "a copy of the MPL was not distributed with this file, You can obtain one at"
    ),
}

SHINGLE = 5
CONTAINMENT = 0.8
SPAN = 0.6
SIZES = (1, 4, 16, 64)
BANDS, ROWS = 16, 2
TABLE_BITS = 20

_DRAW = np.random.default_rng(23)
_FACTORS = _DRAW.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every shingle of ``width`` words inside a text."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        mixed = np.zeros(n, np.uint64)
        for i in range(width):
            mixed = mixed * np.uint64(0x100000001B3) + words[i : i + n]
        mixed *= _MIX
    first = np.flatnonzero(doc[:n] == doc[width - 1 :])
    return mixed[first], first


def band_keys(shingles: np.ndarray, band: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(size, keys)``: one band of the MinHash of every window, by its first shingle."""
    with np.errstate(over="ignore"):
        lows = [
            (shingles * _FACTORS[band * ROWS + row]) >> np.uint64(32) for row in range(ROWS)
        ]
        for size in SIZES[1:]:
            step = size // 4
            if len(shingles) < size:
                return
            n = len(shingles) - size + 1
            lows = [
                np.minimum(
                    np.minimum(low[:n], low[step : step + n]),
                    np.minimum(low[2 * step : 2 * step + n], low[3 * step : 3 * step + n]),
                )
                for low in lows
            ]
            key = lows[0]
            for low in lows[1:]:
                key = (key * _MIX) ^ low
            yield size, (key + np.uint64(band)) * _MIX


@dataclass
class Index:
    names: list[str]
    shingles: list[list[tuple[str, ...]]]  # of each template, in order
    widths: list[int]
    windows: dict[tuple, dict[int, list[tuple[int, int]]]]  # key -> (template, first shingle)
    tables: dict[tuple, np.ndarray]  # which low bits of a key occur


def word_list(text: str) -> list[str]:
    words = split_words([text], digits=True)
    return [
        words.codes[a : a + n].tobytes().decode("utf-32-le")
        for a, n in zip(words.starts, words.sizes, strict=True)
    ]


def build_index(templates: dict[str, str] = TEMPLATES) -> Index:
    index = Index(sorted(templates), [], [], {}, {})

    def enter(kind: tuple, key: np.uint64, template: int, first: int) -> None:
        index.windows.setdefault(kind, {}).setdefault(int(key), []).append((template, first))
        table = index.tables.setdefault(kind, np.zeros(1 << TABLE_BITS, bool))
        table[int(key) >> (64 - TABLE_BITS)] = True

    for number, name in enumerate(index.names):
        words = word_list(templates[name])
        width = min(SHINGLE, len(words))
        hashes, _ = shingle_hashes(
            word_hashes(split_words([templates[name]], digits=True)), np.zeros(len(words), int), width
        )
        index.widths.append(width)
        index.shingles.append([tuple(words[i : i + width]) for i in range(len(hashes))])
        size = max([s for s in SIZES if s <= SPAN * len(hashes)], default=1)
        starts = sorted({*range(0, len(hashes) - size + 1, size), len(hashes) - size})
        if size == 1:
            for start in starts:
                enter((width, 1, 0), hashes[start], number, start)
            continue
        for band in range(BANDS):
            for found, keys in band_keys(hashes, band):
                if found == size:
                    for start in starts:
                        enter((width, size, band), keys[start], number, start)
    return index


def candidates(index: Index, hashes: np.ndarray, doc: np.ndarray) -> set[tuple[int, int, int]]:
    """``(text, template, word)``: where a template may begin."""
    found: set[tuple[int, int, int]] = set()

    def look(kind: tuple, keys: np.ndarray, first: np.ndarray, text: np.ndarray) -> None:
        hit = np.flatnonzero(index.tables[kind][keys >> np.uint64(64 - TABLE_BITS)])
        windows = index.windows[kind]
        for i in hit.tolist():
            for template, start in windows.get(int(keys[i]), ()):
                found.add((int(text[i]), template, int(first[i]) - start))

    for width in set(index.widths):
        shingles, first = shingle_hashes(hashes, doc, width)
        if not len(shingles):
            continue
        text = doc[first]
        if (width, 1, 0) in index.tables:
            look((width, 1, 0), shingles, first, text)
        if width < SHINGLE:
            continue
        for band in range(BANDS):
            for size, keys in band_keys(shingles, band):
                if (width, size, band) not in index.tables:
                    continue
                at = np.arange(0, len(keys), max(1, size // 4))
                at = at[text[at] == text[at + size - 1]]
                look((width, size, band), keys[at], first[at], text[at])
    return found


def scan(index: Index, texts: list[str | None], containment: float = CONTAINMENT) -> list[list[tuple]]:
    """``(template, start, end, containment)`` of each text, in code points."""
    words = split_words(texts, digits=True)
    out: list[list[tuple]] = [[] for _ in texts]
    if not len(words.doc):
        return out
    counts = np.bincount(words.doc, minlength=len(texts))
    begin = np.cumsum(counts) - counts
    text_start = np.flatnonzero(words.codes == 0) + 1
    met: dict[tuple[int, int], list[int]] = {}
    for text, template, word in candidates(index, word_hashes(words), words.doc):
        met.setdefault((text, template), []).append(word)
    for (text, template), places in sorted(met.items()):
        width, wanted = index.widths[template], index.shingles[template]
        own = set(wanted)
        spare = len(wanted) // 4
        best: list[tuple[int, int, float]] = []
        for place in sorted(set(places)):
            low = max(int(begin[text]), place - spare)
            high = min(int(begin[text] + counts[text]), place + len(wanted) + spare + width - 1)
            near = [
                words.codes[words.starts[i] : words.starts[i] + words.sizes[i]].tobytes().decode("utf-32-le")
                for i in range(low, high)
            ]
            shared = {i: s for i in range(len(near) - width + 1) if (s := tuple(near[i : i + width])) in own}
            share = len(set(shared.values())) / len(own)
            if share < containment:
                continue
            first, last = low + min(shared), low + max(shared) + width - 1
            if best and first <= best[-1][1]:
                best[-1] = (best[-1][0], max(last, best[-1][1]), max(share, best[-1][2]))
            else:
                best.append((first, last, share))
        base = int(text_start[text])
        for first, last, share in best:
            end = int(words.starts[last] + words.sizes[last]) - base
            out[text].append((index.names[template], int(words.starts[first]) - base, end, share))
    return [sorted(found, key=lambda m: (m[1], m[0], m[2])) for found in out]


MATCH = pa.list_(
    pa.struct([("template", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])
)


def _scan_batches(index: Index, containment: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(False)
            for a, b in grouped(sizes):
                found = scan(index, batch.column(1)[a:b].to_pylist(), containment)
                listed = [[dict(zip(("template", "start", "end", "containment"), m, strict=True)) for m in x] for x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(listed, MATCH)], ["doc_id", "matches"]
                )

    return run


def license_matches(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    containment: float = CONTAINMENT,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(doc_id, matches)``, one row per document; ``templates`` is a short list of texts."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _scan_batches(build_index(templates), containment),
        "doc_id long, matches array<struct<template:string,start:long,end:long,containment:double>>",
    )
