"""Fingerprints and groups against direct computation."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from llm_fixtures import edge_docs, no_docs, small  # noqa: F401  (fixtures)

from pairwright.llm import simhash
from pairwright.llm.components import components
from pairwright.llm.queries import QUERIES


def direct_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for shingle in shingles:
        value = xxhash.xxh64_intdigest(shingle.encode(), 42)
        for bit in range(64):
            counts[bit] += value >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def direct_groups(values, radius=2):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_query_equals_brute_force(spark, small):
    docs = sorted(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    prints = [direct_print(text) for _, text in docs]
    roots = direct_groups(prints)
    want = {(d[0], f"{p:016x}", docs[r][0]) for d, p, r in zip(docs, prints, roots, strict=True)}
    got = {tuple(r) for r in QUERIES["op8_simhash_near_dedup"](spark, small).collect()}
    assert got == want


@pytest.mark.parametrize(("radius", "blocks", "lanes"), [(2, 4, 8192), (2, 4, 7), (3, 5, 64), (1, 3, 5)])
def test_links_connect_all_near_prints(spark, radius, blocks, lanes):
    draw = random.Random(radius)
    values = set()
    for _ in range(12):
        base = draw.getrandbits(64)
        for _ in range(draw.randint(1, 40)):
            value = base
            for _ in range(draw.randint(0, 4)):
                value ^= 1 << draw.randrange(64)
            values.add(value)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "print long")
    found = components(simhash.print_links(frame, radius, blocks, lanes)).collect()
    got: dict[int, set] = {}
    for node, root in found:
        got.setdefault(root, set()).add(node)
    want: dict[int, set] = {}
    for value, root in zip(signed, direct_groups(values, radius), strict=True):
        want.setdefault(root, set()).add(value)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_components_of_a_chain_a_star_and_a_loop(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)]
    links += [(5000, 5001), (5001, 5002), (5002, 5000), (7, 7), (5000, 5001)]
    frame = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    roots = {r.node: r.root for r in components(frame).collect()}
    assert {roots[i] for i in range(301)} == {0}
    assert {roots[i] for i in range(1000, 1200)} == {1000}
    assert {roots[i] for i in (5000, 5001, 5002)} == {5000}
    assert len(roots) == 301 + 200 + 3
    assert components(frame.limit(0)).count() == 0


def test_majority_of_many_shingles():
    draw = np.random.default_rng(1)
    hashes = [draw.integers(0, 1 << 63, n, dtype=np.uint64) for n in (0, 1, 254, 255, 256, 1000)]
    for print_, values in zip(simhash.majority_bits(hashes), hashes, strict=True):
        counts = [sum(int(v) >> b & 1 for v in values) for b in range(64)]
        assert int(print_) == sum(1 << b for b in range(64) if 2 * counts[b] > len(values))


def test_edge_rows(spark, edge_docs, no_docs):
    got = simhash.near_duplicates(edge_docs).collect()
    assert len(got) == edge_docs.count()
    zero = {r.doc_id for r in got if r["print"] == 0}
    assert zero == {0, 1, 2}
    assert {r.component_id for r in got if r.doc_id in zero} == {0}
    assert {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_survivors_keep_one_row_of_each_group(spark, edge_docs, no_docs):
    kept = simhash.survivors(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect())
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(edge_docs).collect()}
    want = {c for c in near.values() if c is not None}
    assert {i for null, i in ids if not null} == want
    assert len(ids) == len(set(ids))
    assert simhash.survivors(no_docs).count() == 0
