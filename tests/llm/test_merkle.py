"""Merkle manifest against a direct tree."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from llm_fixtures import edge_docs, no_docs, small  # noqa: F401  (fixtures)

from pairwright.llm import merkle


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(*values):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return digest("".join(parts))


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([digest("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return out


def steps(tree, i, fanout):
    for level in tree[:-1]:
        run = i - i % fanout
        yield "".join(level[run:i]), "".join(level[i + 1 : run + fanout])
        i //= fanout


def direct(rows, fanout=16):
    """``rows``: (doc_id, source, leaf) -> sorted (doc_id, leaf, subroot, root, steps)."""
    order = lambda v: (v is not None, v if v is not None else 0)
    groups: dict = {}
    for i, s, d in rows:
        groups.setdefault(s, []).append((i, d))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([d for _, d in sorted(groups[s], key=lambda r: (order(r[0]), r[1]))], fanout) for s in names}
    top = levels([trees[s][-1][0] for s in names], fanout)
    out = []
    for n, s in enumerate(names):
        for k, (i, d) in enumerate(sorted(groups[s], key=lambda r: (order(r[0]), r[1]))):
            path = [*steps(trees[s], k, fanout), *steps(top, n, fanout)]
            out.append((i, d, trees[s][-1][0], top[-1][0], path))
    return sorted(out, key=repr)


def found(leaves, **options):
    rows = merkle.manifest(leaves, **options).collect()
    return sorted(
        [(r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in rows], key=repr
    )


@pytest.mark.parametrize("fanout,sizes", [(2, [1, 2, 9, 70, 33]), (3, [100, 1, 28, 27, 82]), (16, [17, 1, 300])])
def test_trees_of_many_blocks(spark, fanout, sizes):
    rows = [
        (1000 * s + i, f"s{s}", leaf(s, i)) for s, n in enumerate(sizes) for i in range(n)
    ]
    frame = spark.createDataFrame(rows, "doc_id long, source string, leaf string").repartition(5, "leaf")
    assert found(frame, fanout=fanout) == direct(rows, fanout)


def test_many_sources_and_a_null_one(spark):
    rows = [(i, None if i % 41 == 0 else f"{'é' if i % 41 % 2 else 'z'}{i % 41:02}", leaf(i)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, leaf string")
    assert found(frame, fanout=4) == direct(rows, 4)


def test_edge_rows(spark, edge_docs, no_docs):
    columns = [F.col(c) for c in merkle.COLUMNS]
    frame = edge_docs.select("doc_id", "source", merkle.leaf_digest(columns).alias("leaf"), F.lit("x").alias("place"))
    rows = [(r.doc_id, r.source, leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text)) for r in edge_docs.collect()]
    assert found(frame) == direct(rows)
    assert merkle.manifest(frame).columns == [*frame.columns, "subroot", "root", "proof"]
    assert found(no_docs.select("doc_id", "source", merkle.leaf_digest([F.col("text")]).alias("leaf"))) == []


def test_repeated_rows_are_leaves_of_their_own(spark):
    rows = [(7, "a", leaf("same"))] * 40
    frame = spark.createDataFrame(rows, "doc_id long, source string, leaf string")
    assert found(frame) == direct(rows)


def test_a_changed_row_does_not_verify(spark):
    rows = [(i, "ab"[i % 2], leaf(i)) for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, leaf string")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("leaf"))
    root = merkle.folded(changed, F.col("proof"))
    got = merkle.manifest(frame).select("doc_id", (root == F.col("root")).alias("ok")).collect()
    assert {r.doc_id: r.ok for r in got} == {i: zlib.crc32(str(i).encode()) % 5 != 0 for i in range(50)}
