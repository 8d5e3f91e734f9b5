"""Graph and tree searches against brute force."""

from __future__ import annotations

import math
import operator

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import small  # noqa: F401  (fixtures)

from pairwright.llm import graph, mtree
from pairwright.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, rank int"


def vectors_of(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows.sort()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32)


def direct(ids, scores, own, k):
    order = np.lexsort((ids, -scores))
    return [(int(ids[i]), scores[i]) for i in order if ids[i] != own][:k]


def test_tree_query_is_exact(spark, small):
    ids, rows = vectors_of(spark, small)
    x = np.floor(64 * rows.astype(np.float64)).astype(np.int64)
    want = [
        (int(q), rank, i, int(s))
        for q in ids[ids % 20 == 0]
        for rank, (i, s) in enumerate(direct(ids, x @ x[np.flatnonzero(ids == q)[0]], q, 20), 1)
    ]
    assert sorted(map(tuple, QUERIES["op7_mtree_top_k"](spark, small).collect())) == sorted(want)


def test_graph_query_recall(spark):
    folder = "/root/testdata/sf0.1"
    ids, rows = vectors_of(spark, folder)
    x = rows.astype(np.float64)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    got: dict = {}
    for q, rank, i, score in QUERIES["op1_pruned_graph_ann"](spark, folder).collect():
        got.setdefault(q, []).append((rank, i, score))
    queries = ids[ids % 50 == 0]
    assert set(got) == set(queries.tolist())
    hits = 0
    for q in queries.tolist():
        found = sorted(got[q])
        assert [rank for rank, _, _ in found] == [1, 2, 3, 4, 5]
        scores = unit @ unit[np.flatnonzero(ids == q)[0]]
        for _, i, score in found:
            assert score == pytest.approx(scores[np.flatnonzero(ids == i)[0]], abs=1e-12)
        hits += len({i for _, i, _ in found} & {i for i, _ in direct(ids, scores, q, 5)})
    assert hits >= 0.9 * 5 * len(queries)


@pytest.fixture(scope="module")
def crowd(spark):
    """A third of equal vectors, a crowd of near copies, repeated ids and unusable vectors."""
    draw = np.random.default_rng(9)
    base = draw.normal(size=8)
    rows = [(i, base.tolist(), 1) for i in range(0, 200)]
    rows += [(i, (base + 0.01 * draw.normal(size=8)).tolist(), 1) for i in range(200, 400)]
    rows += [(i, draw.normal(size=8).tolist(), 1) for i in range(400, 600)]
    rows += [(7, base.tolist(), 1), (None, base.tolist(), 1), (700, None, 1), (701, [], 1)]
    rows += [(702, [None] * 8, 1), (703, [float("nan")] * 8, 1), (704, [float("inf")] * 8, 1)]
    rows += [(710, [0.0] * 8, 1), (720, [1.0, 2.0], 1), (721, [2.0, 1.0], 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def usable(crowd, zero):
    rows = {}
    for i, v, _ in crowd.collect():
        bad = i is None or not v or any(c is None or not np.isfinite(c) for c in v)
        if not bad and (zero or any(v)):
            rows[i] = np.array(v, np.float32).astype(np.float64)
    return rows


@pytest.mark.parametrize("shard_rows", [64, 10_000])
def test_tree_with_ties_and_bad_rows(spark, crowd, shard_rows):
    rows = {i: np.floor(64 * v) for i, v in usable(crowd, True).items()}
    got = mtree.top_inner_products(
        crowd, F.col("vec_id") % 10 == 0, 20, shard_rows=shard_rows, block_rows=16
    ).collect()
    want = []
    for q in [i for i in rows if i % 10 == 0]:
        ids = np.array(sorted(i for i in rows if len(rows[i]) == len(rows[q])))
        scores = np.array([rows[i] @ rows[q] for i in ids])
        want += [(q, r, i, int(s)) for r, (i, s) in enumerate(direct(ids, scores, q, 20), 1)]
    assert sorted(map(tuple, got)) == sorted(want)


WIDE = [1e9, 3e7, 1e17, 1.7e17, 1e19, 1e300, 9e15, 2.0**57]


def wide_rows():
    """Small vectors, some with one or more components of any size, and sums that cancel."""
    draw = np.random.default_rng(12)
    rows = {i: draw.normal(size=4) for i in range(120)}
    for i in range(0, 120, 3):
        rows[i][draw.integers(4)] = WIDE[i // 3 % len(WIDE)] * draw.choice([-1, 1])
    for i in range(1, 40, 3):
        rows[i] = np.array([1e9, -1e9, 1e9, draw.normal()]) * draw.choice([-1, 1])
    return rows


@pytest.mark.parametrize("shard_rows", [32, 10_000])
def test_components_of_any_size(spark, shard_rows):
    rows = wide_rows()
    table = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<double>")
    found = mtree.top_inner_products(table, F.col("vec_id") % 2 == 0, 7, shard_rows=shard_rows, block_rows=16)
    most = 2**63 - 1

    def whole(x):
        return math.floor(64 * x) if abs(x) < 1e18 else most if x > 0 else -most - 1

    exact = {i: [min(max(whole(x), -most - 1), most) for x in v.tolist()] for i, v in rows.items()}
    want = []
    for q in range(0, 120, 2):
        scores = {i: sum(map(operator.mul, exact[q], v)) for i, v in exact.items() if i != q}
        scores = {i: min(max(s, 1 - most), most) for i, s in scores.items()}
        order = sorted(scores, key=lambda i: (-scores[i], i))[:7]
        want += [(q, r, i, scores[i]) for r, i in enumerate(order, 1)]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_inner_products_at_the_edges_of_a_long():
    draw = np.random.default_rng(4)
    a = draw.integers(-(2**33), 2**33, (60, 3))
    b = draw.integers(-(2**31), 2**31, (60, 3))
    a[:20, 0], b[:20, 0] = 2**62, 2
    a[:20, 1:] >>= 30
    got = mtree.inner_products(a, b)
    for i, x in enumerate(a.tolist()):
        for j, y in enumerate(b.tolist()):
            score = sum(map(operator.mul, x, y))
            assert got[i, j] == min(max(score, 2 - 2**63), 2**63 - 1)


def test_each_pair_of_shard_and_block_is_a_key_of_its_own(spark, crowd):
    found = mtree.top_inner_products(crowd, F.col("vec_id") % 10 == 0, shard_rows=64, block_rows=16)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1 and all(joins[0].count(f"{key}#") >= 2 for key in ("dim", "shard", "block"))


def test_graph_with_ties_and_bad_rows(spark, crowd):
    rows = usable(crowd, False)
    got: dict = {}
    found = graph.nearest_by_cosine(crowd, F.col("vec_id") % 10 == 0, 5, shard_rows=200)
    for q, rank, i, score in found.collect():
        got.setdefault(q, []).append((rank, i, score))
    hits = total = 0
    for q in [i for i in rows if i % 10 == 0]:
        ids = np.array(sorted(i for i in rows if len(rows[i]) == len(rows[q])))
        if len(ids) == 1:
            assert q not in got
            continue
        length = np.linalg.norm
        scores = np.array([rows[i] @ rows[q] / (length(rows[i]) * length(rows[q])) for i in ids])
        want = direct(ids, scores, q, 5)
        assert len(got[q]) == len(want)
        hits += sum(abs(a[2] - b[1]) < 1e-9 for a, b in zip(sorted(got[q]), want, strict=True))
        total += len(want)
        if q < 200:  # ties go to the smaller ids
            assert [i for _, i, _ in sorted(got[q])] == [i for i in range(6) if i != q][:5]
    assert hits >= 0.95 * total


def test_empty_tables(spark, crowd):
    none = crowd.limit(0)
    assert mtree.top_inner_products(none, F.col("vec_id") % 10 == 0).count() == 0
    assert graph.nearest_by_cosine(none, F.col("vec_id") % 10 == 0).count() == 0
    one = crowd.filter(F.col("vec_id") == 500)
    assert mtree.top_inner_products(one, F.col("vec_id") % 10 == 0).count() == 0
    assert graph.nearest_by_cosine(one, F.col("vec_id") % 10 == 0).count() == 0


def test_every_node_is_reachable():
    draw = np.random.default_rng(3)
    rows = np.concatenate([draw.normal(size=(300, 16)), 50 + draw.normal(size=(300, 16))])
    made = graph.build_graph(np.arange(600), rows.astype(np.float32))
    assert graph.reached(made.edges, made.entry).all()
    assert sorted(made.ids.tolist()) == list(range(600))
