"""Approximate nearest neighbours by cosine: robust-pruned directed graphs, one a shard.

Vectors are scaled to length one, where the nearest by distance is the nearest by cosine.
A vector with a cosine of ``near`` or more to its nearest node
becomes a point of that node instead of one of its own, so a crowd of near copies cannot
fill the beam; every point of a node that a search ends with is looked at. Nodes enter in batches: a beam search of the graph so
far proposes neighbours, and pruning keeps a candidate only if no neighbour kept before is
nearer to it than ``1 / alpha`` of its distance to the node, so edges stay diverse. Edges are
also added backwards, and a node over its degree is pruned again. Nodes that the entry
cannot reach get an edge from a node it can. A query runs one beam search in each shard, all
queries of a block in step; what the beam holds is scored again in double precision on the
original vectors.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component
take no part, nor do rows without an id. Of rows that repeat an id the smallest vector
counts; a query's own id is never among its results. Vectors of different lengths are not
compared. Fewer candidates than k: all. Empty tables give empty tables. Extra columns are not
read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.shards import search_all, vectors

K = 5
DEGREE = 24
BUILD_BEAM = 48
SEARCH_BEAM = 128
ALPHA = 1.2
NEAR = 0.98  # cosine from which a vector goes to its nearest node instead of being one
CROWD = 32  # points of a node above which they are looked through by a matrix product
INSERT = 256  # nodes that enter at once
SHARD_ROWS = 8192
BLOCK_ROWS = 4096
IN_STEP = 512  # queries searched at once


@dataclass
class Graph:
    nodes: np.ndarray  # unit vectors, float32
    edges: np.ndarray  # (nodes, width), -1 where there is none
    entry: int
    points: np.ndarray  # the distinct original vectors, node by node
    point_first: np.ndarray  # first point of each node; one more at the end
    ids: np.ndarray  # point by point, ascending
    id_first: np.ndarray  # first id of each point; one more at the end


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


def beam_search(
    nodes: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes met by each query, nearest first; -1 where there are fewer."""
    n = len(queries)
    ids = np.full((n, beam), -1, np.int64)
    dots = np.full((n, beam), -np.inf, np.float32)
    done = np.ones((n, beam), bool)
    seen = np.zeros((n, len(nodes)), bool)
    ids[:, 0], dots[:, 0], done[:, 0] = entry, queries @ nodes[entry], False
    seen[:, entry] = True
    active = np.arange(n)
    while True:
        closed = done[active]
        at = (~closed).argmax(axis=1)
        active, at = active[(going := ~closed[np.arange(len(active)), at])], at[going]
        if not len(active):
            return ids, dots
        done[active, at] = True
        near = edges[ids[active, at]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        row, column = np.nonzero(fresh)
        found = near[row, column]
        seen[active[row], found] = True
        got = np.full(near.shape, -np.inf, np.float32)
        got[row, column] = np.einsum("ij,ij->i", nodes[found], queries[active[row]])
        both = np.concatenate([dots[active], got], axis=1)
        pick = np.argsort(-both, axis=1, kind="stable")[:, :beam]
        take = np.take_along_axis
        dots[active] = take(both, pick, axis=1)
        ids[active] = take(np.concatenate([ids[active], near], axis=1), pick, axis=1)
        done[active] = take(np.concatenate([done[active], ~fresh], axis=1), pick, axis=1)
        ids[active] = np.where(dots[active] > -np.inf, ids[active], -1)


def robust_prune(
    nodes: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float
) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each node out of its candidates (-1: none)."""
    n = len(own)
    order = np.sort(candidates, axis=1)
    repeated = np.zeros(order.shape, bool)
    repeated[:, 1:] = order[:, 1:] == order[:, :-1]
    candidates = np.where(repeated | (order == own[:, None]), -1, order)
    x = nodes[candidates]
    away = np.maximum(2 - 2 * np.einsum("ncd,nd->nc", x, nodes[own]), 0)
    away[candidates < 0] = np.inf
    order = np.argsort(away, axis=1, kind="stable")
    candidates = np.take_along_axis(candidates, order, axis=1)
    away = np.take_along_axis(away, order, axis=1)
    x = np.take_along_axis(x, order[:, :, None], axis=1)
    between = np.maximum(2 - 2 * np.matmul(x, x.transpose(0, 2, 1)), 0)
    alive = away < np.inf
    kept = np.full((n, degree), -1, np.int64)
    rows = np.arange(n)
    for i in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        kept[some, i] = candidates[some, first[some]]
        # squared distances: alpha enters squared
        alive &= ~(alpha * alpha * between[rows, first] <= away)
        alive[rows, first] = False
    return kept


def _add_backwards(nodes, edges, sources: np.ndarray, kept: np.ndarray, degree: int, alpha: float) -> None:
    source = np.repeat(sources, kept.shape[1])
    target = kept.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    goals, start, number = np.unique(target, return_index=True, return_counts=True)
    for part in range(0, len(goals), 512):
        which = slice(part, part + 512)
        width = int(number[which].max(initial=0))
        new = np.full((len(goals[which]), width), -1, np.int64)
        place = np.arange(number[which].sum()) - np.repeat(
            np.cumsum(number[which]) - number[which], number[which]
        )
        first = start[which][0]
        new[np.repeat(np.arange(len(new)), number[which]), place] = source[first : first + len(place)]
        joined = np.concatenate([edges[goals[which]], new], axis=1)
        full = (joined >= 0).sum(axis=1) > degree
        # room left: close the gaps; too many: prune
        tight = np.take_along_axis(joined, np.argsort(joined < 0, axis=1, kind="stable"), axis=1)
        edges[goals[which][~full]] = tight[~full, :degree]
        for some in np.array_split(np.flatnonzero(full), max(1, full.sum() // 128)):
            if len(some):
                own = goals[which][some]
                edges[own] = robust_prune(nodes, own, joined[some], degree, alpha)


def reached(edges: np.ndarray, entry: int) -> np.ndarray:
    seen = np.zeros(len(edges), bool)
    seen[entry] = True
    front = np.array([entry])
    while len(front):
        near = np.unique(edges[front])
        near = near[near >= 0]
        front = near[~seen[near]]
        seen[front] = True
    return seen


def build_graph(
    ids: np.ndarray,
    rows: np.ndarray,
    degree: int = DEGREE,
    beam: int = BUILD_BEAM,
    alpha: float = ALPHA,
    near: float = NEAR,
) -> Graph:
    rows = np.ascontiguousarray(rows)
    raw = rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel()
    _, sample, point = np.unique(raw, return_index=True, return_inverse=True)
    points = rows[sample]
    exact = points.astype(np.float64)
    exact /= np.abs(exact).max(axis=1, keepdims=True)
    unit = (exact / _lengths(exact)[:, None]).astype(np.float32)
    n = len(unit)
    edges = np.full((n, degree), -1, np.int64)
    entry = int((unit @ unit.mean(axis=0)).argmax())
    owner = np.full(n, -1, np.int64)
    owner[entry] = entry
    turn = np.random.default_rng(11).permutation(n)
    turn = turn[turn != entry]
    at, size = 0, 1
    while at < len(turn):
        now = turn[at : at + size]
        met, dots = beam_search(unit, edges, entry, unit[now], beam)
        close = dots[:, 0] >= near
        owner[now] = np.where(close, met[:, 0], now)
        now, met = now[~close], met[~close]
        if len(now):
            for part in np.array_split(np.arange(len(now)), max(1, len(now) // 128)):
                edges[now[part]] = robust_prune(unit, now[part], met[part], degree, alpha)
            _add_backwards(unit, edges, now, edges[now], degree, alpha)
        at += size
        size = min(2 * size, INSERT)
    # nodes alone, numbered anew; their points and the points' ids behind them
    node = np.flatnonzero(owner == np.arange(n))
    number = np.full(n + 1, -1, np.int64)  # the last one for no edge
    number[node] = np.arange(len(node))
    edges, nodes, entry = number[edges[node]], unit[node], int(number[entry])
    while not (seen := reached(edges, entry)).all():  # edges that make every node reachable
        lost = np.flatnonzero(~seen)[:INSERT]
        met, _ = beam_search(nodes, edges, entry, nodes[lost], 1)
        extra = np.full(len(nodes), -1, np.int64)
        extra[met[:, 0]] = lost  # one for each node met; the rest in the next turn
        edges = np.concatenate([edges, extra[:, None]], axis=1)
    owner = number[owner]
    by_node = np.argsort(owner, kind="stable")
    place = np.empty(n, np.int64)
    place[by_node] = np.arange(n)
    by_point = np.lexsort((ids, place[point]))
    return Graph(
        nodes,
        edges.astype(np.int32),
        entry,
        points[by_node],
        np.searchsorted(owner[by_node], np.arange(len(nodes) + 1)),
        ids[by_point],
        np.searchsorted(place[point][by_point], np.arange(n + 1)),
    )


def hold_queries(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids, rows.astype(np.float64)


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...``, ``count[i]`` of each, one after the other."""
    start = np.cumsum(count) - count
    return np.repeat(first - start, count) + np.arange(count.sum())


def _points_met(graph: Graph, unit: np.ndarray, met: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(query, point)`` to score exactly: all points of the nodes met; of a node with many,
    those that a single-precision product does not put surely behind ``k + 1`` others."""
    row, column = np.nonzero(met >= 0)
    node = met[row, column]
    count = graph.point_first[node + 1] - graph.point_first[node]
    small = count <= CROWD
    pairs = [
        (np.repeat(row[small], count[small]), _runs(graph.point_first[node[small]], count[small]))
    ]
    for big in np.unique(node[~small]):
        first, last = graph.point_first[big], graph.point_first[big + 1]
        who = row[node == big]
        near = graph.points[first:last].astype(np.float64)
        dots = unit[who].astype(np.float64) @ (near / _lengths(near)[:, None]).T
        limit = np.partition(dots, -(k + 1), axis=1)[:, -(k + 1)] - 1e-5
        query, point = np.nonzero(dots >= limit[:, None])
        pairs.append((who[query], first + point))
    return tuple(np.concatenate(x) for x in zip(*pairs, strict=True))


def search_graph(graph: Graph, block: tuple[np.ndarray, np.ndarray], k: int = K, beam: int = SEARCH_BEAM):
    """``(query_id, vec_id, score)``: what the beam search of each query found, rescored."""
    query_ids, queries = block
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(queries), IN_STEP):
        asked, own_ids = queries[start : start + IN_STEP], query_ids[start : start + IN_STEP]
        unit = asked / np.abs(asked).max(axis=1, keepdims=True)
        unit = (unit / _lengths(unit)[:, None]).astype(np.float32)
        met, _ = beam_search(graph.nodes, graph.edges, graph.entry, unit, beam)
        query, point = _points_met(graph, unit, met, k)
        here, there = asked[query], graph.points[point].astype(np.float64)
        score = np.einsum("ij,ij->i", here, there) / (_lengths(here) * _lengths(there))
        # the k + 1 smallest ids of equal vectors are enough
        count = np.minimum(graph.id_first[point + 1] - graph.id_first[point], k + 1)
        vec = graph.ids[_runs(graph.id_first[point], count)]
        query, score = np.repeat(query, count), np.repeat(score, count)
        other = vec != own_ids[query]
        query, vec, score = query[other], vec[other], score[other]
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        begin = np.flatnonzero(np.r_[True, np.diff(query) > 0]) if len(query) else np.zeros(0, int)
        rank = _runs(np.zeros(len(begin), np.int64), np.diff(np.r_[begin, len(query)]))
        top = rank < k
        out.append((own_ids[query[top]], vec[top], score[top]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest_by_cosine(
    rows: DataFrame,
    queries: Column,
    k: int = K,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    beam: int = SEARCH_BEAM,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; ``queries`` is a condition on ``vec_id``."""
    usable = vectors(rows, vec_id, vector).filter(F.exists("vector", lambda x: x != 0))
    return search_all(
        usable,
        queries,
        build_graph,
        hold_queries,
        lambda graph, block: search_graph(graph, block, k, beam),
        k,
        "double",
        shard_rows,
        block_rows,
    )
