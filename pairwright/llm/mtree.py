"""Exact top-k by inner product: best-first search in M-trees, one tree a shard.

Vectors become integers, ``floor(scale * x)``. A further component lifts all vectors of a
shard to one norm, which turns the largest inner product into the smallest distance, a
metric. A tree has pages: inner pages hold routing vectors with a covering radius and the
distance to their own parent, leaf pages hold vectors with the distance to theirs.

Best-first: each query opens the page with the smallest lower bound, until that bound is
beyond its k-th distance so far. A child or entry whose stored parent distance already puts
it beyond, by the triangle inequality, is not computed. Queries that open the same page are
computed together. Bounds have a slack far above the rounding error, and scores are exact
integers, so results and ties are exact.

Components of any size: one beyond a long is the nearest long, and so is a score beyond
``MOST`` to either side; scores that become equal that way are ties.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no
part, nor do rows without an id. Of rows that repeat an id the smallest vector counts; a
query's own id is never among its results. Vectors of different lengths are not compared.
Fewer candidates than k: all. Empty tables give empty tables. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.shards import search_all, vectors

SCALE = 64
K = 20
PAGE = 64  # entries of a leaf page
FANOUT = 16  # routing vectors of an inner page
SHARD_ROWS = 8192
BLOCK_ROWS = 4096
MOST = (1 << 63) - 1  # the largest score; -MOST + 1 is the smallest
NONE = -MOST  # no score


@dataclass
class Tree:
    ids: np.ndarray  # entries in leaf order
    entries: np.ndarray
    entry_dist: np.ndarray  # to the routing vector of their page
    norm: float  # squared norm that all are lifted to
    routing: np.ndarray  # of each page
    radius: np.ndarray
    parent_dist: np.ndarray
    first: np.ndarray  # first entry or first child page
    last: np.ndarray
    leaf: np.ndarray


def whole_numbers(rows: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` as longs; what is beyond a long is the nearest long."""
    with np.errstate(over="ignore"):
        out = np.floor(scale * rows.astype(np.float64))
    inside = np.clip(out, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    return np.where(out >= 2.0**63, np.int64(MOST), inside)


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in half the room, if they fit."""
    return x.astype(np.int32) if not x.size or (x.min() >= -(2**31) and x.max() < 2**31) else x


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two tables of longs, between ``-MOST + 1`` and ``MOST``."""
    a_rough, b_rough = a.astype(np.float64), b.astype(np.float64)
    rough = a_rough @ b_rough.T
    a_size, b_size = (np.sqrt((x * x).sum(axis=1)) for x in (a_rough, b_rough))
    if a_size.max(initial=0.0) * b_size.max(initial=0.0) < 2.0**52:
        return rough.astype(np.int64)
    size = np.outer(a_size, b_size)
    error = 1e-12 * size  # far above the rounding error
    # a sum that fits a long is right even where steps on its way wrapped around
    with np.errstate(over="ignore"):
        exact = a.astype(np.int64) @ b.astype(np.int64).T
    low, high = rough - error, rough + error
    exact[low >= 2.0**63] = MOST
    exact[high <= -(2.0**63)] = NONE + 1
    for edge in (2.0**63, -(2.0**63)):
        for i, j in np.argwhere((low < edge) & (high > edge)).tolist():
            score = sum(x * y for x, y in zip(a[i].tolist(), b[j].tolist(), strict=True))
            exact[i, j] = min(max(score, NONE + 1), MOST)
    return np.maximum(exact, NONE + 1)


def build_tree(ids: np.ndarray, rows: np.ndarray, page: int = PAGE, fanout: int = FANOUT) -> Tree:
    """Bulk load: rows are dealt to the nearest of a few routing vectors, page by page."""
    whole = whole_numbers(rows)
    x = whole.astype(np.float64)
    norms = (x * x).sum(axis=1)
    norm = float(norms.max())
    lifted = np.c_[x, np.sqrt(np.maximum(norm - norms, 0))]
    draw = np.random.default_rng(7)
    order = np.arange(len(x))
    pages: list[dict] = [{"rows": order, "routing": 0, "up": 0.0}]
    leaves: list[np.ndarray] = []
    at = 0

    def distance(rows: np.ndarray, center: int) -> np.ndarray:
        gap = lifted[rows] - lifted[center]
        return np.sqrt((gap * gap).sum(axis=1))

    placed = 0
    while at < len(pages):
        here = pages[at]
        rows_here = here["rows"]
        dist = distance(rows_here, here["routing"])
        here["radius"] = float(dist.max()) if len(dist) else 0.0
        if len(rows_here) <= page:
            here |= {"leaf": True, "first": placed, "last": placed + len(rows_here), "dist": dist}
            leaves.append(rows_here)
            placed += len(rows_here)
        else:
            n = min(fanout, -(-len(rows_here) // page))
            centers = draw.choice(rows_here, n, replace=False)
            near = (lifted[rows_here] @ lifted[centers].T).argmax(axis=1)
            parts = [rows_here[near == i] for i in range(n)]
            if max(map(len, parts)) == len(rows_here):  # equal vectors: any cut will do
                parts = np.array_split(rows_here, n)
                centers = np.array([p[0] for p in parts])
            kept = [(p, c) for p, c in zip(parts, centers, strict=True) if len(p)]
            here |= {"leaf": False, "first": len(pages), "last": len(pages) + len(kept)}
            for part, center in kept:
                up = float(distance(np.array([center]), here["routing"])[0])
                pages.append({"rows": part, "routing": int(center), "up": up})
        at += 1
    order = np.concatenate(leaves)
    return Tree(
        ids[order],
        narrow(whole[order]),
        np.concatenate([p["dist"] for p in pages if p["leaf"]]),
        norm,
        narrow(whole[[p["routing"] for p in pages]]),
        np.array([p["radius"] for p in pages]),
        np.array([p["up"] for p in pages]),
        np.array([p["first"] for p in pages]),
        np.array([p["last"] for p in pages]),
        np.array([p["leaf"] for p in pages]),
    )


def hold_queries(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids, whole_numbers(rows)


def search_tree(tree: Tree, block: tuple[np.ndarray, np.ndarray], k: int = K):
    """``(query_id, vec_id, score)`` of the best ``k`` of each query in one tree."""
    query_ids, exact = block
    queries = exact.astype(np.float64)
    n, n_pages = len(queries), len(tree.leaf)
    norms = (queries * queries).sum(axis=1) + tree.norm
    slack = 1e-6 * (1 + np.sqrt(norms.max(initial=0.0)))
    routing = tree.routing.astype(np.float64)
    bound = np.full((n, n_pages), np.inf)  # of pages seen but not opened
    dist = np.zeros((n, n_pages))  # to routing vectors
    top = np.full((n, k), NONE)
    top_id = np.full((n, k), np.iinfo(np.int64).max)
    reach = np.full(n, np.inf)  # distance of the k-th so far
    dist[:, 0] = np.sqrt(np.maximum(norms - 2 * (queries @ routing[0]), 0))
    bound[:, 0] = 0.0
    active = np.arange(n)
    while len(active):
        page = bound[active].argmin(axis=1)
        lowest = bound[active, page]
        going = (lowest <= reach[active] + slack) & (lowest < np.inf)
        active, page = active[going], page[going]
        if not len(active):
            break
        bound[active, page] = np.inf
        order = np.argsort(page, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(page[order]) > 0])
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            p, who = page[order[a]], active[order[a:b]]
            first, last = tree.first[p], tree.last[p]
            limit = reach[who] + slack
            if tree.leaf[p]:
                away = np.abs(dist[who, p][:, None] - tree.entry_dist[first:last])
                wanted = away <= limit[:, None]
                columns = np.flatnonzero(wanted.any(axis=0))
                if not len(columns):
                    continue
                ids = tree.ids[first + columns]
                scores = inner_products(exact[who], tree.entries[first + columns])
                scores[~wanted[:, columns]] = NONE
                scores[ids[None, :] == query_ids[who][:, None]] = NONE
                better = (scores >= top[who, -1:]) & (scores > NONE)
                rows = np.flatnonzero(better.any(axis=1))
                if not len(rows):
                    continue
                # only the columns that can matter, sorted by score, then by id
                use = np.flatnonzero(better[rows].any(axis=0))
                own = who[rows]
                both = np.concatenate([top[own], scores[np.ix_(rows, use)]], axis=1)
                both_id = np.concatenate(
                    [top_id[own], np.broadcast_to(ids[use], (len(rows), len(use)))], axis=1
                )
                pick = np.lexsort((both_id, -both), axis=-1)[:, :k]
                top[own] = np.take_along_axis(both, pick, axis=1)
                top_id[own] = np.take_along_axis(both_id, pick, axis=1)
                # smaller scores than the smallest are ties with it, however far away
                full = top[own, -1] > NONE + 1
                reach[own[full]] = np.sqrt(
                    np.maximum(norms[own[full]] - 2.0 * top[own[full], -1], 0)
                )
            else:
                away = np.abs(dist[who, p][:, None] - tree.parent_dist[first:last])
                wanted = away - tree.radius[first:last] <= limit[:, None]
                columns = np.flatnonzero(wanted.any(axis=0))
                if not len(columns):
                    continue
                gap = norms[who][:, None] - 2 * (queries[who] @ routing[first + columns].T)
                to_child = np.sqrt(np.maximum(gap, 0))
                low = np.maximum(to_child - tree.radius[first + columns], 0)
                low[~wanted[:, columns]] = np.inf
                dist[np.ix_(who, first + columns)] = to_child
                bound[np.ix_(who, first + columns)] = low
    there = top > NONE
    query = np.repeat(query_ids, there.sum(axis=1))
    return query, top_id[there], top[there]


def top_inner_products(
    rows: DataFrame,
    queries: Column,
    k: int = K,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; ``queries`` is a condition on ``vec_id``."""
    return search_all(
        vectors(rows, vec_id, vector),
        queries,
        build_tree,
        hold_queries,
        lambda tree, block: search_tree(tree, block, k),
        k,
        "long",
        shard_rows,
        block_rows,
    )
