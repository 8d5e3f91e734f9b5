"""Vectors in shards of bounded size, and a stated query set searched in every shard.

An index is a table with one row per shard: the pages of the shard's index as one value of
bounded size. Queries are a table of blocks of bounded size. Each (shard, block) pair is one
row of work; only the best few of each query leave it, and a top-k for each query merges
them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.durable import settled

PAIR = ("dim", "shard", "block")
MOST_TASKS = 100_000


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
    )
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``(vec_id, vector)``: one row for each id with a usable vector, the smallest if several."""
    return (
        rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
        .filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"))
    )


def matrix(table: pa.Table) -> np.ndarray:
    """The vectors of a group, all of one length, as rows."""
    flat = table["vector"].combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def packed(rows: DataFrame, size: int, count: int, build: Callable, name: str) -> DataFrame:
    """``(dim, name, <name>_data)``: ``build(ids, matrix)`` pickled, for groups of about ``size``."""
    groups = max(1, -(-count // size))
    data = f"{name}_data"

    def one(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        made = pickle.dumps(build(ids[order], matrix(table)[order]), protocol=5)
        return pa.table(
            {
                "dim": table["dim"].slice(0, 1).cast(pa.int32()),
                name: table["part"].slice(0, 1),
                data: pa.array([made], pa.binary()),
            }
        )

    dealt = rows.withColumn("dim", F.size("vector")).withColumn(
        "part", F.pmod(F.xxhash64("vec_id"), F.lit(groups).cast("long"))
    )
    return (
        dealt.repartition(groups, "dim", "part")
        .groupBy("dim", "part")
        .applyInArrow(one, f"dim int, {name} long, {data} binary")
    )


def searched(
    index: DataFrame, blocks: DataFrame, search: Callable, score: str, n_shards: int, n_blocks: int
) -> DataFrame:
    """``(query_id, vec_id, score)`` from ``search(shard, block)`` over all pairs of rows.

    ``search`` gives three arrays. Each pair is a row of its own, dealt over the tasks; both
    sides bring the key of the pair, so no key of the join has more than one row a side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = pickle.loads(batch.column("shard_data")[i].as_buffer())
                block = pickle.loads(batch.column("block_data")[i].as_buffer())
                query_id, vec_id, found = search(shard, block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_id), pa.array(vec_id), pa.array(found)],
                    ["query_id", "vec_id", "score"],
                )

    def dealt(side: DataFrame, other: str, n: int) -> DataFrame:
        keyed = side.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        return keyed.repartition(min(n_shards * n_blocks, MOST_TASKS), *PAIR)

    pairs = dealt(index, "block", n_blocks).hint("merge").join(dealt(blocks, "shard", n_shards), list(PAIR))
    return pairs.select("shard_data", "block_data").mapInArrow(
        run, f"query_id long, vec_id long, score {score}"
    )


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest scores of each query, ties to the smaller vec_id, ranked from 1."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order).cast("int"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def search_all(
    rows: DataFrame,
    queries: Column,
    build: Callable,
    hold: Callable,
    search: Callable,
    k: int,
    score: str,
    shard_rows: int,
    block_rows: int,
) -> DataFrame:
    """Index ``rows``, search every row that ``queries`` is true for, and rank the results.

    ``build`` makes a shard's index and ``hold`` a block of queries, both from ids and rows.
    """
    rows = settled(rows)
    asked = rows.filter(queries)
    counts = rows.agg(F.count(F.lit(1)), F.count_if(queries)).first()
    index = settled(packed(rows, shard_rows, counts[0], build, "shard"))
    blocks = packed(asked, block_rows, counts[1], hold, "block")
    n_shards, n_blocks = max(1, -(-counts[0] // shard_rows)), max(1, -(-counts[1] // block_rows))
    return best(searched(index, blocks, search, score, n_shards, n_blocks), k)
