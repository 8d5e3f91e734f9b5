"""Merkle manifest of a dataset: a tree for each group, a tree over their roots, and proofs.

A leaf is the SHA-256 of a row's values; a node is that of its children's hex digests, and
every ``fanout`` consecutive nodes of a level have one parent until one node remains. Leaves
of a group ascend by id (null first; equal ids by digest); groups ascend by name (null first,
UTF-8 bytewise).

Butterfly exchange: each run of ``fanout ** HEIGHT`` leaves is a block, hashed on its own. Then
in round r, blocks whose numbers differ in digit r alone swap roots: each receives the roots
of its aligned run and hashes their parent itself, so all blocks below a node own it. After
logarithmically many rounds every block holds its part of all upper proofs; nothing is sent
down. A node that ends the tree early has fewer blocks than askers; they take turns. The
roots of groups go through the same exchange as blocks of one leaf.

How it stays bounded: rows are placed by a range shuffle and counts for each partition, so a
hot group or id is spread; a task holds one block; a block's row holds ``fanout`` digests a
level. To the driver go the number of blocks and of groups.

Defined cases: a null value is written ``-``, so null and empty differ. Rows that repeat are
leaves of their own. A null id sorts first. A group of one row is its own root. An empty table gives an
empty manifest. Columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.llm.durable import settled

FANOUT = 16
HEIGHT = 3  # levels hashed inside a block
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of the values, each with its length in bytes before it."""
    texts = [v.cast("string") for v in values]
    sized = [
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    ]
    return F.sha2(F.concat(*sized), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


# --- places


def placed(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with their place in the order of ``order``, from 0, without a window over all.

    Sorted ranges are written once; a row's place is its number in its range plus the rows of
    the ranges before. There is one count for each range.
    """
    laid = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    numbered = laid.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = numbered.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = ranges.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # one row for each partition of the table
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        numbered.join(F.broadcast(before), "_range")
        .withColumn(name, F.col("_before") + inside)
        .drop("_at", "_range", "_before")
    )


# --- blocks


def subtree(leaves: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """The levels above some leaves: ``height`` of them, or up to a single node."""
    levels = [leaves]
    while len(levels) <= height if height is not None else len(levels[-1]) > 1:
        last = levels[-1]
        runs = ("".join(last[i : i + fanout]) for i in range(0, len(last), fanout))
        levels.append([sha256(run.encode()).hexdigest() for run in runs])
    return levels


def _block_levels(table: pa.Table, fanout: int) -> list[list[str]]:
    whole = table["tree_leaves"][0].as_py() > fanout**HEIGHT
    return subtree(table["leaf"].to_pylist(), fanout, HEIGHT if whole else None)


def _root_of_block(fanout: int):
    def run(table: pa.Table) -> pa.Table:
        root = _block_levels(table.sort_by("place"), fanout)[-1][0]
        return table.select(["tree", "block", "tree_leaves"]).slice(0, 1).append_column("root", pa.array([root]))

    return run


def _proofs_of_block(fanout: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        levels = _block_levels(table, fanout)
        # steps of a node's proof above its own level, shared by the leaves below it
        above: list[list[dict]] = [[]]
        for level in reversed(levels[:-1]):
            steps = []
            for i in range(len(level)):
                start = i - i % fanout
                step = {"left": "".join(level[start:i]), "right": "".join(level[i + 1 : start + fanout])}
                steps.append([step, *above[i // fanout]])
            above = steps
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return table.drop_columns(["tree_leaves", "place"]).append_column("proof", pa.array(above, kind))

    return run


def butterfly(blocks: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``(tree, block, root, proof)`` of ``blocks`` with ``(tree, block, blocks, root)``.

    ``blocks`` is the number of blocks of the tree, ``root`` in the result the root of the
    whole tree, ``proof`` the steps from the block's own root to it.
    """
    state = settled(blocks.select("tree", "block", "blocks", "root", F.array().cast(STEPS).alias("proof")))
    most = state.agg(F.max("blocks")).first()[0] or 0
    span = 1  # blocks below a full node of this round
    while span < most:
        node = F.floor(F.col("block") / span)
        first = node - node % fanout
        last = F.least(first + (fanout - 1), F.ceil(F.col("blocks") / span) - 1)
        asked = (
            state.filter(F.col("blocks") > span)
            .withColumn("other", F.explode(F.sequence(first, last)))
            .withColumn("below", F.least(F.lit(span), F.col("blocks") - F.col("other") * span))
            .select("tree", "block", "other",
                    (F.col("other") * span + F.col("block") % span % F.col("below")).alias("sender"))
        )
        sent = state.select("tree", F.col("block").alias("sender"), F.col("root").alias("sent"))
        runs = (
            asked.join(sent, ["tree", "sender"])
            .groupBy("tree", "block")
            .agg(F.array_sort(F.collect_list(F.struct("other", "sent"))).alias("run"))
        )
        step = F.struct(
            F.array_join(F.filter("run", lambda r: r["other"] < node)["sent"], "").alias("left"),
            F.array_join(F.filter("run", lambda r: r["other"] > node)["sent"], "").alias("right"),
        )
        swapped = F.col("run").isNotNull()
        state = settled(
            state.join(runs, ["tree", "block"], "left").select(
                "tree",
                "block",
                "blocks",
                F.when(swapped, F.sha2(F.array_join(F.col("run.sent"), ""), 256)).otherwise(F.col("root")).alias("root"),
                F.when(swapped, F.concat("proof", F.array(step))).otherwise(F.col("proof")).alias("proof"),
            )
        )
        span *= fanout
    return state.select("tree", "block", "root", "proof")


def manifest(
    leaves: DataFrame, group: str = "source", row_id: str = "doc_id", leaf: str = "leaf", fanout: int = FANOUT
) -> DataFrame:
    """Every row of ``leaves`` with ``subroot``, ``root`` and ``proof``, the steps up to the root.

    ``proof`` lists, from the leaf up, the joined digests left and right of the node. Rows
    carry their other columns.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in leaves.columns]).alias("row")
    rows = settled(
        leaves.select(
            own,
            F.col(f"`{group}`").isNotNull().alias("named"),
            F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("")).alias("name"),
            F.col(f"`{row_id}`").alias("id"),
            F.col(f"`{leaf}`").alias("leaf"),
            F.monotonically_increasing_id().alias("nth"),
        )
    )
    at = placed(rows, ["named", "name", "id", "leaf", "nth"], "at")
    sizes = settled(at.groupBy("named", "name").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("tree_leaves")))
    trees = settled(placed(sizes, ["named", "name"], "tree"))
    place = F.col("at") - F.col("start")
    dealt = settled(
        at.join(trees, ["named", "name"]).select(
            "tree", F.floor(place / fanout**HEIGHT).alias("block"), "tree_leaves", place.alias("place"), "leaf", "row"
        )
    )
    block_roots = (
        dealt.drop("row")
        .groupBy("tree", "block")
        .applyInArrow(_root_of_block(fanout), "tree long, block long, tree_leaves long, root string")
    )
    count = F.ceil(F.col("tree_leaves") / fanout**HEIGHT).alias("blocks")
    in_tree = butterfly(block_roots.select("tree", "block", count, "root"), fanout)
    subroots = in_tree.filter("block = 0").select(F.lit(0).alias("tree"), F.col("tree").alias("block"), "root")
    groups = trees.count()
    over_trees = butterfly(subroots.withColumn("blocks", F.lit(groups).cast("long")), fanout)
    upper = settled(
        in_tree.withColumnsRenamed({"root": "subroot", "proof": "in_tree"}).join(
            over_trees.select(F.col("block").alias("tree"), "root", F.col("proof").alias("over_trees")), "tree"
        )
    )
    schema = T.StructType([dealt.schema[c] for c in ("tree", "block", "leaf", "row")])
    step = T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])
    proofs = dealt.groupBy("tree", "block").applyInArrow(
        _proofs_of_block(fanout), schema.add("proof", T.ArrayType(step))
    )
    return proofs.join(upper, ["tree", "block"]).select(
        "row.*", "subroot", "root", F.concat("proof", "in_tree", "over_trees").alias("proof")
    )
