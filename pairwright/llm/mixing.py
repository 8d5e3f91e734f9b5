"""Mixing sources to target weights, by a multivariate hypergeometric splitting tree.

Targets: all sources share ``share`` times the words of the corpus by weight; a target stops
at ``most`` times its source, and the excess is shared again by weight.

Each source is a line of words: its documents in digest order. The line is cut into blocks of
``block_words``. A source is drawn in passes: whole passes over all its blocks, then one pass
over part of them, in permuted order, the last block of which may be cut, so that the words
drawn equal the rounded target. The draws of all sources are dealt to ``shards`` output
shards: a binary tree halves the number of draws at every node, and how many of a source go
left is drawn from the hypergeometric distribution given what the sources before it took. So
every shard has its exact number of draws, every source its exact quota, and a shard's
draws of a source are a run of its permuted blocks, disjoint from all others. ``order`` of a
draw is the place for the shuffle inside its shard.

Only DataFrame operations are used. A document never leaves its row: draws are an array
column. Places on the line come from one window per (source, digest bucket) and running
totals of the buckets, so a source with most of the corpus is cut like any other. Only the
table of sources (one row each) is ever taken as one list, for weights and the tree.

Defined cases: a null text has size 0 and nothing is taken of it; sources without words have
target 0; a null source is a source of its own, last. Rows that repeat a doc_id are drawn
each for itself. Equal rows are interchangeable. An empty table gives an empty table. Extra
columns are carried only if named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.durable import settled

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 256
SHARDS = 16  # a power of two
BUCKET_DOCS = 4096

WORD = r"[^\x20\x09-\x0D]+"
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"

# Primes; at least one does not divide a number of blocks below 2**58.
STEPS = (1048573, 1048571, 1048559)


def _long(value) -> Column:
    return F.lit(value).cast("long")


def uniform(*parts) -> Column:
    """A number in [0, 1) from a digest of the parts."""
    return F.pmod(F.xxhash64(*parts), _long(1 << 52)) / F.lit(float(1 << 52))


def measured(docs: DataFrame, row: list[str], doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """One row for each document: the carried columns as ``row``, and what mixing needs."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in row]).alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("key"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("digest"),
    )


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(key, source_size, ordinal, target)`` from ``(key, source_size)``, one row each.

    A source is full if its ceiling is no more than its share of what the fuller ones leave;
    sorted by ceiling for each unit of weight, the full ones come first.
    """
    by_name = Window.orderBy((F.col("key") == "").cast("int"), "key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("ordinal") % len(weights) + 1)
    ranked = (
        sizes.withColumn("ordinal", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("ceiling", (most * F.col("source_size")).cast("double"))
    )
    whole = Window.partitionBy()
    fullest = Window.orderBy(F.col("ceiling") / F.col("weight"), "ordinal")
    level = (
        share * F.sum("source_size").over(whole)
        - F.coalesce(F.sum("ceiling").over(fullest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ) / F.sum("weight").over(fullest.rowsBetween(0, Window.unboundedFollowing))
    levelled = ranked.withColumn("level", level).withColumn(
        "full", F.col("ceiling") <= F.col("level") * F.col("weight")
    )
    first = F.min(F.when(~F.col("full"), F.struct(F.col("ceiling") / F.col("weight"), "ordinal", "level")))
    return levelled.withColumn("open", first.over(whole)).select(
        "key",
        "source_size",
        "ordinal",
        F.when(F.col("full"), F.col("ceiling"))
        .otherwise(F.col("weight") * F.col("open.level"))
        .alias("target"),
    )


def quotas(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Add blocks, whole passes, the words of the last pass and the number of draws."""
    step = F.lit(STEPS[-1])
    for prime in reversed(STEPS[:-1]):
        step = F.when(F.col("blocks") % prime != 0, F.lit(prime)).otherwise(step)
    words = F.round("target").cast("long")
    size = F.greatest(F.col("source_size"), _long(1))
    return (
        sources.withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
        .withColumn("passes", F.floor(words / size).cast("long"))
        .withColumn("rest", words - F.col("passes") * F.col("source_size"))
        .withColumn("step", step.cast("long"))
        .withColumn("shift", F.pmod(F.xxhash64("key"), F.greatest(F.col("blocks"), _long(1))))
        # the permuted rank of the line's last block, and the words by which it is short
        .withColumn("last_rank", F.pmod((F.col("blocks") - 1) * F.col("step") + F.col("shift"), F.greatest(F.col("blocks"), _long(1))))
        .withColumn("short", F.col("blocks") * block_words - F.col("source_size"))
        .withColumn("partial", F.ceil(F.col("rest") / block_words).cast("long"))
        .withColumn(
            "partial",
            F.col("partial")
            + (
                (F.col("last_rank") < F.col("partial"))
                & (F.col("partial") * block_words - F.col("short") < F.col("rest"))
            ).cast("long"),
        )
        .withColumn("draws", F.col("passes") * F.col("blocks") + F.col("partial"))
        .drop("partial")
    )


def hypergeometric(good: Column, others: Column, drawn: Column, u: Column) -> Column:
    """The number of ``good`` ones among ``drawn`` out of ``good + others``, for uniform ``u``.

    Inverse of the distribution function, over ten deviations around the mean; the support
    is kept exactly.
    """
    total = (good + others).cast("double")
    mean = drawn * good / F.greatest(total, F.lit(1.0))
    deviation = F.sqrt(
        F.greatest(mean * (others / F.greatest(total, F.lit(1.0))) * ((total - drawn) / F.greatest(total - 1, F.lit(1.0))), F.lit(0.0))
    )
    low = F.greatest(_long(0), drawn - others, F.floor(mean - 10 * deviation - 2).cast("long"))
    high = F.least(good, drawn, F.ceil(mean + 10 * deviation + 2).cast("long"))
    values = F.sequence(F.least(low, high), high)

    def onward(weight: Column, x: Column) -> Column:
        up = (good - x).cast("double") * (drawn - x).cast("double")
        return weight * up / ((x + 1).cast("double") * (others - drawn + x + 1).cast("double"))

    one, none = F.lit(1.0), F.lit(0.0)
    mass = F.aggregate(
        values,
        F.struct(one.alias("w"), none.alias("sum")),
        lambda s, x: F.struct(onward(s["w"], x).alias("w"), (s["sum"] + s["w"]).alias("sum")),
        lambda s: s["sum"],
    )
    return F.aggregate(
        values,
        F.struct(one.alias("w"), (u * mass).alias("left"), _long(-1).alias("pick")),
        lambda s, x: F.struct(
            onward(s["w"], x).alias("w"),
            (s["left"] - s["w"]).alias("left"),
            F.when((s["pick"] < 0) & (s["left"] < s["w"]), x).otherwise(s["pick"]).alias("pick"),
        ),
        lambda s: F.when(s["pick"] < 0, high).otherwise(s["pick"]),
    )


def splitting_tree(sources: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """``(ordinal, upto)``: of each source, the running draws after each shard."""
    levels = shards.bit_length() - 1
    if 1 << levels != shards:
        raise ValueError("shards must be a power of two")
    listed = F.sort_array(F.collect_list(F.struct("ordinal", "draws")))["draws"]
    nodes = sources.agg(listed.alias("left")).select(_long(0).alias("node"), F.col("left").alias("draws"))
    for nodes_at in range(levels):
        total = F.aggregate("draws", _long(0), lambda a, x: a + x)

        def take(s: Column, n: Column) -> Column:
            u = uniform(F.lit(seed), F.lit(nodes_at), F.col("node"), s["i"])
            got = hypergeometric(n, s["pool"] - n, s["room"], u)
            return F.struct(
                (s["room"] - got).alias("room"),
                (s["pool"] - n).alias("pool"),
                (s["i"] + 1).alias("i"),
                F.concat(s["got"], F.array(got)).alias("got"),
            )

        start = F.struct(
            F.floor(F.col("total") / 2).cast("long").alias("room"),
            F.col("total").alias("pool"),
            _long(0).alias("i"),
            F.array().cast("array<bigint>").alias("got"),
        )
        split = nodes.withColumn("total", total).withColumn(
            "got", F.aggregate("draws", start, take, lambda s: s["got"])
        )
        rest = F.zip_with("draws", "got", lambda a, b: a - b)
        nodes = settled(
            split.select(
                F.inline(
                    F.array(
                        F.struct((F.col("node") * 2).alias("node"), F.col("got").alias("draws")),
                        F.struct((F.col("node") * 2 + 1).alias("node"), rest.alias("draws")),
                    )
                )
            )
        )
    running = Window.partitionBy("ordinal").orderBy("node")
    cells = nodes.select("node", F.posexplode("draws").alias("ordinal", "n")).withColumn(
        "upto", F.sum("n").over(running)
    )
    return cells.groupBy("ordinal").agg(
        F.sort_array(F.collect_list(F.struct("node", "upto")))["upto"].alias("upto")
    )


def _drawn(block_words: int, seed: int) -> Column:
    """The draws of a document at ``place`` on its source's line, as an array."""
    size, place = F.col("size"), F.col("place")
    blocks, passes, rest = F.col("blocks"), F.col("passes"), F.col("rest")
    length = _long(block_words)
    last_rank, short = F.col("last_rank"), F.col("short")

    def draw(block: Column, turn: Column) -> Column:
        rank = F.pmod(block * F.col("step") + F.col("shift"), blocks)
        before = rank * length - F.when(last_rank < rank, short).otherwise(_long(0))
        limit = F.when(turn < passes, length).otherwise(
            F.greatest(_long(0), F.least(length, rest - before))
        )
        begin = F.greatest(place, block * length)
        end = F.least(place + size, block * length + limit)
        index = turn * blocks + rank
        shard = F.size(F.filter(F.col("upto"), lambda x: x <= index)).cast("int")
        return F.struct(
            turn.cast("int").alias("pass"),
            shard.alias("shard"),
            block.alias("block"),
            (begin - place).alias("start"),
            (end - begin).alias("words"),
            F.xxhash64(F.lit(seed), shard, F.col("key"), index, begin).alias("order"),
        )

    over = F.sequence(F.floor(place / length).cast("long"), F.floor((place + size - 1) / length).cast("long"))
    turns = F.sequence(_long(0), passes)
    nested = F.transform(turns, lambda turn: F.transform(over, lambda block: draw(block, turn)))
    return F.filter(F.flatten(nested), lambda d: d["words"] > 0)


def mixture(
    docs: DataFrame,
    row: list[str],
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    seed: int = 0,
    bucket_docs: int = BUCKET_DOCS,
    settle: bool = True,
) -> DataFrame:
    """``(row, size, source_size, target, draws)``, one row per document.

    ``row`` names the columns carried along. ``settle`` writes the measured rows once, right
    if they are narrow; with texts among them, they are measured in each of two scans.
    """
    lines = measured(docs, row, doc_id, text, source, seed)
    lines = settled(lines) if settle else lines
    narrow = lines.select("key", "size", "digest")
    buckets = max(1, -(-lines.count() // bucket_docs)) if settle else max(1, -(-docs.count() // bucket_docs))
    bucket = F.pmod(F.col("digest"), _long(buckets)).alias("bucket")
    totals = settled(narrow.groupBy("key", bucket).agg(F.sum("size").alias("words")))
    sources = settled(
        quotas(
            targets(totals.groupBy("key").agg(F.sum("words").alias("source_size")), weights, share, most),
            block_words,
        )
    )
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        totals.select(
            "key", "bucket", F.coalesce(F.sum("words").over(before), _long(0)).alias("before")
        )
        .join(sources.join(splitting_tree(sources, shards, seed), "ordinal"), "key")
        .drop("ordinal", "draws")
    )
    inside = (
        Window.partitionBy("key", "bucket")
        .orderBy("digest", "size", "doc_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = lines.withColumn("bucket", bucket).withColumn(
        "inside", F.coalesce(F.sum("size").over(inside), _long(0))
    )
    empty = F.array().cast(
        "array<struct<pass:int,shard:int,block:bigint,start:bigint,words:bigint,order:bigint>>"
    )
    return (
        placed.join(offsets, ["key", "bucket"])
        .withColumn("place", F.col("before") + F.col("inside"))
        .select(
            "row",
            "size",
            "source_size",
            "target",
            F.when(F.col("size") > 0, _drawn(block_words, seed)).otherwise(empty).alias("draws"),
        )
    )


def taken_words(draws: Column) -> Column:
    return F.aggregate(draws, _long(0), lambda a, d: a + d["words"])


def mixed_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """The mix as documents: one row for each pass in which words of a document are taken.

    A document taken whole keeps its text; of one taken in part, the text is the words
    taken, in order, with the white space before them. Other columns stay as they are.
    """
    mix = mixture(docs, docs.columns, text=text, settle=False, **options)
    turns = F.array_distinct(F.transform("draws", lambda d: d["pass"]))
    rows = mix.withColumn("turn", F.explode(turns)).withColumn(
        "spans",
        F.array_sort(
            F.transform(
                F.filter("draws", lambda d: d["pass"] == F.col("turn")),
                lambda d: F.struct(d["start"].alias("start"), d["words"].alias("words")),
            )
        ),
    )
    words = F.regexp_extract_all(F.col(f"row.{text}"), F.lit(SPACED_WORD), F.lit(0))
    total = F.aggregate("spans", _long(0), lambda a, s: a + s["words"])
    cut = F.array_join(
        F.flatten(
            F.transform(
                F.col("spans"),
                lambda s: F.slice(F.col("words"), (s["start"] + 1).cast("int"), s["words"].cast("int")),
            )
        ),
        "",
    )
    partly = rows.withColumn("words", F.when(total < F.col("size"), words))
    new_text = F.when(F.col("words").isNull(), F.col(f"row.{text}")).otherwise(cut)
    out = {text: F.col("text_taken")}
    if n_chars in docs.columns:
        out[n_chars] = F.length("text_taken").cast(docs.schema[n_chars].dataType)
    return partly.withColumn("text_taken", new_text).select(
        *[out.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )
