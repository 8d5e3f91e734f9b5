"""The registered queries of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import (
    collocations,
    graph,
    language,
    licenses,
    line_dedup,
    merkle,
    mixing,
    mtree,
    packing,
    quality,
    secrets,
    simhash,
    twins,
    toxicity,
)

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_pruned_graph_ann")
def pruned_graph_ann(spark: SparkSession, sf: str) -> DataFrame:
    return graph.nearest_by_cosine(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op2_source_mixing")
def source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return mixing.mixture(docs, ["doc_id"]).select(
        "row.doc_id",
        "size",
        "source_size",
        "target",
        mixing.taken_words(F.col("draws")).alias("taken"),
    )


@query("op3_license_scan")
def license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.license_matches(table(spark, sf, "documents"))
    span = F.transform("matches", lambda m: F.concat_ws(":", m["template"], m["start"], m["end"]))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.template")), ",").alias("templates"),
        F.array_join(span, ",").alias("spans"),
    )


@query("op4_toxicity")
def toxic_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        language.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op5_fuzzy_line_dedup")
def fuzzy_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lines = F.size(F.split("text", "\n", -1))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(lines).cast("long").alias("n_lines")
    removed = line_dedup.with_removed(docs, [F.col("doc_id"), n_lines])
    return removed.select(
        "row.doc_id",
        "row.n_lines",
        F.size("removed").cast("long").alias("n_removed"),
        "removed",
    )


@query("op6_packing")
def token_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), TOKENIZER)


@query("op7_mtree_top_k")
def mtree_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return mtree.top_inner_products(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op8_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf, "documents"))
    return groups.select(
        "doc_id",
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        "component_id",
    )


@query("op9_language_id")
def language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs)
    return language.label(docs.select("doc_id", "text"), model).select(
        "doc_id",
        language.held_out(F.col("doc_id")).alias("held_out"),
        F.col("_lang").alias("lang_pred"),
        F.col("_lang_score").alias("score"),
    )


@query("op10_secret_scan")
def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf, "documents"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind in secrets.KINDS],
        F.sha2(secrets.joined("base"), 256).alias("base_sha256"),
        secrets.joined("spans").alias("spans"),
    )


@query("op11_collocations", twins.COLLOCATIONS)
def phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


@query("op12_merkle_manifest", twins.MERKLE)
def merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(*merkle.COLUMNS)
    values = [F.col(c) for c in merkle.COLUMNS]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaf = merkle.leaf_digest(values)
    seen = F.when(tampered, merkle.leaf_digest([*values[:-1], lower])).otherwise(leaf)
    rows = merkle.manifest(docs.select("doc_id", "source", leaf.alias("leaf"), seen.alias("seen")))
    root = merkle.folded(F.col("seen"), F.col("proof"))
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        root.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_quality_classifier")
def quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    model = quality.learn(docs, table(spark, sf, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        language.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )
