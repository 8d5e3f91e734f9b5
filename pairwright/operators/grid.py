"""The experiment grid as a table."""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.keys import condition_key, fraction_token
from pairwright.study import Study

IDENTITY = ("dataset", "retained_fraction", "retained_fraction_token", "seed", "model")
STRATUM = ("dataset", "retained_fraction", "retained_fraction_token", "model")


def level_table(spark: SparkSession, study: Study) -> DataFrame:
    """One row per declared (dataset, fraction), with its declared place."""
    rows = [
        (d, dataset, f, Decimal(fraction))
        for d, (dataset, fractions) in enumerate(study.levels.items())
        for f, fraction in enumerate(fractions)
    ]
    names = ["dataset_ordinal", "dataset", "fraction_ordinal", "retained_fraction"]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.decimal128(3, 2)]
    columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
    return spark.createDataFrame(pa.table(columns, names=names)).withColumn("retained_fraction_token", fraction_token(F.col("retained_fraction")))


def with_seeds(rows: DataFrame, study: Study) -> DataFrame:
    return rows.withColumn("seed", F.explode(F.array(*[F.lit(seed) for seed in study.seeds])))


def with_models(rows: DataFrame, study: Study) -> DataFrame:
    models = F.array(*[F.lit(model) for model in study.models])
    return rows.select("*", F.posexplode(models).alias("model_ordinal", "model"))


def condition_grid(spark: SparkSession, study: Study) -> DataFrame:
    """Every condition of the study; ``ordinal`` is its place in declared order."""
    grid = with_models(with_seeds(level_table(spark, study), study), study)
    seeds, models = len(study.seeds), len(study.models)
    level_start, running = {}, 0
    for dataset, fractions in study.levels.items():
        level_start[dataset] = running
        running += len(fractions)
    starts = F.create_map(*[F.lit(item) for pair in level_start.items() for item in pair])
    seed_place = F.array_position(F.array(*[F.lit(s) for s in study.seeds]), F.col("seed")) - 1
    level_place = starts[F.col("dataset")] + F.col("fraction_ordinal")
    return grid.select(
        ((level_place * seeds + seed_place) * models + F.col("model_ordinal"))
        .cast("long")
        .alias("ordinal"),
        condition_key(
            F.col("dataset"), F.col("retained_fraction_token"), F.col("seed"), F.col("model")
        ).alias("key"),
        *IDENTITY,
    )


def strata(spark: SparkSession, study: Study) -> DataFrame:
    return with_models(level_table(spark, study), study).select(*STRATUM)


def canonical_order(rows: DataFrame, study: Study) -> DataFrame:
    """Rows in declared order (dataset, fraction, seed, model), not alphabetical."""
    place = {
        "dataset": list(study.levels),
        "model": list(study.models),
    }
    fractions = {
        f"{dataset}|{fraction:.2f}": i
        for dataset, levels in study.levels.items()
        for i, fraction in enumerate(levels)
    }
    lookup = F.create_map(*[F.lit(item) for pair in fractions.items() for item in pair])
    ordinal = lambda column: F.array_position(
        F.array(*[F.lit(v) for v in place[column]]), F.col(column)
    )
    level = lookup[
        F.concat_ws("|", "dataset", F.col("retained_fraction").cast("decimal(3,2)").cast("string"))
    ]
    tail = [F.col("seed")] if "seed" in rows.columns else []
    return rows.orderBy(ordinal("dataset"), level, *tail, ordinal("model"))


def key_set_digest(
    rows: DataFrame, group: list[str], key: str = "key", name: str = "keys_sha256"
) -> DataFrame:
    """SHA-256 of the distinct sorted keys, one per line.

    For keys of a declared study, whose number does not grow with the data.
    """
    keys = F.sort_array(F.collect_set(key))
    text = F.concat(F.array_join(keys, "\n"), F.lit("\n"))
    return rows.groupBy(*group).agg(F.sha2(text, 256).alias(name))


def key_manifest(spark: SparkSession, study: Study, scope: str) -> DataFrame:
    """Row count and key digest of the grid as one row."""
    grid = condition_grid(spark, study).withColumn("scope", F.lit(scope))
    count = grid.groupBy("scope").agg(F.count(F.lit(1)).alias("condition_count"))
    return count.join(key_set_digest(grid, ["scope"], name="condition_keys_sha256"), "scope")


def key_manifest_violations(manifest: DataFrame, rows: DataFrame, study: Study) -> DataFrame:
    """Compare a stored key list ``rows(pos, key, ...)`` and its header row with the grid."""
    spark = rows.sparkSession
    grid = condition_grid(spark, study)
    expected = key_manifest(spark, study, "expected").first()
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    joined = counted.join(grid.select("key", "ordinal"), "key", "full_outer")
    per_key = joined.select(
        F.col("key").alias("subject"),
        F.when(F.col("ordinal").isNull(), "unexpected_key")
        .when(F.col("n").isNull(), "missing_key")
        .when(F.col("n") > 1, "duplicate_key")
        .when(F.col("pos") != F.col("ordinal"), "key_out_of_order")
        .alias("code"),
    ).filter("code IS NOT NULL")
    header = manifest.select(
        "condition_count", "condition_keys_sha256",
        F.lit(expected["condition_count"]).alias("want_count"),
        F.lit(expected["condition_keys_sha256"]).alias("want_digest"),
    )
    of_header = header.select(
        F.explode(
            F.filter(
                F.array(
                    F.when(F.col("condition_count") != F.col("want_count"), "count_changed"),
                    F.when(F.col("condition_keys_sha256") != F.col("want_digest"), "digest_changed"),
                ),
                lambda code: code.isNotNull(),
            )
        ).alias("code")
    ).select(F.lit("manifest").alias("subject"), "code")
    return per_key.unionByName(of_header)
