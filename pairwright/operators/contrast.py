"""Paired contrasts between arms and their bootstrap intervals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.digests import bootstrap_seed
from pairwright.functions.scores import interpret_interval
from pairwright.operators.grid import STRATUM
from pairwright.operators.ordering import side_by_side
from pairwright.study import LABELS, RESAMPLES, Contrast, Study

QUANTILES = (0.025, 0.975)
DRAWS_PER_DIGEST = 8  # 32 bits each
RESAMPLES_PER_TASK = 250


def restrict_to_grid(rows: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(grid.select(*keys), list(keys), "left_semi")


def arm_join(
    arms: Mapping[str, DataFrame], keys: Sequence[str], metric: str = "roc_auc"
) -> DataFrame:
    """Inner join of the arms on the condition; one metric column per arm."""
    joined = None
    for name, rows in arms.items():
        side = rows.select(*keys, F.col(metric).alias(name))
        joined = side if joined is None else joined.join(side, list(keys))
    return joined


def paired_differences(
    joined: DataFrame, keys: Sequence[str], contrasts: Sequence[Contrast]
) -> DataFrame:
    """One row per (condition, contrast) with ``difference``."""
    entries = [
        F.struct(
            F.lit(c.name).alias("contrast"),
            (F.col(c.minuend) - F.col(c.subtrahend)).alias("difference"),
        )
        for c in contrasts
    ]
    return joined.select(*keys, F.inline(F.array(*entries)))


def mean_difference(differences: DataFrame, stratum: Sequence[str]) -> DataFrame:
    return differences.groupBy(*stratum, "contrast").agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("difference").alias("estimate")
    )


def _pairs(differences: DataFrame, by: Sequence[str], pair: str) -> DataFrame:
    """The differences of a stratum in seed order: as many as the study has seeds."""
    return differences.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(pair, "difference")))["difference"].alias("d"),
        F.avg("difference").alias("estimate"),
    )


def bootstrap_draws(
    differences: DataFrame,
    by: Sequence[str],
    draw_seed: Column,
    *,
    pair: str = "seed",
    resamples: int = RESAMPLES,
) -> DataFrame:
    """Mean of each resample. Draw ``j`` of resample ``b`` is digest bits of
    (seed, b, j), so it does not depend on partitioning or retries."""
    n = F.size("d")
    digest = F.sha2(
        F.concat_ws("|", "draw_seed", F.col("b").cast("string"), F.col("block").cast("string")),
        256,
    )

    def picked(k: int) -> Column:
        bits = F.conv(F.substring(F.col("h"), 8 * k + 1, 8), 16, 10).cast("long")
        return F.when(
            F.col("block") * DRAWS_PER_DIGEST + k < n, F.get(F.col("d"), (bits % n).cast("int"))
        ).otherwise(0.0)

    some = sum((picked(k) for k in range(1, DRAWS_PER_DIGEST)), picked(0))
    chunks = F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(RESAMPLES_PER_TASK))
    last = F.least(F.col("start") + RESAMPLES_PER_TASK, F.lit(resamples)) - 1
    # A given number of partitions: the rows are few and small, their draws are many.
    tasks = int(differences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        _pairs(differences, by, pair)
        .withColumn("draw_seed", draw_seed.cast("string"))
        .withColumn("start", F.explode(chunks))
        .repartition(tasks, *by, "start")
        .withColumn("b", F.explode(F.sequence(F.col("start"), last)))
        .withColumn(
            "block",
            F.explode(F.sequence(F.lit(0), F.floor((n - 1) / DRAWS_PER_DIGEST).cast("int"))),
        )
        .withColumn("h", digest)
        .select(*by, "b", "estimate", n.alias("pairs"), some.alias("part"))
        .groupBy(*by, "b")
        .agg(
            F.first("estimate").alias("estimate"),
            F.first("pairs").alias("pairs"),
            (F.sum("part") / F.first("pairs")).alias("mean"),
        )
    )


def paired_bootstrap(
    differences: DataFrame,
    by: Sequence[str],
    draw_seed: Column,
    *,
    pair: str = "seed",
    resamples: int = RESAMPLES,
    threshold: float = 0.01,
    quantiles: tuple[float, float] = QUANTILES,
) -> DataFrame:
    """Estimate, percentile interval and practical label per stratum and contrast."""
    means = bootstrap_draws(differences, by, draw_seed, pair=pair, resamples=resamples)
    return (
        means.groupBy(*by)
        .agg(
            F.first("pairs").alias("pairs"),
            F.first("estimate").alias("estimate"),
            F.percentile("mean", list(quantiles)).alias("_q"),
        )
        .select(
            *by,
            "pairs",
            "estimate",
            F.get("_q", 0).alias("ci_lower"),
            F.get("_q", 1).alias("ci_upper"),
        )
        .withColumn(
            "interpretation", interpret_interval(F.col("ci_lower"), F.col("ci_upper"), threshold)
        )
    )


def _resample_group(resamples: int, quantiles: tuple[float, float]):
    def resample(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("_pair")
        values = ordered["difference"].to_numpy()
        generator = np.random.Generator(np.random.PCG64(int(ordered["draw_seed"].iloc[0])))
        picks = generator.integers(0, len(values), size=(resamples, len(values)))
        low, high = np.quantile(values[picks].mean(axis=1), quantiles, method="linear")
        kept = ordered.drop(columns=["_pair", "difference"]).head(1)
        return kept.assign(
            pairs=len(values), estimate=float(values.mean()), ci_lower=low, ci_upper=high
        )

    return resample


def paired_bootstrap_pcg64(
    differences: DataFrame,
    by: Sequence[str],
    draw_seed: Column,
    *,
    pair: str = "seed",
    resamples: int = RESAMPLES,
    threshold: float = 0.01,
    quantiles: tuple[float, float] = QUANTILES,
) -> DataFrame:
    """The same interval from the PCG64 stream of ``draw_seed``.

    A group is one stratum and contrast: as many rows as the study has seeds.
    """
    rows = differences.select(
        *by,
        draw_seed.cast("string").alias("draw_seed"),
        F.col(pair).alias("_pair"),
        F.col("difference").cast("double").alias("difference"),
    )
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                     for f in rows.schema if f.name not in ("_pair", "difference"))
    return (
        rows.groupBy(*by)
        .applyInPandas(
            _resample_group(resamples, quantiles),
            f"{kept}, pairs INT, estimate DOUBLE, ci_lower DOUBLE, ci_upper DOUBLE",
        )
        .withColumn(
            "interpretation", interpret_interval(F.col("ci_lower"), F.col("ci_upper"), threshold)
        )
    )


def study_seed(study: Study) -> Column:
    """Bootstrap seed of a (stratum, contrast) row under the study's namespace."""
    return bootstrap_seed(
        study.bootstrap_namespace, F.col("dataset"), F.col("retained_fraction_token"),
        F.col("model"), F.col("contrast"), study.resamples,
    )


def stratum_summaries(
    differences: DataFrame, study: Study, stratum: Sequence[str] = STRATUM, *, pcg64: bool = False
) -> DataFrame:
    """The tidy summary: one row per (stratum, contrast)."""
    method = paired_bootstrap_pcg64 if pcg64 else paired_bootstrap
    summary = method(
        differences, [*stratum, "contrast"], study_seed(study),
        resamples=study.resamples, threshold=study.threshold,
    )
    return summary.drop("draw_seed").withColumn("bootstrap_seed", study_seed(study)).withColumn(
        "bootstrap_resamples", F.lit(study.resamples)
    )


def interpretation_counts(summary: DataFrame) -> DataFrame:
    """Contrast x label counts, with a zero where a label does not occur."""
    return (
        summary.groupBy("contrast")
        .pivot("interpretation", list(LABELS))
        .agg(F.count(F.lit(1)))
        .fillna(0, list(LABELS))
    )


def finding_counts(summary: DataFrame) -> DataFrame:
    return summary.groupBy("contrast").agg(
        F.count(F.lit(1)).alias("strata"),
        F.count_if(F.col("estimate") < 0).alias("negative_estimates"),
        F.count_if(F.col("ci_upper") < 0).alias("intervals_below_zero"),
    )


def accounting(
    replication: DataFrame,
    augmentation: DataFrame,
    baseline: DataFrame,
    grid: DataFrame,
    keys: Sequence[str] = ("key",),
    stratum: Sequence[str] = STRATUM,
) -> DataFrame:
    """Key, stratum and pair counts of the three arms as one row."""
    distinct = lambda rows, name: rows.agg(
        F.count_distinct(*keys).alias(name)
    )
    per_stratum = replication.groupBy(*stratum).agg(F.count_distinct("seed").alias("pairs"))
    return side_by_side(
        distinct(replication, "replication_keys"),
        distinct(augmentation, "gaussian_keys"),
        distinct(baseline, "baseline_source_keys"),
        distinct(restrict_to_grid(baseline, grid, keys), "baseline_matched_keys"),
        per_stratum.agg(
            F.count(F.lit(1)).alias("strata"),
            F.min("pairs").alias("paired_seeds_per_stratum"),
        ),
    )
