"""Key, prediction and manifest reconciliation as ordinary DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.operators.metrics import METRICS, evaluate, usable
from pairwright.operators.ordering import (
    ordered_digest,
    range_bucket,
    ranked,
    settle,
    splitters,
)


def distinct_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.select(*keys).distinct()


def missing_keys(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return distinct_keys(expected, keys).join(distinct_keys(observed, keys), list(keys), "left_anti")


def unexpected_keys(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return missing_keys(observed, expected, keys)


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).subtract(right.select(*keys))


def key_intersection(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).intersect(right.select(*keys))


def is_subset(small: DataFrame, large: DataFrame, keys: Sequence[str]) -> bool:
    return missing_keys(small, large, keys).isEmpty()


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def reconcile_keys(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key with its counts on both sides and a ``status``.

    Both sides are folded to one row per key before they meet.
    """
    counted = lambda rows, name: rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(name)
    )
    return (
        counted(expected, "n_expected")
        .join(counted(observed, "n_observed"), list(keys), "full_outer")
        .fillna(0, ["n_expected", "n_observed"])
        .withColumn(
            "status",
            F.when(F.col("n_observed") == 0, "missing")
            .when(F.col("n_expected") == 0, "unexpected")
            .when(F.col("n_observed") > F.col("n_expected"), "duplicate")
            .when(F.col("n_observed") < F.col("n_expected"), "too_few")
            .otherwise("ok"),
        )
    )


def reconciliation_report(reconciled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    status = F.col("status")
    return reconciled.groupBy(*by).agg(
        F.sum("n_expected").alias("expected_rows"),
        F.sum("n_observed").alias("observed_rows"),
        *[
            F.count_if(status == name).alias(f"{name}_keys")
            for name in ("missing", "unexpected", "duplicate")
        ],
        F.every(status == "ok").alias("clean"),
    )


def disjoint_cover(lists: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that several of the lists share, or that the lists leave out or add.

    ``lists`` is the union of the key lists, one row per entry.
    """
    return (
        reconcile_keys(expected, lists, keys)
        .filter("status != 'ok'")
        .select(
            *keys,
            F.when(F.col("status") == "duplicate", "in_several_lists")
            .when(F.col("status") == "missing", "in_no_list")
            .otherwise("not_expected")
            .alias("code"),
        )
    )


def _aligned(
    reference: DataFrame, candidate: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    side = lambda rows, mark: rows.select(
        *keys, "pos", F.lit(True).alias(f"{mark}_there"),
        *[F.col(c).alias(f"{mark}_{c}") for c in columns],
    )
    return side(reference, "r").join(side(candidate, "c"), [*keys, "pos"], "full_outer")


def _same(column: str) -> Column:
    return F.col(f"r_{column}").eqNullSafe(F.col(f"c_{column}"))


def compare_split_identity(
    reference: DataFrame, candidate: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Whether stored test ids and labels equal the regenerated ones, per key."""
    return (
        _aligned(reference, candidate, keys, ["test_index", "y_true"])
        .groupBy(*keys)
        .agg(
            F.every(_same("test_index")).alias("test_index_exact"),
            F.every(_same("y_true")).alias("y_true_exact"),
        )
        .withColumn(
            "status",
            F.when(F.col("test_index_exact") & F.col("y_true_exact"), "pass").otherwise("fail"),
        )
    )


def compare_predictions(
    reference: DataFrame,
    candidate: DataFrame,
    keys: Sequence[str],
    *,
    probability_atol: float = 1e-6,
    metric_atol: float = 1e-12,
) -> DataFrame:
    """Compare two prediction sets position by position, per key.

    A position on one side only makes the shape differ, which fails every check that
    needs aligned values. Metric values stay inside; only differences come out.
    """
    r, c = F.col("r_probability"), F.col("c_probability")
    gap = F.abs(r - c)
    float32 = dict(candidate.dtypes)["probability"] == "float"
    both_there = F.col("r_there").isNotNull() & F.col("c_there").isNotNull()
    finite = lambda p: F.coalesce(
        ~F.isnan(p) & (F.abs(p) < F.lit(float("inf"))), F.lit(False)
    )
    binary = lambda y: F.coalesce(y.isin(0, 1), F.lit(False))
    there = lambda side, test: F.every(
        F.when(F.col(f"{side}_there"), test).otherwise(True)
    )
    rows = (
        _aligned(reference, candidate, keys, ["test_index", "y_true", "probability"])
        .groupBy(*keys)
        .agg(
            F.every(_same("test_index")).alias("test_index_exact"),
            F.every(_same("y_true")).alias("y_true_exact"),
            F.every(both_there).alias("probability_shape_exact"),
            there("c", finite(c) & c.between(0.0, 1.0)).alias("probability_finite_and_bounded"),
            (there("r", finite(r)) & there("c", finite(c))).alias("_finite"),
            (there("r", binary(F.col("r_y_true"))) & there("c", binary(F.col("c_y_true")))).alias(
                "_binary"
            ),
            F.max(gap).alias("_gap"),
            F.every((r >= 0.5) == (c >= 0.5)).alias("_same_side"),
        )
        .withColumn("_ready", F.col("probability_shape_exact") & F.col("_finite"))
    )
    measured = F.col("_ready") & F.col("probability_finite_and_bounded") & F.col("_binary")
    rows = settle(rows)
    # one bad row must not stop the report: only archives with usable rows alone are measured
    sound = rows.filter(measured).select(*keys)
    left, right = (
        evaluate(side.join(sound, list(keys), "left_semi"), keys).select(
            *keys, *[F.col(m).alias(f"{mark}_{m}") for m in METRICS]
        )
        for side, mark in ((reference, "l"), (candidate, "k"))
    )
    metrics = left.join(right, list(keys))
    difference = lambda m: F.when(
        measured, F.abs(F.col(f"l_{m}") - F.col(f"k_{m}"))
    )
    limit = lambda m: metric_atol if m in ("roc_auc", "average_precision") else 0.0
    checks = [
        "test_index_exact", "y_true_exact", "probability_shape_exact",
        "probability_dtype_float32", "probability_finite_and_bounded",
        "probability_within_tolerance", "thresholded_prediction_exact",
        *[f"metric_{m}_within_tolerance" for m in METRICS],
    ]
    passed = F.lit(True)
    for check in checks:
        passed = passed & F.col(check)
    return (
        rows.join(metrics, list(keys), "left")
        .select(
            *keys,
            "test_index_exact",
            "y_true_exact",
            "probability_shape_exact",
            F.lit(float32).alias("probability_dtype_float32"),
            "probability_finite_and_bounded",
            (F.col("_ready") & (F.col("_gap").cast("double") <= probability_atol)).alias(
                "probability_within_tolerance"
            ),
            (F.col("_ready") & F.col("_same_side")).alias("thresholded_prediction_exact"),
            F.when(F.col("_ready"), F.col("_gap")).alias("maximum_probability_difference"),
            *[difference(m).alias(f"difference_{m}") for m in METRICS],
            *[
                F.coalesce(difference(m) <= limit(m), F.lit(False)).alias(
                    f"metric_{m}_within_tolerance"
                )
                for m in METRICS
            ],
        )
        .withColumn("status", F.when(passed, "pass").otherwise("fail"))
    )


def manifest_vs_files(
    declared: DataFrame, actual: DataFrame, keys: Sequence[str] = ("path",)
) -> DataFrame:
    """Violations between a manifest and the files found: (path, code, detail)."""
    d = declared.select(*keys, F.col("bytes").alias("d_bytes"), F.col("sha256").alias("d_sha"))
    a = actual.select(*keys, F.col("bytes").alias("a_bytes"), F.col("sha256").alias("a_sha"))
    found = F.array(
        F.when(
            F.col("a_bytes").isNull(),
            F.struct(F.lit("artifact_missing").alias("code"), F.lit("").alias("detail")),
        ),
        F.when(
            F.col("d_bytes").isNull(),
            F.struct(F.lit("unexpected_artifact").alias("code"), F.lit("").alias("detail")),
        ),
        F.when(
            F.col("d_bytes") != F.col("a_bytes"),
            F.struct(
                F.lit("artifact_size_mismatch").alias("code"),
                F.format_string("expected %d, found %d", "d_bytes", "a_bytes").alias("detail"),
            ),
        ),
        F.when(
            F.col("d_sha") != F.col("a_sha"),
            F.struct(
                F.lit("artifact_hash_mismatch").alias("code"),
                F.format_string("expected %s, found %s", "d_sha", "a_sha").alias("detail"),
            ),
        ),
    )
    return d.join(a, list(keys), "full_outer").select(
        *keys, F.inline(F.filter(found, lambda item: item.isNotNull()))
    )


def manifest_totals(
    entries: DataFrame, declared_count: Column, declared_bytes: Column
) -> DataFrame:
    """Declared totals against the listed entries, as violations."""
    listed = entries.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"),
        F.max(declared_count).alias("dn"), F.max(declared_bytes).alias("db"),
    )
    return listed.select(
        F.inline(
            F.filter(
                F.array(
                    F.when(
                        F.col("n") != F.col("dn"),
                        F.struct(
                            F.lit("artifact_count_mismatch").alias("code"),
                            F.format_string("declared %d, listed %d", "dn", "n").alias("detail"),
                        ),
                    ),
                    F.when(
                        F.col("b") != F.col("db"),
                        F.struct(
                            F.lit("artifact_bytes_mismatch").alias("code"),
                            F.format_string("declared %d, listed %d", "db", "b").alias("detail"),
                        ),
                    ),
                ),
                lambda item: item.isNotNull(),
            )
        )
    )


def reuse_identity(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Artifacts taken over from an earlier run, and whether the bytes are the same."""
    s = source.select(*keys, F.col("bytes").alias("s_bytes"), F.col("sha256").alias("s_sha"))
    t = target.select(*keys, F.col("bytes").alias("t_bytes"), F.col("sha256").alias("t_sha"))
    return s.join(t, list(keys), "left").select(
        *keys,
        F.col("t_bytes").isNotNull().alias("present"),
        F.coalesce(
            (F.col("s_bytes") == F.col("t_bytes")) & (F.col("s_sha") == F.col("t_sha")),
            F.lit(False),
        ).alias("byte_identical"),
    )


def package_digest(inventory: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """File count, bytes and SHA-256 over the sorted ``path, bytes, digest`` lines.

    Paths are ranked inside ranges cut by a fixed sample, so a long inventory is not
    sorted in one task.
    """
    lines = inventory.select(
        *group, "path", "bytes",
        F.concat_ws("\t", "path", F.col("bytes").cast("string"), "sha256").alias("_line"),
    )
    bucket = range_bucket(F.col("path"), splitters(lines, "path"))
    whole = [*group] or ["_all"]
    if not group:
        lines = lines.withColumn("_all", F.lit(0))
    placed = ranked(lines, whole, bucket, ["path"], "_pos")
    digest = ordered_digest(
        placed, whole, "_pos", glue="\n", identity_sha256=F.col("_line")
    )
    totals = lines.groupBy(*whole).agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("bytes").alias("bytes")
    )
    joined = totals.join(digest, whole)
    return joined if group else joined.drop("_all")


def unusable_probabilities(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    return predictions.groupBy(*keys).agg(
        F.count_if(~usable(F.col("probability"))).alias("unusable")
    ).filter("unusable > 0")
