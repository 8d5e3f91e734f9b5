"""Run ledger: what ran, what is pending, and whether the artifacts agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.operators.ordering import ordered_digest
from pairwright.operators.reconcile import is_subset, reconcile_keys
from pairwright.operators.sampling import class_counts


def ledger_row(
    terminal_state: Column,
    elapsed_seconds: Column,
    completed_at: Column,
    *,
    artifact: tuple[Column, Column, Column] | None = None,
    error: tuple[Column, Column, Column] | None = None,
    warnings: Column | None = None,
    rss_bytes: Column | None = None,
) -> list[Column]:
    """The nested columns of a terminal row.

    A success keeps only the artifact, a failure only its error, a timeout only its
    reason.
    """
    success = terminal_state == "success"
    failure = terminal_state == "failure"
    path, size, digest = artifact or (F.lit(None).cast("string"),) * 3
    kind, message, trace = error or (F.lit(None).cast("string"),) * 3
    nothing = F.lit(None).cast("string")
    return [
        terminal_state.alias("terminal_state"),
        elapsed_seconds.cast("double").alias("elapsed_seconds"),
        completed_at.cast("string").alias("completed_at"),
        F.when(
            success,
            F.struct(
                path.alias("path"), size.cast("long").alias("bytes"), digest.alias("sha256")
            ),
        ).alias("artifact"),
        F.when(
            success,
            F.struct(
                (F.array().cast("array<string>") if warnings is None else warnings).alias(
                    "warnings"
                ),
                (F.lit(0) if rss_bytes is None else rss_bytes).cast("long").alias("rss_bytes"),
            ),
        ).alias("metadata"),
        F.when(
            ~success,
            F.struct(
                F.when(failure, kind).otherwise(nothing).alias("type"),
                F.when(failure, message).otherwise(nothing).alias("message_sha256"),
                F.when(failure, trace).otherwise(nothing).alias("traceback_sha256"),
                F.when(~failure, F.lit("condition_timeout")).otherwise(nothing).alias("reason"),
            ),
        ).alias("error"),
    ]


def pending_conditions(
    expected: DataFrame, ledger: DataFrame, keys: Sequence[str] = ("key",)
) -> DataFrame:
    """Expected conditions without a valid terminal row: what a resumed run still does."""
    done = ledger.select(*keys).distinct()
    return expected.join(done, list(keys), "left_anti")


def classify_origin(
    expected: DataFrame,
    reused: DataFrame,
    earlier: DataFrame,
    keys: Sequence[str] = ("key",),
) -> DataFrame:
    """reused: taken over from an accepted run; resumed: already terminal here."""
    mark = lambda rows, name: rows.select(*keys).distinct().withColumn(name, F.lit(True))
    return (
        expected.join(mark(reused, "_reused"), list(keys), "left")
        .join(mark(earlier, "_resumed"), list(keys), "left")
        .withColumn(
            "origin",
            F.when(F.col("_reused"), "reused")
            .when(F.col("_resumed"), "resumed")
            .otherwise("executed"),
        )
        .drop("_reused", "_resumed")
    )


def run_report(
    ledger: DataFrame,
    run: Sequence[str],
    expected_count: int,
    *,
    ordinal: str = "ordinal",
    key_lists: bool = True,
) -> DataFrame:
    """One report row per run: states, times, resources, outputs and the pass flag.

    Rows are folded per key and state first, so the two key lists, in grid order, hold
    at most the conditions of the grid even if a run repeats its rows.
    """
    state = F.col("terminal_state")
    success = state == "success"
    zero = F.lit(0)
    per_key = ledger.groupBy(*run, ordinal, "key", "terminal_state").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum("elapsed_seconds").alias("_sum"),
        F.max("elapsed_seconds").alias("_max"),
        F.max("metadata.rss_bytes").alias("_rss"),
        F.sum(F.size("metadata.warnings")).alias("_warnings"),
        F.count("artifact").alias("_artifacts"),
        F.sum("artifact.bytes").alias("_bytes"),
    )

    def rows_in(test: Column | None = None) -> Column:
        kept = F.col("_rows") if test is None else F.when(test, F.col("_rows")).otherwise(zero)
        return F.sum(kept)

    def keys_in(name: str) -> Column:
        items = F.collect_list(F.when(state == name, F.struct(F.col(ordinal), F.col("key"))))
        return F.sort_array(items)["key"].alias(f"{name}_keys")

    lists = [keys_in("failure"), keys_in("timeout")] if key_lists else []
    return (
        per_key.groupBy(*run)
        .agg(
            rows_in().alias("terminal_key_count"),
            rows_in(success).alias("successful_key_count"),
            rows_in(state == "failure").alias("failure_key_count"),
            rows_in(state == "timeout").alias("timeout_key_count"),
            F.sum("_sum").alias("summed_condition_seconds"),
            F.max("_max").alias("maximum_condition_seconds"),
            F.coalesce(F.max("_rss"), zero).alias("maximum_observed_rss_bytes"),
            F.coalesce(F.sum("_warnings"), zero).alias("warning_count"),
            (rows_in() + F.sum("_artifacts")).alias("condition_output_file_count"),
            F.coalesce(F.sum("_bytes"), zero).alias("condition_output_bytes"),
            *lists,
        )
        .withColumn("expected_key_count", F.lit(expected_count))
        .withColumn(
            "status",
            F.when(
                (F.col("terminal_key_count") == expected_count)
                & (F.col("successful_key_count") == expected_count),
                "pass",
            ).otherwise("fail"),
        )
    )


def report_violations(
    report: DataFrame, ledger: DataFrame, run: Sequence[str], expected_count: int
) -> DataFrame:
    """Reported counts, lists and flag against what the ledger implies."""
    implied = run_report(ledger, run, expected_count)
    compared = [
        "terminal_key_count", "successful_key_count", "failure_key_count", "timeout_key_count",
        "maximum_condition_seconds", "maximum_observed_rss_bytes", "warning_count",
        "condition_output_file_count", "condition_output_bytes", "status",
        "failure_keys", "timeout_keys",
    ]
    both = report.select(*run, *[F.col(c).alias(f"r_{c}") for c in compared]).join(
        implied.select(*run, *[F.col(c).alias(f"i_{c}") for c in compared],
                       F.lit(True).alias("_known")),
        list(run),
        "full_outer",
    )
    codes = [
        F.when(F.col("_known").isNull(), F.lit("run_unknown")),
        *[
            F.when(
                F.col("_known") & ~F.col(f"r_{c}").eqNullSafe(F.col(f"i_{c}")), F.lit(f"{c}_changed")
            )
            for c in compared
        ],
    ]
    return both.select(
        *run, F.explode(F.filter(F.array(*codes), lambda c: c.isNotNull())).alias("code")
    )


def origin_violations(
    origins: DataFrame, expected: DataFrame, keys: Sequence[str] = ("key",)
) -> DataFrame:
    """executed, resumed and reused must cover the expected keys once each."""
    from pairwright.operators.reconcile import disjoint_cover

    return disjoint_cover(origins, expected, keys)


def eligible_reuse(
    earlier: DataFrame,
    earlier_grid: DataFrame,
    full_grid: DataFrame,
    reconciliation: DataFrame,
    keys: Sequence[str] = ("key",),
) -> bool:
    """An earlier run may be reused if it is complete, successful, clean and a strict
    part of the full grid."""
    complete = (
        reconcile_keys(earlier_grid, earlier, keys).filter("status != 'ok'").isEmpty()
        and earlier.filter("terminal_state != 'success'").isEmpty()
    )
    part = is_subset(earlier_grid, full_grid, keys) and not is_subset(full_grid, earlier_grid, keys)
    return complete and part and reconciliation.isEmpty()


def reuse_by_run(
    ledger: DataFrame, run: Sequence[str], grid: DataFrame, key: str = "key"
) -> DataFrame:
    """Eligibility of many earlier runs at once, one row per run."""
    known = grid.select(F.col(key), F.lit(True).alias("_known"))
    per_key = ledger.groupBy(*run, key).agg(
        F.count(F.lit(1)).alias("n"),
        F.every(F.col("terminal_state") == "success").alias("all_success"),
    )
    return (
        per_key.join(known, key, "left")
        .groupBy(*run)
        .agg(
            F.count(F.lit(1)).alias("keys"),
            F.every("all_success").alias("all_success"),
            F.every(F.col("n") == 1).alias("unique_keys"),
            F.every(F.col("_known").isNotNull()).alias("inside_grid"),
        )
        .withColumn("eligible", F.col("all_success") & F.col("unique_keys") & F.col("inside_grid"))
    )


def reconcile_artifacts(
    expected: DataFrame,
    ledger: DataFrame,
    predictions: DataFrame,
    keys: Sequence[str] = ("key",),
) -> DataFrame:
    """(key, code) rows for the three key sets: grid, ledger and prediction inventory.

    ``predictions`` has the inventory columns ``bytes`` and ``sha256``.
    """
    grid = expected.select(*keys, F.lit(True).alias("_grid"))
    rows = ledger.select(
        *keys,
        F.lit(True).alias("_row"),
        (F.col("terminal_state") == "success").alias("_success"),
        F.col("artifact.bytes").alias("_bytes"),
        F.col("artifact.sha256").alias("_sha"),
    )
    files = predictions.select(
        *keys, F.lit(True).alias("_file"), F.col("bytes").alias("_f_bytes"),
        F.col("sha256").alias("_f_sha"),
    )
    joined = grid.join(rows, list(keys), "full_outer").join(files, list(keys), "full_outer")
    success = F.coalesce(F.col("_success"), F.lit(False))
    codes = F.array(
        F.when(F.col("_row").isNotNull() & F.col("_grid").isNull(),
               "unexpected_checkpoint_artifacts"),
        F.when(F.col("_grid").isNotNull() & F.col("_row").isNull(),
               "missing_checkpoint_artifacts"),
        F.when(F.col("_file").isNotNull() & ~(success & F.col("_grid").isNotNull()),
               "unexpected_prediction_artifacts"),
        F.when(success & F.col("_file").isNull(), "missing_prediction_artifacts"),
        F.when(F.col("_file").isNotNull() & ~success, "orphan_prediction_artifacts"),
        F.when(
            success & F.col("_file").isNotNull()
            & ((F.col("_bytes") != F.col("_f_bytes")) | (F.col("_sha") != F.col("_f_sha"))),
            "mismatched_artifacts",
        ),
    )
    return joined.select(
        *keys, F.explode(F.filter(codes, lambda code: code.isNotNull())).alias("code")
    )


def analysis_gate(
    report: DataFrame, reconciliation: DataFrame, run: Sequence[str], expected_count: int
) -> DataFrame:
    """Whether the analysis may start: all conditions successful and nothing to reconcile."""
    dirty = reconciliation.groupBy(*run).agg(F.count(F.lit(1)).alias("findings"))
    return (
        report.join(dirty, list(run), "left")
        .fillna(0, ["findings"])
        .select(
            *run,
            "terminal_key_count",
            "successful_key_count",
            "findings",
            (
                (F.col("terminal_key_count") == expected_count)
                & (F.col("successful_key_count") == expected_count)
                & (F.col("findings") == 0)
            ).alias("may_start"),
        )
    )


def condition_profile(
    subsets: DataFrame,
    group: Sequence[str],
    *,
    pos: str = "pos",
    row_id: str = "row_id",
    label: str = "target",
) -> DataFrame:
    """Retained size, class counts and ordered-id digest per condition."""
    counts = (
        class_counts(subsets, group, label)
        .groupBy(*group)
        .agg(
            F.sum("n").alias("retained_size"),
            F.sum(F.when(F.col(label) == 0, F.col("n")).otherwise(0)).alias("retained_negative"),
            F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)).alias("retained_positive"),
        )
    )
    return counts.join(
        ordered_digest(subsets, group, pos, retained_ids_sha256=F.col(row_id)), list(group)
    )


def dataset_profile(rows: DataFrame, dataset: str) -> DataFrame:
    columns = [c for c in rows.columns]
    return rows.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(dataset).alias("dataset"), "row_count", F.lit(len(columns)).alias("column_count")
    )
