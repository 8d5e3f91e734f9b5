"""Quality gates. Each gate is a DataFrame of violations; none means pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.functions.digests import is_sha256
from pairwright.functions.keys import fraction_token, identity
from pairwright.functions.scores import interpret_interval, is_finite
from pairwright.operators.contrast import study_seed
from pairwright.study import TERMINAL_STATES, Study

# Metric names that may not appear in metric-blind documents.
PREDICTIVE_NAMES = (
    "roc_auc", "average_precision", "precision", "recall", "f1", "accuracy",
    "predictive_metric", "predictive_metrics", "probability_values",
)
# Words that may not be part of a column name of an analysis output.
FORBIDDEN_COLUMNS = ("p_value", "pvalue", "probability", "y_true", "test_index")


class GateError(ValueError):
    """A gate found violations."""


def require_empty(violations: DataFrame, label: str, shown: int = 20) -> None:
    """Raise with the first few violations, if there are any."""
    head = violations.limit(shown).collect()
    if head:
        found = "; ".join(str(row.asDict()) for row in head)
        raise GateError(f"{label}: {found}")


def coded(rows: DataFrame, subject: Sequence[str], tests: Mapping[str, Column]) -> DataFrame:
    """One row per failed test; a test is a condition that marks a violation."""
    codes = F.array(*[F.when(test, F.lit(code)) for code, test in tests.items()])
    return rows.select(
        *subject, F.explode(F.filter(codes, lambda code: code.isNotNull())).alias("code")
    )


def metric_range(rows: DataFrame, metric: str = "roc_auc", subject: str = "key") -> DataFrame:
    value = F.col(metric)
    finite = is_finite(value)
    return coded(
        rows,
        [subject],
        {
            "metric_not_finite": ~finite,
            "metric_out_of_range": finite & ~value.between(0.0, 1.0),
        },
    )


def identity_gate(rows: DataFrame, study: Study) -> DataFrame:
    """Keys and tokens that do not follow from the identity columns."""
    allowed = [
        (F.col("dataset") == dataset)
        & F.col("retained_fraction").cast("decimal(3,2)").isin(list(fractions))
        for dataset, fractions in study.levels.items()
    ]
    known_level = F.lit(False)
    for level in allowed:
        known_level = known_level | level
    return coded(
        rows,
        ["key"],
        {
            "unknown_dataset": ~F.col("dataset").isin(list(study.levels)),
            "unknown_model": ~F.col("model").isin(list(study.models)),
            "unsupported_fraction": F.col("dataset").isin(list(study.levels))
            & ~F.coalesce(known_level, F.lit(False)),
            "token_mismatch": ~F.col("retained_fraction_token").eqNullSafe(
                fraction_token(F.col("retained_fraction"))
            ),
            "key_mismatch": ~F.col("key").eqNullSafe(identity()),
        },
    )


def schema_gate(frame: DataFrame, contract: T.StructType, *, ordered: bool = False) -> list[str]:
    """Differences between a frame's fields and the contract; metadata only."""
    found = {f.name: f.dataType for f in frame.schema}
    wanted = {f.name: f.dataType for f in contract}
    problems = [f"missing field {name}" for name in wanted if name not in found]
    problems += [f"unexpected field {name}" for name in found if name not in wanted]
    problems += [
        f"type of {name}: expected {wanted[name].simpleString()}, "
        f"found {found[name].simpleString()}"
        for name in wanted
        if name in found and found[name] != wanted[name]
    ]
    if ordered and not problems and list(found) != list(wanted):
        problems.append("field order changed")
    return problems


def prediction_gate(
    predictions: DataFrame,
    keys: Sequence[str],
    expected: DataFrame | None = None,
) -> DataFrame:
    """Archive checks per key: ids unique and non-negative, labels binary,
    probabilities finite and in [0, 1], positions dense, no archive empty."""
    types = dict(predictions.dtypes)
    p = F.col("probability")
    finite = is_finite(p)
    # Two levels: ids are folded first, so a large archive is not one group.
    per_id = predictions.groupBy(*keys, "test_index").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("y_true").isNull() | ~F.col("y_true").isin(0, 1)).alias("nonbinary"),
        F.count_if(~finite).alias("nonfinite"),
        F.count_if(finite & ~p.between(0.0, 1.0)).alias("outside"),
        F.count_if(p.isNull() | F.col("y_true").isNull()).alias("gaps"),
        F.min("pos").alias("first"),
        F.max("pos").alias("last"),
    )
    summed = per_id.groupBy(*keys).agg(
        F.sum("n").alias("rows"),
        F.max("n").alias("repeats"),
        F.min("test_index").alias("lowest"),
        F.count_if(F.col("test_index").isNull()).alias("null_ids"),
        *[F.sum(c).alias(c) for c in ("nonbinary", "nonfinite", "outside", "gaps")],
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )
    integral = types["test_index"] in ("tinyint", "smallint", "int", "bigint")
    if expected is not None:
        summed = summed.join(distinct(expected, keys), list(keys), "right")
    return coded(
        summed,
        keys,
        {
            "empty_archive": F.col("rows").isNull(),
            "array_length_mismatch": (F.col("gaps") > 0) | (F.col("null_ids") > 0)
            | (F.col("first") != 0) | (F.col("last") + 1 != F.col("rows")),
            "probability_dtype_mismatch": F.lit(types["probability"] != "float"),
            "test_index_not_integer": F.lit(not integral),
            "negative_test_index": F.col("lowest") < 0,
            "duplicate_test_index": F.col("repeats") > 1,
            "nonbinary_y_true": F.col("nonbinary") > 0,
            "nonfinite_probability": F.col("nonfinite") > 0,
            "probability_out_of_range": F.col("outside") > 0,
        },
    )


def distinct(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.select(*keys).distinct()


def single_class_groups(
    predictions: DataFrame, keys: Sequence[str], label: str = "y_true"
) -> DataFrame:
    """Groups without both classes, for which AUC is not defined."""
    summed = predictions.groupBy(*keys).agg(
        F.count_if(F.col(label) == 1).alias("positives"),
        F.count_if(F.col(label) == 0).alias("negatives"),
    )
    return summed.filter("positives = 0 OR negatives = 0").select(
        *keys, "positives", "negatives", F.lit("single_class").alias("code")
    )


def ledger_gate(ledger: DataFrame, subject: Sequence[str] = ("key",)) -> DataFrame:
    """Checks of one terminal row: state, time stamps, artifact and error."""
    elapsed, stamp = F.col("elapsed_seconds"), F.col("completed_at")
    success = F.col("terminal_state") == "success"
    artifact, error = F.col("artifact"), F.col("error")
    stamped = F.try_to_timestamp(stamp).isNotNull()
    zoned = F.coalesce(stamp.rlike(r"(Z|[+-]\d\d:\d\d)$"), F.lit(False))
    known = F.coalesce(F.col("terminal_state").isin(list(TERMINAL_STATES)), F.lit(False))
    failed = F.col("terminal_state") == "failure"
    timed_out = F.col("terminal_state") == "timeout"
    sound = is_sha256(F.col("artifact.sha256")) & F.coalesce(
        (F.col("artifact.bytes") >= 0) & (F.length("artifact.path") > 0), F.lit(False)
    )
    failure_error = (
        F.coalesce(F.length("error.type") > 0, F.lit(False))
        & is_sha256(F.col("error.message_sha256"))
        & is_sha256(F.col("error.traceback_sha256"))
    )
    return coded(
        ledger,
        subject,
        {
            "state_unknown": ~known,
            "elapsed_invalid": ~is_finite(elapsed) | F.coalesce(elapsed < 0, F.lit(False)),
            "completed_at_invalid": ~stamped,
            "completed_at_without_zone": stamped & ~zoned,
            "artifact_mismatch": success & (artifact.isNull() | ~sound),
            "success_with_error": success & error.isNotNull(),
            "unsuccessful_with_artifact": known & ~success & artifact.isNotNull(),
            "failure_error_invalid": failed & ~failure_error,
            "timeout_error_invalid": timed_out
            & ~F.coalesce(F.col("error.reason") == "condition_timeout", F.lit(False)),
        },
    )


def manifest_entry_gate(entries: DataFrame, suffix: str = ".npz") -> DataFrame:
    """Unsafe paths, wrong suffix, bad sizes and digests, and repeated paths."""
    path = F.col("path")
    parts = F.split(path, "/")
    unsafe = (
        path.isNull()
        | (path == "")
        | path.startswith("/")
        | F.exists(parts, lambda part: part.isin("", ".", ".."))
        | ~path.endswith(suffix)
    )
    safe = ~F.coalesce(unsafe, F.lit(True))
    single = coded(
        entries,
        ["path"],
        {
            "unsafe_artifact_path": ~safe,
            "invalid_artifact_bytes": safe & (F.col("bytes").isNull() | (F.col("bytes") < 0)),
            "invalid_artifact_sha256": safe & ~is_sha256(F.col("sha256")),
        },
    )
    repeated = (
        entries.groupBy("path")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("path", F.lit("duplicate_artifact_path").alias("code"))
    )
    return single.unionByName(repeated)


def summary_gate(summary: DataFrame, study: Study, pairs: int | None = None) -> DataFrame:
    """Checks of the tidy summary: ranges, order of ends, derivable seed and label."""
    wanted = len(study.seeds) if pairs is None else pairs
    outside = F.lit(False)
    for name in ("estimate", "ci_lower", "ci_upper"):
        outside = outside | ~is_finite(F.col(name)) | (F.abs(F.col(name)) > 1)
    return coded(
        summary,
        ["dataset", "retained_fraction_token", "model", "contrast"],
        {
            "value_out_of_range": outside,
            "endpoints_reversed": F.col("ci_lower") > F.col("ci_upper"),
            "seed_not_derivable": F.col("bootstrap_seed") != study_seed(study),
            "label_not_derivable": F.col("interpretation")
            != interpret_interval(F.col("ci_lower"), F.col("ci_upper"), study.threshold),
            "pair_count_changed": F.col("pairs") != wanted,
            "resamples_changed": F.col("bootstrap_resamples") != study.resamples,
        },
    )


def strata_gate(summary: DataFrame, strata: DataFrame, study: Study) -> DataFrame:
    """Declared strata and contrasts that the summary lacks, repeats or adds."""
    from pairwright.operators.reconcile import reconcile_keys

    names = F.array(*[F.lit(c.name) for c in study.contrasts])
    keys = ["dataset", "retained_fraction_token", "model", "contrast"]
    expected = strata.withColumn("contrast", F.explode(names))
    return (
        reconcile_keys(expected, summary, keys)
        .filter("status != 'ok'")
        .select(*keys, F.col("status").alias("code"))
    )


def forbidden_columns(
    schema: T.StructType, words: Sequence[str] = FORBIDDEN_COLUMNS, prefix: str = ""
) -> list[str]:
    """Dotted names of fields, at any depth, that contain a forbidden word."""
    found: list[str] = []

    def walk(kind: T.DataType, path: str) -> None:
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                name = f"{path}.{field.name}" if path else field.name
                if any(word in field.name.lower() for word in words):
                    found.append(name)
                walk(field.dataType, name)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, path)
        elif isinstance(kind, T.MapType):
            walk(kind.valueType, path)

    walk(schema, prefix)
    return found


def metric_blind(
    rows: DataFrame, subject: Sequence[str], words: Sequence[str] = PREDICTIVE_NAMES
) -> DataFrame:
    """Rows with a string value, at any depth, that contains a metric name.

    Whole values that are SHA-256 digests are exempt, and so are field names.
    """
    names = {name for name in subject}
    hits: list[Column] = []

    def bad(text: Column) -> Column:
        return F.coalesce(
            ~text.rlike("^[0-9a-f]{64}$") & F.lower(text).rlike("|".join(words)), F.lit(False)
        )

    def test(kind: T.DataType, value: Column) -> Column | None:
        if isinstance(kind, T.StringType):
            return bad(value)
        if isinstance(kind, T.StructType):
            inner = [test(f.dataType, value[f.name]) for f in kind.fields]
            inner = [item for item in inner if item is not None]
            return _any(inner) if inner else None
        if isinstance(kind, T.ArrayType):
            probe = test(kind.elementType, F.lit(None).cast(kind.elementType))
            if probe is None:
                return None
            return F.coalesce(
                F.exists(value, lambda item: test(kind.elementType, item)), F.lit(False)
            )
        if isinstance(kind, T.MapType):
            return test(T.ArrayType(kind.valueType), F.map_values(value))
        return None

    def _any(tests: list[Column]) -> Column:
        joined = tests[0]
        for item in tests[1:]:
            joined = joined | item
        return joined

    for field in rows.schema.fields:
        if field.name not in names:
            hit = test(field.dataType, F.col(field.name))
            if hit is not None:
                hits.append(hit)
    if not hits:
        return rows.select(*subject, F.lit("forbidden_name").alias("code")).limit(0)
    return rows.filter(_any(hits)).select(*subject, F.lit("forbidden_name").alias("code"))
