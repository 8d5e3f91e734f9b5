from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.operators import gates, ledger, reconcile
from pairwright.operators.grid import condition_grid
from pairwright.plans.replay import replay_report, verify_inputs
from pairwright.study import EDGE_SEEDS, PILOT_LEVELS, Study, pilot_study, scarcity_study

PRED = "key STRING, pos LONG, test_index LONG, y_true TINYINT, probability FLOAT"
TOY = [("k", 0, 4, 0, 0.1), ("k", 1, 7, 1, 0.8), ("k", 2, 9, 0, 0.3), ("k", 3, 12, 1, 0.7)]


def predictions(spark, data=TOY, schema=PRED):
    return spark.createDataFrame(data, schema)


def edit(at, column, value):
    names = ["key", "pos", "test_index", "y_true", "probability"]
    return [tuple(value if i == at and n == column else v for n, v in zip(names, row))
            for i, row in enumerate(TOY)]


@pytest.mark.parametrize(
    "data, code",
    [
        (edit(0, "test_index", 7), "duplicate_test_index"),
        (edit(0, "test_index", -4), "negative_test_index"),
        (edit(0, "y_true", 2), "nonbinary_y_true"),
        (edit(0, "probability", float("nan")), "nonfinite_probability"),
        (edit(0, "probability", 1.5), "probability_out_of_range"),
        (TOY[1:], "array_length_mismatch"),
    ],
)
def test_prediction_mutations_give_one_code(spark, data, code):
    assert gates.prediction_gate(predictions(spark), ["key"]).isEmpty()
    assert rows(gates.prediction_gate(predictions(spark, data), ["key"]), "code") == [(code,)]


def test_prediction_types_and_absent_archives(spark):
    wide = predictions(spark, schema=PRED.replace("FLOAT", "DOUBLE"))
    assert rows(gates.prediction_gate(wide, ["key"]), "code") == [("probability_dtype_mismatch",)]
    expected = spark.createDataFrame([("k",), ("other",)], "key STRING")
    assert rows(gates.prediction_gate(predictions(spark), ["key"], expected), "key", "code") == [
        ("other", "empty_archive")]
    one = predictions(spark, [r for r in TOY if r[3] == 1])
    assert rows(gates.single_class_groups(one, ["key"]), "positives", "negatives") == [(2, 0)]


def test_comparison_of_the_toy(spark):
    base = predictions(spark)
    same = reconcile.compare_predictions(base, base, ["key"]).first()
    assert same["status"] == "pass" and same["maximum_probability_difference"] == 0
    close = predictions(spark, edit(0, "probability", 0.1 + 5e-7))
    assert reconcile.compare_predictions(base, close, ["key"]).first()["status"] == "pass"
    moved = reconcile.compare_predictions(base, predictions(spark, edit(0, "probability", 0.1 + 2e-6)), ["key"]).first()
    assert (moved["status"], moved["probability_within_tolerance"], moved["thresholded_prediction_exact"]) == ("fail", False, True)
    broken = reconcile.compare_predictions(base, predictions(spark, edit(1, "probability", float("nan"))), ["key"]).first()
    assert broken["maximum_probability_difference"] is None
    assert not broken["probability_finite_and_bounded"] and not broken["metric_roc_auc_within_tolerance"]
    short = reconcile.compare_predictions(base, predictions(spark, TOY[:3]), ["key"]).first()
    assert not short["probability_shape_exact"] and not short["test_index_exact"]
    flipped = predictions(spark, edit(1, "y_true", 0))
    assert not reconcile.compare_predictions(base, flipped, ["key"]).first()["y_true_exact"]
    assert reconcile.compare_split_identity(base, flipped, ["key"]).first()["status"] == "fail"
    with pytest.raises(gates.GateError):
        verify_inputs(predictions(spark, edit(0, "y_true", 2)), base)
    assert verify_inputs(base, base).first()["status"] == "pass"


def test_metric_and_identity_gates(spark):
    grid = condition_grid(spark, pilot_study()).withColumn("roc_auc", F.lit(0.5))
    assert gates.metric_range(grid).isEmpty() and gates.identity_gate(grid, pilot_study()).isEmpty()
    first = F.col("ordinal") == 0
    put = lambda c, v: grid.withColumn(c, F.when(first, v).otherwise(F.col(c)))
    code = lambda f: {r["code"] for r in gates.identity_gate(f, pilot_study()).collect()}
    assert code(put("key", F.lit("x"))) == {"key_mismatch"}
    assert code(put("retained_fraction_token", F.lit("050pct"))) == {"token_mismatch"}
    assert code(put("model", F.lit("svm"))) == {"unknown_model", "key_mismatch"}
    assert code(put("dataset", F.lit("iris"))) == {"unknown_dataset", "key_mismatch"}
    ranged = lambda v: {r["code"] for r in gates.metric_range(put("roc_auc", v)).collect()}
    assert ranged(F.lit(1.01)) == {"metric_out_of_range"}
    assert ranged(F.lit(float("inf"))) == {"metric_not_finite"}
    assert ranged(F.lit(None).cast("double")) == {"metric_not_finite"}


def test_schema_gate_and_forbidden_columns():
    contract = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])

    class Frame:
        schema = T.StructType([T.StructField("b", T.StringType()), T.StructField("a", T.IntegerType())])

    assert gates.schema_gate(Frame, contract) == ["type of a: expected bigint, found int"]
    nested = T.StructType([T.StructField("ok", T.ArrayType(T.StructType([T.StructField("Y_TRUE", T.LongType())])))])
    assert gates.forbidden_columns(nested) == ["ok.Y_TRUE"]
    assert gates.forbidden_columns(contract) == []


def test_metric_blind(spark):
    data = [(1, "all fine", ["a" * 64]), (2, "The ROC_AUC is", ["x"]), (3, "fine", ["Recall"]), (4, None, None)]
    frame = spark.createDataFrame(data, "id INT, note STRING, list ARRAY<STRING>")
    assert rows(gates.metric_blind(frame, ["id"]), "id") == [(2,), (3,)]


def test_manifest_mutations(spark):
    good = [("d/a.npz", 5, "a" * 64)]
    frame = lambda data: spark.createDataFrame(data, "path STRING, bytes LONG, sha256 STRING")
    entry = lambda data: rows(gates.manifest_entry_gate(frame(data)), "code")
    assert entry(good) == []
    for path in ("/a.npz", "../a.npz", "d/./a.npz", "d//a.npz", "a.txt", ""):
        assert entry([(path, 5, "a" * 64)]) == [("unsafe_artifact_path",)]
    assert entry([("a.npz", -1, "a" * 64)]) == [("invalid_artifact_bytes",)]
    assert entry([("a.npz", 1, "A" * 64)]) == [("invalid_artifact_sha256",)]
    assert entry(good + good) == [("duplicate_artifact_path",)]
    pair = lambda actual: rows(reconcile.manifest_vs_files(frame(good), frame(actual)), "code")
    assert pair(good) == []
    assert pair([("d/a.npz", 6, "a" * 64)]) == [("artifact_size_mismatch",)]
    assert pair([("d/a.npz", 5, "b" * 64)]) == [("artifact_hash_mismatch",)]
    assert pair([("d/b.npz", 5, "a" * 64)]) == [("artifact_missing",), ("unexpected_artifact",)]


def run(spark, study, states=None):
    grid = condition_grid(spark, study)
    state = F.lit("success") if states is None else F.coalesce(
        F.create_map(*[F.lit(v) for pair in states.items() for v in pair])[F.col("ordinal").cast("int")],
        F.lit("success"))
    digest = F.sha2("key", 256)
    return grid.select("ordinal", "key", *ledger.ledger_row(
        state, F.lit(2.0), F.lit("2024-01-01T00:00:00+00:00"),
        artifact=(F.concat("key", F.lit(".npz")), F.lit(10), digest), error=(F.lit("E"), digest, digest)))


@pytest.mark.parametrize(
    "column, value, code",
    [
        ("terminal_state", lambda: F.lit("running"), "state_unknown"),
        ("elapsed_seconds", lambda: F.lit(-1.0), "elapsed_invalid"),
        ("completed_at", lambda: F.lit("yesterday"), "completed_at_invalid"),
        ("completed_at", lambda: F.lit("2024-01-01T00:00:00"), "completed_at_without_zone"),
        ("artifact", lambda: F.lit(None), "artifact_mismatch"),
        ("error", lambda: F.struct(*[F.lit("").alias(name) for name in (
            "type", "message_sha256", "traceback_sha256", "reason")]), "success_with_error"),
    ],
)
def test_ledger_mutations(spark, column, value, code):
    good = run(spark, pilot_study(), {3: "failure", 4: "timeout"})
    assert gates.ledger_gate(good).isEmpty()
    first = good.filter("ordinal = 0")
    changed = first.withColumn(column, value().cast(first.schema[column].dataType))
    found = {r["code"] for r in gates.ledger_gate(changed).collect()}
    assert code in found and (len(found) == 1 or column == "terminal_state")
    failure = good.filter("ordinal = 3").withColumn("error", F.col("error").withField("type", F.lit("")))
    assert rows(gates.ledger_gate(failure), "code") == [("failure_error_invalid",)]
    late = good.filter("ordinal = 4").withColumn("error", F.col("error").withField("reason", F.lit("x")))
    assert rows(gates.ledger_gate(late), "code") == [("timeout_error_invalid",)]


def test_run_accounting(spark):
    pilot, full = pilot_study(), scarcity_study()
    grid, whole = condition_grid(spark, pilot), condition_grid(spark, full)
    good = run(spark, pilot).withColumn("run", F.lit("a"))
    report = ledger.run_report(good, ["run"], 12)
    row = report.first()
    assert (row["status"], row["successful_key_count"], row["condition_output_bytes"]) == ("pass", 12, 120)
    assert ledger.report_violations(report, good, ["run"], 12).isEmpty()
    nothing = grid.select("key").limit(0)
    assert ledger.eligible_reuse(good, grid, whole, nothing)
    assert not ledger.eligible_reuse(good.filter("ordinal > 0"), grid, whole, nothing)
    assert not ledger.eligible_reuse(run(spark, pilot, {1: "failure"}), grid, whole, nothing)
    assert not ledger.eligible_reuse(good, grid, grid, nothing)
    assert not ledger.eligible_reuse(good, grid, whole, grid.select("key"))
    assert ledger.pending_conditions(whole, good).count() == 528
    origins = ledger.classify_origin(whole.select("key"), good, run(spark, full).filter("ordinal < 300"))
    counts = dict(rows(origins.groupBy("origin").count()))
    assert counts["reused"] == 12 and sum(counts.values()) == 540
    assert ledger.origin_violations(origins, whole).isEmpty()
    assert not ledger.origin_violations(origins.filter("origin <> 'reused'"), whole).isEmpty()
    mixed = ledger.run_report(
        run(spark, pilot, {1: "failure", 2: "timeout", 0: "failure"}).withColumn("run", F.lit(1)), ["run"], 12).first()
    keys = [r["key"] for r in grid.orderBy("ordinal").collect()]
    assert mixed["failure_keys"] == keys[:2] and mixed["timeout_keys"] == [keys[2]]


def test_replay_report(spark):
    study = Study(levels={"diabetes": PILOT_LEVELS["diabetes"]}, seeds=EDGE_SEEDS)
    grid, book = condition_grid(spark, study), run(spark, study)
    toy = predictions(spark).drop("key")
    stored = grid.select("key").join(toy)
    files = book.select("key", "artifact.bytes", "artifact.sha256")
    assert replay_report(stored, stored, book, files, grid).first()["status"] == "pass"
    assert replay_report(stored, stored, book, files.limit(7), grid).first()["status"] == "fail"
    gate = ledger.analysis_gate(
        ledger.run_report(book.withColumn("run", F.lit(1)), ["run"], 8),
        ledger.reconcile_artifacts(grid, book, files).withColumn("run", F.lit(1)), ["run"], 8)
    assert gate.first()["may_start"]


def test_keys_are_dealt_by_the_rows_they_become(spark, tmp_path, monkeypatch):
    """The runs of all events became 540 rows each in one task."""
    from catalog import base

    cores = spark.sparkContext.defaultParallelism
    rows = 540 * 40 * cores
    events = spark.range(rows, numPartitions=1).select(
        F.col("id").alias("event_id"), F.lit("view").alias("event_type"), F.lit(1).cast("long").alias("user_id"),
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(base, "KEY_ROWS", 540 * 20, raising=False)
    for found in (base.runs(spark, str(tmp_path)), base.events_on_grid(spark, str(tmp_path))):
        held = found.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first()
        assert held[0] == rows and held[1] <= 540 * 20 * 3
