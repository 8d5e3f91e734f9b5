from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pairwright.operators import gates
from pairwright.operators.grid import condition_grid
from pairwright.operators.ordering import settle
from pairwright.operators.reconcile import package_digest
from pairwright.sources import commits, documents, inventory, predictions, tables
from pairwright.study import pilot_study
from test_gates import TOY, run


def test_labelled_csv(spark, tmp_path):
    header = [tables.DIABETES_TARGET, "HighBP", *tables.DIABETES_NUMERIC]
    lines = [",".join(header)] + [f"{i % 2}.0,{i % 2},{i},1,2,3,4,5,6" for i in range(5)]
    path = tmp_path / "a.csv"
    path.write_text("\n".join(lines) + "\n")
    got, spec = tables.scan_labelled_csv(spark, str(path), "diabetes", tables.DIABETES_TARGET, tables.DIABETES_NUMERIC)
    assert spec.binary == ("HighBP",) and dict(got.dtypes)[tables.DIABETES_TARGET] == "tinyint"
    assert rows(got, "row_id", "BMI") == [(i, float(i)) for i in range(5)]
    with pytest.raises(gates.GateError):
        tables.scan_labelled_csv(spark, str(path), "diabetes", "gone", ())


def test_row_ids_follow_the_file_over_many_splits(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("Diabetes_binary,v\n" + "".join(f"{i % 2},{i}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got, _ = tables.scan_labelled_csv(spark, str(path), "t", "Diabetes_binary", ("v",))
        assert got.rdd.getNumPartitions() > 3
        assert got.filter(F.col("row_id") != F.col("v")).isEmpty() and got.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_headerless_csv(spark, tmp_path):
    path = tmp_path / "heart.csv"
    path.write_text("63,1,1,145,233,1,2,150,0,2.3,3,0,6,0\n67,1,4,160,286,0,2,108,1,1.5,2,?,3,2\n")
    got, spec = tables.scan_headerless_csv(spark, str(path), "cleveland")
    assert rows(got, "row_id", "ca", "target") == [(0, 0.0, 0), (1, None, 1)]
    assert "num" not in got.columns and spec.nominal == tables.HEART_NOMINAL


def metric_file(path, columns, keys):
    lines = [",".join(columns)]
    for i, (dataset, fraction, seed, model) in enumerate(keys):
        cell = {"dataset": dataset, "model": model, "seed": seed, "scarcity_fraction": fraction, "roc_auc": 0.5 + i / 100}
        lines.append(",".join(str(cell.get(c, 1)) for c in columns))
    path.write_text("\n".join(lines) + "\n")


def test_metric_csv(spark, tmp_path):
    path = tmp_path / "m.csv"
    keys = [("diabetes", 0.01, 0, "random_forest"), ("cleveland", 0.5, 29, "logistic_regression")]
    metric_file(path, tables.AUGMENTATION_COLUMNS, keys)
    got = tables.scan_metric_csv(spark, str(path), tables.AUGMENTATION_COLUMNS)
    assert rows(got, "key", "roc_auc") == [
        ("cleveland__050pct__seed_29__logistic_regression", 0.51), ("diabetes__001pct__seed_00__random_forest", 0.5)]
    assert tables.scan_metric_keys(spark, str(path), tables.AUGMENTATION_COLUMNS).columns == ["key"]
    with pytest.raises(gates.GateError):
        tables.scan_metric_csv(spark, str(path), tables.BASELINE_COLUMNS)
    manifest = inventory.source_manifest(spark, str(tmp_path), {"m.csv": tables.AUGMENTATION_COLUMNS})
    row = manifest.first()
    assert (row["row_count"], row["key_count"], row["bytes"]) == (2, 2, path.stat().st_size)
    assert row["sha256"] == hashlib.sha256(path.read_bytes()).hexdigest()
    assert inventory.manifest_drift(manifest, manifest).isEmpty()
    assert inventory.manifest_drift(manifest, manifest.withColumn("bytes", F.col("bytes") + 1)).count() == 2


def test_inventory_and_evidence(spark, tmp_path):
    full, pilot = tmp_path / "full", tmp_path / "pilot"
    for root, keys in ((full, ["k0", "k1"]), (pilot, ["k0"])):
        for key in keys:
            (root / "checkpoints").mkdir(parents=True, exist_ok=True)
            (root / "predictions").mkdir(exist_ok=True)
            (root / "checkpoints" / f"{key}.json").write_text(key)
            (root / "predictions" / f"{key}.npz").write_text(key * 3)
        (root / "operational_report.json").write_text("{}")
    found = inventory.file_inventory(spark, str(full))
    files = sorted(p for p in full.rglob("*") if p.is_file())
    want = sorted((p.relative_to(full).as_posix(), p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in files)
    assert rows(found, "path", "bytes", "sha256") == want
    lines = hashlib.sha256("".join(f"{a}\t{b}\t{c}\n" for a, b, c in want).encode()).hexdigest()
    identity = hashlib.sha256(f"{1 << 20}:{lines}".encode()).hexdigest()
    assert package_digest(found).first()["identity_sha256"] == identity
    keys = spark.createDataFrame([("k0",), ("k1",)], "key STRING")
    earlier = inventory.file_inventory(spark, str(pilot))
    declared = settle(found.filter("path LIKE '%.npz'"))  # read before the files change
    row = inventory.evidence_manifest(found, keys, earlier, keys.filter("key = 'k0'")).first()
    assert (row["file_count"], row["missing_paths"], row["unexpected_paths"]) == (5, 0, 0)
    assert row["reused_files"] == 2 and row["reuse_byte_identical"]
    (full / "predictions" / "k0.npz").write_text("zzzzzz")
    (full / "stray.txt").write_text("")
    row = inventory.evidence_manifest(inventory.file_inventory(spark, str(full)), keys, earlier, keys.filter("key = 'k0'")).first()
    assert row["unexpected_paths"] == 1 and not row["reuse_byte_identical"]

    assert {r["code"] for r in inventory.bundle_violations(spark, str(full), declared).collect()} == {"artifact_hash_mismatch"}


def test_write_once(spark, tmp_path):
    frame, path = spark.range(5).withColumn("v", F.col("id") * 2), str(tmp_path / "out")
    assert inventory.write_once(frame, path) == "written"
    assert inventory.write_once(frame.repartition(3), path) == "unchanged"
    with pytest.raises(gates.GateError):
        inventory.write_once(frame.withColumn("v", F.lit(1)), path)
    assert spark.read.parquet(path).filter("v <> id * 2").isEmpty()


def test_ledger_is_gated_before_the_append(spark, tmp_path):
    path = str(tmp_path / "ledger")
    book = run(spark, pilot_study()).withColumn("run", F.lit(1))
    inventory.append_ledger(book.filter("ordinal < 6"), path)
    inventory.append_ledger(book.filter("ordinal >= 6"), path)
    assert inventory.read_ledger(spark, path, book.schema).count() == 12
    with pytest.raises(gates.GateError):
        inventory.append_ledger(book.withColumn("elapsed_seconds", F.lit(-1.0)), path)
    for again in (book.filter("ordinal = 3"), book.filter("ordinal = 3").withColumn("run", F.lit(2))):
        with pytest.raises(gates.GateError):
            inventory.append_ledger(again.unionByName(again) if again.first()["run"] == 2 else again, path)
    assert inventory.read_ledger(spark, path, book.schema).count() == 12


def test_of_two_writers_one_is_refused(spark, tmp_path, monkeypatch):
    """A second writer commits between the first one's look at the ledger and its commit."""
    path = str(tmp_path / "ledger")
    book = run(spark, pilot_study()).withColumn("run", F.lit(1))
    inventory.append_ledger(book.filter("ordinal = 0"), path)
    plain = commits.create_if_absent
    late = [book.filter("ordinal IN (1, 2)"), book.filter("ordinal IN (3, 4)")]

    def interrupted(*args):
        if late:
            rows = late.pop()
            inventory.append_ledger(rows, path)
        return plain(*args)

    monkeypatch.setattr(commits, "create_if_absent", interrupted)
    with pytest.raises(gates.GateError, match="already_terminal"):
        inventory.append_ledger(book.filter("ordinal IN (2, 5)"), path)
    inventory.append_ledger(book.filter("ordinal IN (5, 6)"), path)
    got = rows(inventory.read_ledger(spark, path, book.schema), "ordinal")
    assert got == [(i,) for i in range(7)]


def test_writers_at_once_number_their_commits_without_gaps(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path / "log"))
    assert log.versions() == 0 and log.read("t", "id LONG").isEmpty()
    staged = [log.stage({"t": spark.range(i, i + 1)}) for i in range(9)]
    with ThreadPoolExecutor(9) as pool:
        numbers = list(pool.map(lambda s: log.commit(s, lambda since, upto: None), staged))
    assert sorted(numbers) == list(range(9)) and log.versions() == 9
    assert rows(log.read("t", "id LONG")) == [(i,) for i in range(9)]
    assert not commits.create_if_absent(spark, log._file(3), "other")
    log.stage({"t": spark.range(100)})  # never committed
    assert log.read("t", "id LONG").count() == 9


def test_large_and_empty_files_are_hashed_as_streams(spark, tmp_path, monkeypatch):
    root = tmp_path / "files"
    (root / "a b" / "deep").mkdir(parents=True)
    (root / "a b" / "deep" / "ü%20.bin").write_bytes(b"x" * 1001)
    (root / "empty").write_bytes(b"")
    with open(root / "sparse", "wb") as out:  # 3 GiB of zeros that take no disk
        out.truncate(3 << 30)
    want = hashlib.sha256()
    for _ in range(3 << 8):
        want.update(bytes(1 << 22))
    got = {r["path"]: (r["bytes"], r["sha256"]) for r in inventory.file_inventory(spark, str(root)).collect()}
    assert got == {
        "a b/deep/ü%20.bin": (1001, hashlib.sha256(b"x" * 1001).hexdigest()),
        "empty": (0, hashlib.sha256().hexdigest()),
        "sparse": (3 << 30, want.hexdigest()),
    }
    assert rows(inventory.file_inventory(spark, str(root), "*.bin"), "path") == [("a b/deep/ü%20.bin",)]


def test_predictions_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(*r, "d", "m") for r in TOY], predictions.SCHEMA)
    path = str(tmp_path / "p")
    predictions.write_predictions(frame, path)
    assert rows(predictions.read_predictions(spark, path)) == rows(frame)
    nested = predictions.to_arrays(frame, ["key"], block=3)
    assert nested.count() == 2
    assert rows(predictions.from_arrays(nested, ["key"], block=3)) == rows(frame.drop("dataset", "model"))


def test_summary_documents(spark, tmp_path):
    from pairwright.operators.contrast import stratum_summaries
    from pairwright.study import Study, decimals

    study = Study(levels={"d": decimals("0.05")}, resamples=50)
    differences = condition_grid(spark, study).withColumn("contrast", F.lit("c")).withColumn("difference", F.col("seed") / 100)
    summary = stratum_summaries(differences, study)
    path = str(tmp_path / "rows")
    documents.write_summary_rows(summary, path)
    back = documents.tidy_summary(documents.read_rows(spark, path, documents.ROW_SCHEMA))
    columns = ["model", "contrast", "estimate", "ci_lower", "bootstrap_seed", "interpretation"]
    assert rows(back, *columns) == rows(summary, *columns)
    # One published row, in the published document form.
    document = tmp_path / "document.json"
    document.write_text("""{"stratum_count": 1, "practical_threshold": 0.01, "rows": [{"dataset": "diabetes",
      "retained_fraction": 0.01, "retained_fraction_token": "001pct", "model": "logistic_regression",
      "paired_seed_count": 30, "contrasts": {"gaussian_minus_replication": {"estimate": -0.009940407673173769,
      "ci_lower": -0.01285268634000325, "ci_upper": -0.007053978524852477,
      "interpretation": "no_clear_practically_meaningful_difference", "bootstrap_seed": 9440221718500065875,
      "bootstrap_resamples": 10000, "method": "paired_seed_level_bootstrap", "quantiles": [0.025, 0.975],
      "quantile_method": "linear"}}}]}""")
    row = documents.read_summary_document(spark, str(document)).first()
    assert int(row["bootstrap_seed"]) == 9440221718500065875 and row["ci_lower"] == -0.01285268634000325


def test_write_once_replaces_an_incomplete_output(spark, tmp_path):
    path = tmp_path / "out"
    path.mkdir()
    (path / "part-0.parquet").write_bytes(b"half")
    frame = spark.range(5)
    assert inventory.write_once(frame, str(path)) == "written"
    assert spark.read.parquet(str(path)).count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
