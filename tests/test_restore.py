from __future__ import annotations

import hashlib
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_sampling import allocate

from pairwright.operators import ordering, restore

NS = "pairwright.replication-order.v1"
TOY = [(8, 10.0, 0), (3, 20.0, 1), (12, 30.0, 0), (5, 40.0, 1), (20, 50.0, 0)]


def frame(spark, data=TOY):
    return spark.createDataFrame(
        [("diabetes", "001pct", 29, pos, *row) for pos, row in enumerate(data)],
        "dataset STRING, retained_fraction_token STRING, seed INT, pos LONG, row_id LONG, "
        "feature DOUBLE, target INT",
    )


def sha(values, chunk=1 << 20):
    values = list(map(str, values))
    parts = [",".join(values[i : i + chunk]) for i in range(0, len(values), chunk)]
    digests = ",".join(hashlib.sha256(p.encode()).hexdigest() for p in parts)
    return hashlib.sha256(f"{chunk}:{digests}".encode()).hexdigest()


def brute(data, final):
    """The restored id sequence and the two class blocks, from the payload digests."""
    extra = allocate({k: sum(1 for r in data if r[2] == k) for k in (0, 1)}, final - len(data), 0)
    blocks, ranks = {}, {}
    for label in (0, 1):
        def key(row):
            payload = {"namespace": NS, "dataset": "diabetes", "retained_fraction_token": "001pct",
                       "split_seed": 29, "class_label": label, "original_source_row_index": row}
            text = json.dumps(payload, sort_keys=True, separators=(",", ":"))
            return hashlib.sha256(text.encode()).hexdigest()
        ranks[label] = sorted((r[0] for r in data if r[2] == label), key=lambda r: (key(r), r))
        blocks[label] = [ranks[label][i % len(ranks[label])] for i in range(extra[label])]
    return [r[0] for r in data] + blocks[0] + blocks[1], ranks, blocks


def restorer(spark, final, data=TOY, **options):
    return restore.Restorer(frame(spark, data), F.lit(final), position="pos", **options)


@pytest.mark.parametrize("final", [5, 6, 17, 24, 100])
@pytest.mark.parametrize("bucket_rows", [1_000_000, 1])
def test_restored_sequence(spark, final, bucket_rows):
    want, _, blocks = brute(TOY, final)
    work = restorer(spark, final, bucket_rows=bucket_rows)
    got = work.restored().orderBy("pos").collect()
    assert [r["row_id"] for r in got] == want
    assert [r["pos"] for r in got] == list(range(final))
    features = {row[0]: row[1] for row in TOY}
    assert all(r["feature"] == features[r["row_id"]] for r in got)
    copies = dict(rows(work.copies(), "row_id", "copies"))
    assert copies == {r[0]: (blocks[0] + blocks[1]).count(r[0]) for r in TOY}
    assert restore.restoration_violations(work.restored(), work.allocation).isEmpty()


@pytest.mark.parametrize("final", [5, 17])
def test_audit_record(spark, final):
    want, ranks, blocks = brute(TOY, final)
    work = restorer(spark, final)
    audit = work.audit().first()
    assert audit["original_source_indices_sha256"] == sha([r[0] for r in TOY])
    assert audit["duplicate_source_indices_sha256"] == sha(blocks[0] + blocks[1])
    assert audit["final_source_indices_sha256"] == sha(want)
    labels = {r[0]: r[2] for r in TOY}
    assert audit["final_target_labels_sha256"] == sha([labels[r] for r in want])
    assert (audit["original_count"], audit["duplicate_count"], audit["final_count"]) == (5, final - 5, final)
    per_class = {r["target"]: r for r in work.class_blocks().collect()}
    for label in (0, 1):
        block = per_class[label]
        assert block["ranked_source_indices_sha256"] == sha(ranks[label])
        assert block["duplicate_source_indices_sha256"] == sha(blocks[label])
        assert block["duplicate_count"] == len(blocks[label])
    assert restore.allocation_record_violations(work.audit(), work.class_blocks()).isEmpty()


def test_long_sequences_are_digested_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CHUNK", 4)
    data = spark.range(10).select(F.lit("g").alias("g"), F.col("id").alias("pos"))
    got = ordering.ordered_digest(data, ["g"], "pos", d=F.col("pos")).first()["d"]
    assert got == sha(range(10), 4)


def test_positions_default_to_ascending_ids(spark):
    work = restore.Restorer(frame(spark).drop("pos"), F.lit(9))
    first = work.restored().filter("pos < 5").orderBy("pos").collect()
    assert [r["row_id"] for r in first] == [3, 5, 8, 12, 20]


def test_record_does_not_depend_on_partitioning(spark):
    one = restore.Restorer(frame(spark).coalesce(1), F.lit(17), position="pos").audit().first()
    many = restore.Restorer(frame(spark).repartition(5), F.lit(17), position="pos").audit().first()
    assert one == many


@pytest.mark.parametrize(
    "change, final, code",
    [
        (lambda r: (r[0], r[1], 0), 17, "labels_not_zero_and_one"),
        (lambda r: (r[0], r[1], 2 if r[0] == 12 else r[2]), 17, "labels_not_zero_and_one"),
        (lambda r: (3 if r[0] == 5 else r[0], r[1], r[2]), 17, "row_id_not_unique"),
        (lambda r: (-1 if r[0] == 5 else r[0], r[1], r[2]), 17, "row_id_negative_or_null"),
        (lambda r: r, 4, "final_size_below_retained"),
    ],
)
def test_invalid_input_gives_one_code(spark, change, final, code):
    found = restore.restoration_input_violations(frame(spark, [change(r) for r in TOY]), F.lit(final))
    assert rows(found, "code") == [(code,)]


def test_wrong_types_are_refused(spark):
    good = frame(spark)
    assert restore.restoration_input_violations(good, F.lit(17)).isEmpty()
    for name in ("row_id", "target"):
        with pytest.raises(TypeError):
            restore.restoration_input_violations(good.withColumn(name, F.col(name).cast("string")), F.lit(17))
    with pytest.raises(TypeError):
        restore.restoration_input_violations(good.withColumn("target", F.col("target") == 1), F.lit(17))


@pytest.mark.parametrize(
    "column, value, code",
    [("final_count", 18, "total_count"), ("final_source_indices_sha256", "x", "hash_field")],
)
def test_record_mutations(spark, column, value, code):
    work = restorer(spark, 17)
    audit = work.audit().withColumn(column, F.lit(value))
    found = {r["code"] for r in restore.allocation_record_violations(audit, work.class_blocks()).collect()}
    assert code in found


def test_restored_table_mutations(spark):
    work = restorer(spark, 17)
    good = work.restored()
    codes = lambda broken: {
        r["code"] for r in restore.restoration_violations(broken, work.allocation).collect()}
    assert "wrong_final_size" in codes(good.filter("pos <> 16"))
    swapped = good.withColumn("pos", F.when(F.col("pos") == 0, 16).when(F.col("pos") == 16, 0).otherwise(F.col("pos")))
    assert {"originals_not_first", "class_blocks_out_of_order"} <= codes(swapped)
    assert codes(good.withColumn("pos", F.when(F.col("pos") == 1, 2).otherwise(F.col("pos")))) == {"positions_not_dense"}


def test_membership_of_restored_rows(spark):
    work = restorer(spark, 17)
    good, planned = work.restored(), work.copies()
    assert restore.restoration_violations(good, work.allocation, planned=planned).isEmpty()
    codes = lambda rows: {
        r["code"] for r in restore.restoration_violations(rows, work.allocation, planned=planned).collect()}
    # one duplicate of 8 becomes a duplicate of a row that was never retained
    place = good.filter("is_duplicate AND row_id = 8").agg(F.min("pos")).first()[0]
    foreign = good.withColumn("row_id", F.when(F.col("pos") == place, 99).otherwise(F.col("row_id")))
    assert codes(foreign) == {"row_never_retained", "wrong_copies_of_row"}
    # one original swapped for another of its class: all counts stay as they are
    swapped = good.withColumn(
        "row_id", F.when(~F.col("is_duplicate") & (F.col("row_id") == 8), 12).otherwise(F.col("row_id")))
    assert codes(swapped) == {"original_missing_or_repeated"}


def test_ordered_digest_streams_its_chunks(spark, monkeypatch):
    """Chunks were lists in memory, all those of a task at once; null keys and values, many batches."""
    monkeypatch.setattr(ordering, "CHUNK", 64)
    data = [(g, p, None if (p * 7 + len(str(g))) % 5 == 0 else p * 3) for g in ("a", None, "b,c") for p in range(300)]
    frame = spark.createDataFrame(data, "g STRING, pos LONG, v LONG").repartition(5)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, 17)
    try:
        found = ordering.ordered_digest(frame, ["g"], "pos", glue="\n", v=F.col("v"))
        got = {r["g"]: r["v"] for r in found.collect()}
        plan = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset(batch)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for group in ("a", None, "b,c"):
        values = [v for g, _, v in data if g == group]
        chunks = ["\n".join(str(v) for v in values[k : k + 64] if v is not None) + "\n" for k in range(0, 300, 64)]
        assert got[group] == sha("64:" + ",".join(sha(chunk) for chunk in chunks))
    assert plan.count("collect_list") == 1  # of chunk digests, not of rows


def test_digests_of_both_audits_place_the_rows_once(spark, monkeypatch):
    rows = spark.range(200).select(
        F.lit("d").alias("dataset"), F.lit("050pct").alias("retained_fraction_token"), F.lit(0).alias("seed"),
        F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("target"),
    )
    restorer, calls = restore.Restorer(rows, F.lit(500)), []
    plain = restore.Restorer._ordered
    monkeypatch.setattr(restore.Restorer, "_ordered", lambda self, table: calls.append(1) or plain(self, table))
    restorer.audit()
    restorer.class_blocks()
    assert len(calls) == 1
