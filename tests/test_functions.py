from __future__ import annotations

import hashlib
import json
import math
import random
import struct

from pyspark.sql import functions as F

from pairwright.functions import digests, keys, scores
from pairwright.study import HARMFUL, HELPFUL, NO_CLEAR


def canonical(payload):
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_canonical_json_matches_the_plain_encoder(spark):
    payload = {"z": 1, "a": "été", "m": None, "n": 10**12, "q": 'quote"back\\slash'}
    frame = spark.createDataFrame([tuple(payload.values())], "z INT, a STRING, m STRING, n LONG, q STRING")
    row = frame.select(
        digests.canonical_json(**{name: F.col(name) for name in payload}).alias("t"),
        digests.payload_digest(**{name: F.col(name) for name in payload}).alias("d"),
    ).first()
    assert row["t"] == canonical(payload)
    assert row["d"] == hashlib.sha256(canonical(payload).encode()).hexdigest()


def test_order_digest_and_seed_match_the_payload(spark):
    order = {"namespace": "n.v1", "dataset": "diabetes", "retained_fraction_token": "001pct",
             "split_seed": 29, "class_label": 1, "original_source_row_index": 42}
    seed = {"namespace": "s.v1", "dataset": "diabetes", "retained_fraction_token": "001pct",
            "model": "random_forest", "contrast": "c", "resamples": 10_000}
    row = spark.range(1).select(
        digests.order_digest("n.v1", F.lit("diabetes"), F.lit("001pct"), F.lit(29), F.lit(1),
                             F.lit(42)).alias("order"),
        digests.bootstrap_seed("s.v1", F.lit("diabetes"), F.lit("001pct"), F.lit("random_forest"),
                               F.lit("c"), 10_000).alias("seed"),
    ).first()
    assert row["order"] == hashlib.sha256(canonical(order).encode()).hexdigest()
    assert int(row["seed"]) == int.from_bytes(
        hashlib.sha256(canonical(seed).encode()).digest()[:8], "big")


def test_tokens_paths_and_rounding(spark):
    frame = spark.createDataFrame([("0.01",), ("0.05",), ("0.10",), ("0.29",), ("1.00",)], "f STRING")
    fraction = F.col("f").cast("decimal(3,2)")
    got = frame.select(
        keys.fraction_token(fraction).alias("a"), keys.percent_token(fraction).alias("b"),
        keys.archive_path(F.lit("d"), fraction, F.lit(3), F.lit("m")).alias("p"),
        scores.round_half_up(fraction * 50).alias("r"),
    ).collect()
    assert [r["a"] for r in got] == ["001pct", "005pct", "010pct", "029pct", "100pct"]
    assert [r["b"] for r in got] == [r["a"] for r in got]
    assert got[1]["p"] == "d/seed_03/m_005pct.npz"
    assert [r["r"] for r in got] == [1, 3, 5, 15, 50]


def test_interval_label_is_strict(spark):
    cases = [(0.0100001, 0.2, HELPFUL), (0.01, 0.2, NO_CLEAR), (-0.2, -0.01, NO_CLEAR),
             (-0.2, -0.0100001, HARMFUL), (-0.2, 0.2, NO_CLEAR),
             # Published intervals and labels.
             (-0.01285268634000325, -0.007053978524852477, NO_CLEAR)]
    frame = spark.createDataFrame(cases, "l DOUBLE, u DOUBLE, want STRING")
    label = scores.interpret_interval(F.col("l"), F.col("u"))
    assert frame.filter(label != F.col("want")).isEmpty()


def test_threshold_is_inclusive_on_float(spark):
    frame = spark.createDataFrame([(0.5,), (0.49999997,), (0.9,)], "p FLOAT")
    got = [r[0] for r in frame.select(scores.threshold_prediction(F.col("p"))).collect()]
    assert got == [1, 0, 1]


def test_score_bucket_never_decreases(spark):
    random.seed(5)
    values = [struct.unpack("f", struct.pack("I", random.randrange(0, 0x7F7FFFFF)))[0]
              for _ in range(3000)]
    values += [-v for v in values[:1000]] + [0.0, 1.0, 0.5, 2.0**-149, -(2.0**-149)]
    values += [2.0**k for k in range(-140, 120)] + [math.nextafter(2.0**k, 0) for k in range(-20, 20)]
    frame = spark.createDataFrame([(float(v),) for v in values], "d DOUBLE").select(
        F.col("d").cast("float").alias("s"))
    got = frame.select("s", scores.score_bucket(F.col("s")).alias("b")).collect()
    ordered = sorted((r["s"], r["b"]) for r in got)
    assert all(a[1] <= b[1] for a, b in zip(ordered, ordered[1:]))
    assert all((s > 0) == (b > 0) and (s < 0) == (b < 0) for s, b in ordered)
