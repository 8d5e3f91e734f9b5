from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.operators import metrics as M

SCHEMA = "g STRING, y_true TINYINT, probability FLOAT"


def brute_auc(y, s):
    wins = sum((a > b) + 0.5 * (a == b) for a, ya in zip(s, y) if ya for b, yb in zip(s, y) if not yb)
    return wins / (sum(y) * (len(y) - sum(y)))


def brute_ap(y, s):
    area, seen, hits, last = 0.0, 0, 0, 0
    for threshold in sorted(set(s), reverse=True):
        at = [yy for yy, ss in zip(y, s) if ss == threshold]
        seen, hits = seen + len(at), hits + sum(at)
        area += (hits - last) / sum(y) * hits / seen
        last = hits
    return area


def groups():
    random.seed(11)
    data = {}
    for g in range(12):
        n = random.randrange(2, 80)
        y = [1, 0] + [random.randrange(2) for _ in range(n)]
        pool = [random.random() for _ in range(random.choice([1, 3, n]))] + [0.0, 1.0, 0.5]
        s = [float(np.float32(random.choice(pool))) for _ in y]
        data[f"g{g}"] = (y, s)
    y = [i % 2 for i in range(200)]
    data["negative"] = (y, [float(np.float32(random.uniform(-5, 5))) for _ in y])
    return data


def table(spark, data):
    return spark.createDataFrame([(g, a, b) for g, (y, s) in data.items() for a, b in zip(y, s)], SCHEMA)


def test_ranking_metrics_match_brute_force(spark):
    data = groups()
    frame = table(spark, data)
    auc = {r["g"]: r["roc_auc"] for r in M.roc_auc(frame, ["g"]).collect()}
    full = {r["g"]: r for r in M.evaluate(frame, ["g"]).collect()}
    for g, (y, s) in data.items():
        assert auc[g] == pytest.approx(brute_auc(y, s), abs=1e-15)
        assert full[g]["roc_auc"] == auc[g]
        assert full[g]["average_precision"] == pytest.approx(brute_ap(y, s), abs=1e-12)


def test_threshold_metrics_and_zero_denominators(spark):
    frame = table(spark, {"none": ([1, 0], [0.1, 0.2]), "half": ([1, 0, 1, 0], [0.5, 0.7, 0.2, 0.1]),
                          "toy": ([0, 1, 0, 1], [0.1, 0.8, 0.3, 0.7])})
    got = {r["g"]: r for r in M.threshold_metrics(frame, ["g"]).collect()}
    assert (got["none"]["precision"], got["none"]["recall"], got["none"]["f1"]) == (0, 0, 0)
    assert got["none"]["accuracy"] == 0.5
    assert (got["half"]["precision"], got["half"]["recall"], got["half"]["f1"]) == (0.5, 0.5, 0.5)
    assert (got["toy"]["precision"], got["toy"]["accuracy"]) == (1, 1)
    full = {r["g"]: r for r in M.evaluate(frame, ["g"]).collect()}
    for g, row in got.items():
        assert all(full[g][c] == row[c] for c in ("precision", "recall", "f1", "accuracy"))


def test_single_class_is_null_and_double_scores_are_refused(spark):
    frame = table(spark, {"one": ([1, 1], [0.1, 0.2])})
    assert M.roc_auc(frame, ["g"]).first()["roc_auc"] is None
    with pytest.raises(TypeError):
        M.roc_auc(frame.withColumn("probability", F.col("probability").cast("double")), ["g"])


def test_one_hot_group_equals_the_closed_form(spark):
    """A third of all rows share one score; the rest are spread over many buckets."""
    n = 30_000
    frame = spark.range(n).select(
        F.lit("g").alias("g"), (F.col("id") % 2).cast("tinyint").alias("y_true"),
        F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.col("id") / n).cast("float").alias("probability"))
    local = frame.toPandas()
    p, q = local[local.y_true == 1].probability.to_numpy(), local[local.y_true == 0].probability.to_numpy()
    ordered = np.sort(q)
    wins = np.searchsorted(ordered, p, "left").sum() + np.searchsorted(ordered, p, "right").sum()
    want = wins / (2 * len(p) * len(q))
    assert M.roc_auc(frame, ["g"]).first()["roc_auc"] == want
    assert M.roc_auc(frame.repartition(13), ["g"]).first()["roc_auc"] == want
    assert M.roc_auc(frame.coalesce(1), ["g"]).first()["roc_auc"] == want
