from __future__ import annotations

import hashlib
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pairwright.operators.grid import (
    canonical_order,
    condition_grid,
    key_manifest,
    key_manifest_violations,
    strata,
)
from pairwright.study import (
    Study,
    baseline_study,
    pilot_study,
    replay_study,
    scarcity_study,
)

# Published digests of the two key sets.
DIGEST_540 = "494f771a76c24df2d9a216e67c4f8ba389bcff811fc0b9b0342ec4729a51c9a1"
DIGEST_660 = "c90b12fc2469e5e4d58c229960f0d305dd7f97353a0d3b6d34fedf3a4077cce7"


@pytest.mark.parametrize(
    "study, count",
    [(scarcity_study(), 540), (baseline_study(), 660), (pilot_study(), 12), (replay_study(), 16)],
)
def test_grid_sizes_and_ordinals(spark, study, count):
    grid = condition_grid(spark, study).orderBy("ordinal").collect()
    assert len(grid) == count == study.size
    assert [row["ordinal"] for row in grid] == list(range(count))
    expected = [
        f"{d}__{int(f * 100):03d}pct__seed_{s:02d}__{m}"
        for d, levels in study.levels.items() for f in levels
        for s in study.seeds for m in study.models
    ]
    assert [row["key"] for row in grid] == expected


@pytest.mark.parametrize(
    "study, digest", [(scarcity_study(), DIGEST_540), (baseline_study(), DIGEST_660)]
)
def test_key_digests_are_the_published_ones(spark, study, digest):
    row = key_manifest(spark, study, "full").first()
    assert row["condition_keys_sha256"] == digest
    assert row["condition_count"] == study.size


def test_manifest_mutations_give_their_code(spark):
    study = pilot_study()
    good = condition_grid(spark, study).select("key", F.col("ordinal").alias("pos"))
    header = key_manifest(spark, study, "pilot")
    assert key_manifest_violations(header, good, study).isEmpty()

    first = good.filter("pos = 0")
    codes = lambda stored, head=header: {
        row["code"] for row in key_manifest_violations(head, stored, study).collect()
    }
    assert codes(good.filter("pos > 0")) == {"missing_key"}
    assert codes(good.unionByName(first)) == {"duplicate_key"}
    assert codes(
        good.unionByName(spark.createDataFrame([("foreign", 12)], "key STRING, pos LONG"))
    ) == {"unexpected_key"}
    swapped = good.withColumn("pos", F.when(F.col("pos") < 2, 1 - F.col("pos")).otherwise(F.col("pos")))
    assert codes(swapped) == {"key_out_of_order"}
    assert codes(good, header.withColumn("condition_count", F.lit(11))) == {"count_changed"}
    assert codes(good, header.withColumn("condition_keys_sha256", F.lit("0"))) == {"digest_changed"}


def test_canonical_order_follows_the_declaration(spark):
    study = scarcity_study()
    shuffled = condition_grid(spark, study).orderBy(F.sha2("key", 256))
    assert [r["ordinal"] for r in canonical_order(shuffled, study).collect()] == list(range(540))
    assert strata(spark, study).count() == 18


def test_study_rejects_bad_declarations():
    with pytest.raises(ValueError):
        Study(levels={"a b": (Decimal("0.5"),)})
    with pytest.raises(ValueError):
        Study(levels={"a": (Decimal("1.5"),)})
    with pytest.raises(ValueError):
        Study(levels={"a": (Decimal("0.5"),)}, split_namespace="x", order_namespace="x")


def test_namespace_changes_no_key(spark):
    other = Study(levels=pilot_study().levels, seeds=(0, 29), order_namespace="other.v1")
    assert rows(condition_grid(spark, other), "key") == rows(condition_grid(spark, pilot_study()), "key")
    assert hashlib.sha256(b"\n").hexdigest() != DIGEST_540
