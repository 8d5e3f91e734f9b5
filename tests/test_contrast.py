from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from pairwright.operators import contrast as C
from pairwright.operators import gates
from pairwright.operators.grid import IDENTITY, condition_grid
from pairwright.plans.analysis import analyze
from pairwright.plans.report import count_table, forest_plot_rows, public_table
from pairwright.study import Study

STUDY = Study(levels={"diabetes": (Decimal("0.05"),), "cleveland": (Decimal("0.10"),)}, resamples=400)
WIDE = Study(levels={"diabetes": (Decimal("1.00"), Decimal("0.05")), "cleveland": (Decimal("0.10"),)})


def arm(spark, study, salt):
    unit = F.conv(F.substring(F.sha2(F.concat("key", F.lit(salt)), 256), 1, 7), 16, 10).cast("double") / 16**7
    return condition_grid(spark, study).withColumn("roc_auc", 0.6 + unit * 0.1)


def arms(spark):
    return {"replication": arm(spark, STUDY, "r"), "gaussian": arm(spark, STUDY, "g"),
            "real_only": arm(spark, WIDE, "b")}


def local(spark):
    values = {}
    for name, frame in arms(spark).items():
        for r in frame.collect():
            values[name, r["dataset"], r["retained_fraction_token"], r["model"], r["seed"]] = r["roc_auc"]
    return values


@pytest.fixture(scope="module")
def summary(spark):
    return analyze(spark, arms(spark), STUDY, wider={"real_only": WIDE}).cache()


def test_summary_matches_a_plain_bootstrap(spark, summary):
    values, got = local(spark), summary.collect()
    assert len(got) == 2 * 2 * 3
    for row in got:
        c = next(c for c in STUDY.contrasts if c.name == row["contrast"])
        at = lambda side, s: values[side, row["dataset"], row["retained_fraction_token"], row["model"], s]
        d = [at(c.minuend, s) - at(c.subtrahend, s) for s in range(30)]
        means = []
        for b in range(400):
            total = 0.0
            for j in range(30):
                h = hashlib.sha256(f"{int(row['bootstrap_seed'])}|{b}|{j // 8}".encode()).hexdigest()
                total += d[int(h[8 * (j % 8): 8 * (j % 8) + 8], 16) % 30]
            means.append(total / 30)
        low, high = np.quantile(means, [0.025, 0.975])
        assert row["estimate"] == pytest.approx(np.mean(d), abs=1e-12)
        assert row["ci_lower"] == pytest.approx(low, abs=1e-12)
        assert row["ci_upper"] == pytest.approx(high, abs=1e-12)


def test_pcg64_stream_is_the_generator_s(spark):
    values = local(spark)
    got = analyze(spark, arms(spark), STUDY, wider={"real_only": WIDE}, pcg64=True).collect()
    for row in got:
        c = next(c for c in STUDY.contrasts if c.name == row["contrast"])
        at = lambda side, s: values[side, row["dataset"], row["retained_fraction_token"], row["model"], s]
        d = np.array([at(c.minuend, s) - at(c.subtrahend, s) for s in range(30)])
        picks = np.random.Generator(np.random.PCG64(int(row["bootstrap_seed"]))).integers(0, 30, size=(400, 30))
        low, high = np.quantile(d[picks].mean(axis=1), [0.025, 0.975], method="linear")
        assert row["ci_lower"] == pytest.approx(low, abs=1e-15)
        assert row["ci_upper"] == pytest.approx(high, abs=1e-15)


def test_counts_and_report_rows(summary):
    counts = {r["contrast"]: r for r in C.interpretation_counts(summary).collect()}
    assert all(sum(r[label] for label in ("harmful", "helpful", "no_clear_practically_meaningful_difference")) == 4
               for r in counts.values())
    assert {r["strata"] for r in C.finding_counts(summary).collect()} == {4}
    labels = {r["label"] for r in forest_plot_rows(summary, "gaussian_minus_replication").collect()}
    assert "Diabetes · 5% · Random Forest" in labels and len(labels) == 4
    table = public_table(summary, "gaussian_minus_replication").collect()
    assert {len(r["Estimate"].lstrip("-")) for r in table} == {6}
    assert count_table(C.interpretation_counts(summary)).columns[0] == "Contrast"


def test_accounting(spark):
    sides = arms(spark)
    row = C.accounting(sides["replication"], sides["gaussian"], sides["real_only"],
                       condition_grid(spark, STUDY)).first()
    assert tuple(row) == (120, 120, 180, 120, 4, 30)


def test_interpretation_counts_of_published_labels(spark):
    # Published counts: harmful, no clear, helpful per contrast over 18 strata.
    published = {"a": (10, 8, 0), "b": (7, 11, 0), "c": (12, 6, 0)}
    names = ("harmful", "no_clear_practically_meaningful_difference", "helpful")
    data = [(c, n) for c, counts in published.items() for n, k in zip(names, counts) for _ in range(k)]
    got = C.interpretation_counts(spark.createDataFrame(data, "contrast STRING, interpretation STRING"))
    assert rows(got, "contrast", *names) == sorted((c, *k) for c, k in published.items())


@pytest.mark.parametrize(
    "change, code",
    [
        (lambda f: f.withColumn("ci_lower", F.col("ci_upper") + 0.001), "endpoints_reversed"),
        (lambda f: f.withColumn("bootstrap_seed", F.col("bootstrap_seed") + 1), "seed_not_derivable"),
        (lambda f: f.withColumn("interpretation", F.lit("helpful")), "label_not_derivable"),
        (lambda f: f.withColumn("pairs", F.lit(29)), "pair_count_changed"),
        (lambda f: f.withColumn("estimate", F.lit(float("nan"))), "value_out_of_range"),
        (lambda f: f.withColumn("bootstrap_resamples", F.lit(1)), "resamples_changed"),
    ],
)
def test_summary_mutations(summary, change, code):
    assert gates.summary_gate(summary, STUDY).isEmpty()
    assert code in {r["code"] for r in gates.summary_gate(change(summary), STUDY).collect()}


@pytest.mark.parametrize("fault", ["missing", "duplicate", "range", "key"])
def test_analysis_refuses_faulty_arms(spark, fault):
    sides = arms(spark)
    good = sides["gaussian"]
    bad = {
        "missing": good.filter("seed <> 3"),
        "duplicate": good.unionByName(good.filter("ordinal = 0")),
        "range": good.withColumn("roc_auc", F.when(F.col("ordinal") == 0, 1.5).otherwise(F.col("roc_auc"))),
        "key": good.withColumn("key", F.when(F.col("ordinal") == 0, "x").otherwise(F.col("key"))),
    }[fault]
    with pytest.raises(gates.GateError):
        analyze(spark, {**sides, "gaussian": bad}, STUDY, wider={"real_only": WIDE})


def test_identity_columns_are_the_join_key(spark):
    joined = C.arm_join(arms(spark), list(IDENTITY))
    assert joined.count() == 120 and set(joined.columns) == {*IDENTITY, *arms(spark)}
