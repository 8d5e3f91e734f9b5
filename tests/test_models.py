from __future__ import annotations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from pairwright.operators import preprocess as P
from pairwright.operators.logistic import fit_logistic, score_logistic
from pairwright.operators.metrics import roc_auc
from pairwright.plans.grid_run import GridRun, latest_rows, pending_study
from pairwright.operators.grid import condition_grid
from pairwright.study import Study, TableSpec, decimals, pilot_study

SPEC = TableSpec("toy", "target", ("num",), ("nom",), ("bin",))


def table(spark, n=80):
    data = [(i, 10 * i / (n - 1) if i % 9 else None, "abca"[i % 4], float(i % 2), int((i * 7) % 10 < 5))
            for i in range(n)]
    return spark.createDataFrame(data, "row_id LONG, num DOUBLE, nom STRING, bin DOUBLE, target INT")


@pytest.mark.parametrize("bins", [4096, 3])
def test_weighted_median_is_exact(spark, bins, monkeypatch):
    monkeypatch.setattr(P, "BINS", bins)
    rng = np.random.default_rng(4)
    data, want = [], {}
    for g in range(3):
        values, weights = rng.lognormal(size=301 + g), rng.integers(1, 9, size=301 + g)
        want[g] = float(np.median(np.repeat(values, weights)))
        data += [(g, float(v), int(w)) for v, w in zip(values, weights)] + [(g, None, 5)]
    frame = spark.createDataFrame(data, "g INT, v DOUBLE, w INT")
    got = P.impute_numeric(frame, ["g"], ["v"], F.col("w"))
    assert {r["g"]: r["median"] for r in got.collect()} == pytest.approx(want, abs=0)


def test_mode_takes_the_smallest_on_ties(spark):
    frame = spark.createDataFrame([("b", 2.0, 1), ("a", 1.0, 1), ("c", 1.0, 3), (None, None, 9), ("a", 2.0, 2)],
                                  "s STRING, d DOUBLE, w INT")
    got = {r["feature"]: r for r in P.impute_mode(frame, [], ["s", "d"], F.col("w")).collect()}
    assert got["s"]["text"] == "a" and got["s"]["n"] == 3
    assert got["d"]["number"] == 1.0 and got["d"]["n"] == 4


def test_moments_and_design(spark):
    frame = table(spark).withColumn("g", F.lit(1)).withColumn("w", F.col("row_id") % 3 + 1)
    work = P.Preprocessor(frame, ["g"], SPEC, weight=F.col("w"), intercept=True)
    local = frame.toPandas()
    weights = local["w"].to_numpy()
    median = np.median(np.repeat(local["num"].to_numpy(), weights)[~np.isnan(np.repeat(local["num"].to_numpy(), weights))])
    filled = np.repeat(local["num"].fillna(median).to_numpy(), weights)
    got = work.transform(frame, scaled=True, keep=["row_id"]).orderBy("row_id").collect()
    want = (local["num"].fillna(median) - filled.mean()) / filled.std()
    assert np.allclose([r["x"][0] for r in got], want, atol=1e-12)
    assert work.names == ["num", "nom=a", "nom=b", "nom=c", "bin", "(intercept)"]
    assert [r["x"][1:4] for r in got[:3]] == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    assert {r["x"][5] for r in got} == {1.0}


def test_unknown_category_is_all_zero_and_flat_column_is_kept(spark):
    train = spark.createDataFrame([(1, 5.0, "a"), (1, 5.0, "b"), (2, 1.0, "a"), (2, 3.0, "c")], "g INT, num DOUBLE, nom STRING")
    spec = TableSpec("t", "target", ("num",), ("nom",))
    work = P.Preprocessor(train, ["g"], spec)
    new = spark.createDataFrame([(1, 6.0, "c"), (1, None, None)], "g INT, num DOUBLE, nom STRING")
    got = [r["x"] for r in work.transform(new, scaled=True, keep=["nom"]).orderBy(F.desc("nom")).collect()]
    assert got == [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]]


def newton(x, y, w, c=1.0):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = beta + c * x.T @ (w * (p - y))
        beta -= np.linalg.solve(np.eye(len(beta)) + c * (x * (w * p * (1 - p))[:, None]).T @ x, gradient)
    return beta


def test_batched_fit_equals_single_fits(spark, monkeypatch):
    from pairwright.operators import logistic

    monkeypatch.setattr(logistic, "STATE_CELLS", 60)  # several batches of conditions
    rng = np.random.default_rng(8)
    data, want = [], {}
    for g in range(7):
        n = 40 + 30 * g
        x = np.hstack([rng.normal(size=(n, 3)) * (1 + g), np.ones((n, 1))])
        y = (rng.random(n) < 1 / (1 + np.exp(-x @ np.array([1.0, -2.0, 0.5, 0.3])))).astype(float)
        w = rng.integers(1, 6, size=n).astype(float)
        want[g] = newton(x, y, w)
        data += [(g, list(map(float, r)), int(t), int(v)) for r, t, v in zip(x, y, w)]
    frame = spark.createDataFrame(data, "g INT, x ARRAY<DOUBLE>, target INT, weight INT").repartition(5)
    fitted = fit_logistic(frame, ["g"], 4)
    for row in fitted.collect():
        assert row["converged"]
        assert np.allclose(row["coefficients"], want[row["g"]], atol=1e-7)
    scored = score_logistic(frame, fitted, ["g"])
    assert dict(scored.dtypes)["probability"] == "float" and scored.count() == len(data)


def test_weighted_fit_equals_fit_on_duplicates(spark):
    frame = spark.createDataFrame([("a", [float(i % 5), 1.0], i % 2, i % 3 + 1) for i in range(40)],
                                  "g STRING, x ARRAY<DOUBLE>, target INT, weight INT")
    repeated = frame.withColumn("i", F.explode(F.sequence(F.lit(1), "weight"))).withColumn("weight", F.lit(1))
    a, b = (fit_logistic(f, ["g"], 2).first()["coefficients"] for f in (frame, repeated))
    assert np.allclose(a, b, atol=1e-9)


@pytest.fixture(scope="module")
def grid(spark):
    study = Study(levels={"toy": decimals("0.25", "0.50")}, seeds=(0, 29))
    return GridRun(table(spark), SPEC, study, trees=5)


def test_grid_run_shares_test_rows_and_restores_sizes(spark, grid):
    assert grid.pool == 64
    training = grid.training()
    sizes = rows(training.groupBy("arm", "retained_fraction_token", "seed").agg(F.sum("weight").alias("n")))
    assert {(a, t, n) for a, t, _, n in sizes} == {
        ("real_only", "025pct", 16), ("real_only", "050pct", 32),
        ("replication", "025pct", 64), ("replication", "050pct", 64)}
    got = grid.predictions().cache()
    assert got.count() == 2 * 2 * 2 * 2 * 16
    assert got.select("key").distinct().count() == 8
    assert rows(got.groupBy("arm", "key").agg(F.sum("test_index").alias("s")).groupBy().agg(F.count_distinct("s").alias("k"))) == [(2,)]
    scores = roc_auc(got, ["key", "arm"])
    assert scores.count() == 16 and scores.filter("roc_auc IS NULL").isEmpty()


def test_pending_study_and_latest_rows(spark):
    study = pilot_study()
    pending = condition_grid(spark, study).filter("dataset = 'cleveland' AND seed = 29")
    left = pending_study(study, pending)
    assert list(left.levels) == ["cleveland"] and left.seeds == (29,) and left.size == 2
    book = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "key STRING, completed_at STRING")
    assert rows(latest_rows(book)) == [("a", "2"), ("b", "1")]


def sparse_rows(spark, features, seed=3):
    """Rows of two conditions with a number, an intercept and a cell of each of ``features`` categories."""
    rng = np.random.default_rng(seed)
    width = 2 + sum(features)
    data, designs = [], {}
    for g in range(2):
        n = 300
        x = np.zeros((n, width))
        x[:, 0], x[:, width - 1] = rng.normal(size=n) * (1 + g), 1.0
        start = 1
        for k in features:
            # some rows have no category, one category has a third of the rows
            cell = np.where(rng.random(n) < 0.3, 0, rng.integers(0, k, size=n))
            has = rng.random(n) < 0.9
            x[np.flatnonzero(has), start + cell[has]] = 1.0
            start += k
        y = (rng.random(n) < 1 / (1 + np.exp(-x @ rng.normal(size=width)))).astype(float)
        w = rng.integers(1, 6, size=n).astype(float)
        designs[g] = (x, y, w)
        for row, t, v in zip(x, y, w):
            at = np.flatnonzero(row)
            data.append((g, at.tolist(), row[at].tolist(), int(t), int(v)))
    kind = "g INT, index ARRAY<INT>, value ARRAY<DOUBLE>, target INT, weight INT"
    return spark.createDataFrame(data, kind).repartition(5), designs, width


@pytest.mark.parametrize("features, dense", [((40,), True), ((5, 60), True), ((40, 40), False)])
@pytest.mark.parametrize("cells", [4_000_000, 70])
def test_sparse_fit_equals_dense_fit(spark, features, dense, cells, monkeypatch):
    """One wide feature needs no conjugate gradients, and steps in the common columns only."""
    from pairwright.operators import logistic

    def no_scans(*_):
        raise AssertionError("conjugate gradients")

    if dense:
        monkeypatch.setattr(logistic, "_newton_cg", no_scans)
    monkeypatch.setattr(logistic, "STATE_CELLS", cells)
    monkeypatch.setattr(logistic, "COMMON_COLUMNS", 20)
    frame, designs, width = sparse_rows(spark, features)
    fitted = logistic.fit_sparse_logistic(frame, ["g"], width)
    assert (len(fitted.columns) < 20) == dense
    got = np.zeros((2, width))
    for row in fitted.coefficients().collect():
        got[row["g"], row["index"]] += row["coefficient"]
    for g, (x, y, w) in designs.items():
        assert np.allclose(got[g], newton(x, y, w), atol=1e-6)
    scored = fitted.logit(frame.select("g", "index", "value")).collect()
    assert len(scored) == 600
    for r in scored:
        assert r["z"] == pytest.approx(float(np.dot(got[r["g"]][r["index"]], r["value"])), abs=1e-9)


def test_hot_columns_become_common(spark, monkeypatch):
    from pairwright.operators import logistic

    monkeypatch.setattr(logistic, "COMMON_ROWS", 50)
    frame, designs, width = sparse_rows(spark, (40,))
    fitted = logistic.fit_sparse_logistic(frame, ["g"], width)
    assert fitted.columns.tolist() == [0, 1, width - 1]
    got = np.zeros((2, width))
    for row in fitted.coefficients().collect():
        got[row["g"], row["index"]] += row["coefficient"]
    for g, (x, y, w) in designs.items():
        assert np.allclose(got[g], newton(x, y, w), atol=1e-6)


def test_coefficients_are_broadcast_to_their_rows(spark):
    """A few conditions with many rows each must not become a few tasks."""
    data = [(g, [float(i % 5), 1.0], i % 2, 1) for g in range(2) for i in range(40)]
    frame = spark.createDataFrame(data, "g INT, x ARRAY<DOUBLE>, target INT, weight INT")
    scored = score_logistic(frame, fit_logistic(frame, ["g"], 2), ["g"])
    plan = scored._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_narrow_features_are_broadcast_to_the_rows(spark, monkeypatch):
    """Rows are shuffled for a wide feature only; the cells are the same either way."""
    data = [(g, f"n{i % 3}" if i % 7 else None, f"w{i}", i) for g in range(2) for i in range(60)]
    frame = spark.createDataFrame(data, "g INT, nom STRING, wide STRING, row_id INT").localCheckpoint()
    new = spark.createDataFrame([(0, "n1", "w3", 900), (1, "other", "none", 901)], frame.schema)
    spec = TableSpec("t", "target", nominal=("nom", "wide"))
    found = []
    for cells in (100_000, 20):
        monkeypatch.setattr(P, "NARROW_CELLS", cells)
        work = P.Preprocessor(frame, ["g"], spec, intercept=True)
        design = work.sparse(frame.union(new), scaled=False, keep=["row_id"])
        found.append(rows(design.selectExpr("g", "row_id", "index", "value")))
        hinted = design._jdf.queryExecution().analyzed().toString().count("strategy=broadcast")
        assert hinted == (2 if cells > 60 else 1)
    assert found[0] == found[1] and len(found[0]) == 122
    assert [r[2] for r in found[0] if r[1] >= 900] == [[1, 3 + sorted(f"w{i}" for i in range(60)).index("w3"), 63], [63]]
