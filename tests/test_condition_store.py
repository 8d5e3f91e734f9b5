from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_models import SPEC, table

from pairwright.operators import gates
from pairwright.operators.metrics import roc_auc
from pairwright.plans.condition_store import KEY, ConditionStore, run_pending
from pairwright.plans.grid_run import GridRun
from pairwright.study import FOREST, LOGISTIC, Study, decimals

STUDY = Study(levels={"toy": decimals("0.25", "0.50")}, seeds=(0, 29))


class Killed(BaseException):
    pass


def test_a_killed_run_resumes_without_repeats(spark, tmp_path):
    store = ConditionStore(spark, str(tmp_path / "store"))
    calls = []

    def until_killed(run: GridRun):
        if len(calls) == 2:
            raise Killed
        calls.append((run.arms, run.study.seeds))
        return run.predictions()

    with pytest.raises(Killed):
        run_pending(table(spark), SPEC, STUDY, store, trees=3, execute=until_killed)
    assert store.ledger().count() == 8 and store.predictions().select("key", "arm").distinct().count() == 8
    store.log.stage({"ledger": store.ledger(), "predictions": store.predictions()})  # died before its commit
    assert run_pending(table(spark), SPEC, STUDY, store, trees=3) == 8
    assert run_pending(table(spark), SPEC, STUDY, store, trees=3) == 0
    ledger = store.ledger()
    assert ledger.count() == 16 and ledger.select(*KEY).distinct().count() == 16
    assert rows(ledger.select("terminal_state").distinct()) == [("success",)]
    got = store.predictions()
    assert got.count() == 16 * 16 and got.select("key", "arm", "pos").distinct().count() == 16 * 16
    whole = GridRun(table(spark), SPEC, STUDY, trees=3).predictions()
    want = rows(roc_auc(whole, ["key", "arm"]), "key", "arm", "roc_auc")
    assert rows(roc_auc(got, ["key", "arm"]), "key", "arm", "roc_auc") == want


def test_a_published_condition_is_refused_and_failures_are_terminal(spark, tmp_path):
    study = Study(levels={"toy": decimals("0.50")}, seeds=(0,), models=(LOGISTIC,))
    store = ConditionStore(spark, str(tmp_path / "store"))

    def broken(run: GridRun):
        raise ValueError("no luck")

    assert run_pending(table(spark), SPEC, study, store, arms=["real_only"], execute=broken, catch=(ValueError,)) == 1
    row = store.ledger().first()
    assert (row["terminal_state"], row["error"]["type"]) == ("failure", "ValueError")
    assert store.predictions().isEmpty() and store.pending(study, ["real_only"]).isEmpty()
    pending = store.pending(study, ["replication"])
    found = GridRun(table(spark), SPEC, study, arms=("replication",)).predictions()
    store.publish(pending, found, 1.0)
    key = store.ledger().filter("run = 'replication'").first()["key"]
    again = spark.createDataFrame([("replication", key)], "run STRING, key STRING")
    with pytest.raises(gates.GateError, match="already_terminal"):
        store.publish(again, found, 1.0)
    assert store.ledger().count() == 2


def test_models_of_a_caller(spark, tmp_path):
    """A registry entry and one condition a commit."""

    def majority(run: GridRun):
        return run.logistic().withColumns(
            {"model": F.lit("majority"), "key": F.replace("key", F.lit(LOGISTIC), F.lit("majority")),
             "probability": F.lit(0.5).cast("float")}
        )

    study = Study(levels={"toy": decimals("0.50")}, seeds=(0, 1), models=("majority", FOREST))
    store = ConditionStore(spark, str(tmp_path / "store"))
    done = run_pending(table(spark), SPEC, study, store, arms=["replication"], together=("run", "key"), trees=3,
                       registry={"majority": majority})
    assert done == 4 and store.log.versions() == 4
    auc = {r["key"]: r["roc_auc"] for r in roc_auc(store.predictions(), ["key"]).collect()}
    assert [v for k, v in auc.items() if "majority" in k] == [0.5, 0.5]
    with pytest.raises(ValueError, match="no function"):
        GridRun(table(spark), SPEC, study).predictions()
