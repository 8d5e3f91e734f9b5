"""Run ledgers from events: each 540 consecutive events are one run of the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import EVENTS_SQL, RUNS_SQL, events_on_grid, query, runs
from pairwright.operators import gates, reconcile
from pairwright.operators import ledger as L

RUN_KEY = ["run", "key"]


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """error -> failure, signup -> timeout, the rest -> success."""
    event = F.col("event_id").cast("string")
    state = (
        F.when(F.col("event_type") == "error", "failure")
        .when(F.col("event_type") == "signup", "timeout")
        .otherwise("success")
    )
    digest = F.sha2(event, 256)
    return events_on_grid(spark, sf).select(
        "run", "ordinal", "key", "event_id", "user_id",
        *L.ledger_row(
            state,
            F.col("value"),
            F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")),
            artifact=(F.concat("key", F.lit(".npz")), F.col("event_id"), digest),
            error=(F.lit("ValueError"), digest, digest),
            warnings=F.slice(F.array(F.lit("slow"), F.lit("late")), 1,
                             (F.col("user_id") % 3).cast("int")),
            rss_bytes=F.col("event_id") * 1024,
        ),
    )


STATE_SQL = "CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'timeout' ELSE 'success' END"
LEDGER_SQL = EVENTS_SQL + f""",
ledger AS (SELECT run, ordinal, key, event_id, user_id, value, {STATE_SQL} AS state FROM on_grid)"""

REPORT_SQL = LEDGER_SQL + """,
report AS (
  SELECT run, count(*) AS terminal_key_count, count(*) FILTER (state = 'success') AS successful_key_count,
    count(*) FILTER (state = 'failure') AS failure_key_count, count(*) FILTER (state = 'timeout') AS timeout_key_count,
    round(sum(value), 6) AS summed_condition_seconds, max(value) AS maximum_condition_seconds,
    coalesce(max(event_id * 1024) FILTER (state = 'success'), 0) AS maximum_observed_rss_bytes,
    CAST(coalesce(sum(user_id % 3) FILTER (state = 'success'), 0) AS BIGINT) AS warning_count,
    count(*) + count(*) FILTER (state = 'success') AS condition_output_file_count,
    CAST(coalesce(sum(event_id) FILTER (state = 'success'), 0) AS BIGINT) AS condition_output_bytes,
    coalesce(string_agg(key, ',' ORDER BY ordinal) FILTER (state = 'failure'), '') AS failure_keys,
    coalesce(string_agg(key, ',' ORDER BY ordinal) FILTER (state = 'timeout'), '') AS timeout_keys,
    540 AS expected_key_count,
    CASE WHEN count(*) = 540 AND count(*) FILTER (state = 'success') = 540 THEN 'pass' ELSE 'fail' END AS status
  FROM ledger GROUP BY run)"""


@query("run_report", f"WITH {REPORT_SQL} SELECT * FROM report")
def q_run_report(spark, sf):
    rows = L.run_report(ledger(spark, sf), ["run"], 540)
    return (
        rows.withColumn("summed_condition_seconds", F.round("summed_condition_seconds", 6))
        .withColumn("failure_keys", F.array_join("failure_keys", ","))
        .withColumn("timeout_keys", F.array_join("timeout_keys", ","))
    )


@query(
    "report_consistency",
    f"""WITH {REPORT_SQL} SELECT run, 'successful_key_count_changed' AS code FROM report WHERE run % 3 = 0
        UNION ALL SELECT run, 'failure_keys_changed' FROM report WHERE run % 4 = 1
        UNION ALL SELECT run, 'status_changed' FROM report WHERE run % 5 = 2""",
)
def q_consistency(spark, sf):
    """Stored reports with a raised count, a reversed list or a false pass."""
    rows = ledger(spark, sf)
    run = F.col("run")
    stored = (
        L.run_report(rows, ["run"], 540)
        .withColumn("successful_key_count",
                    F.col("successful_key_count") + F.when(run % 3 == 0, 1).otherwise(0))
        .withColumn("failure_keys",
                    F.when(run % 4 == 1, F.reverse("failure_keys")).otherwise(F.col("failure_keys")))
        .withColumn("status", F.when(run % 5 == 2, "pass").otherwise(F.col("status")))
    )
    return L.report_violations(stored, rows, ["run"], 540)


@query(
    "gate_ledger",
    f"""WITH {LEDGER_SQL}, m AS (SELECT *, user_id % 23 = 0 AS late, user_id % 31 = 0 AS bad, user_id % 37 = 0 AS negative FROM ledger)
        SELECT run, key, 'completed_at_without_zone' AS code FROM m WHERE late
        UNION ALL SELECT run, key, 'elapsed_invalid' FROM m WHERE negative
        UNION ALL SELECT run, key, 'artifact_mismatch' FROM m WHERE bad AND state = 'success'
        UNION ALL SELECT run, key, 'failure_error_invalid' FROM m WHERE bad AND state = 'failure'
        UNION ALL SELECT run, key, 'timeout_error_invalid' FROM m WHERE bad AND state = 'timeout'""",
)
def q_gate(spark, sf):
    """Terminal rows with faults by user: no zone, negative time, broken digests."""
    user = F.col("user_id")
    bad = user % 31 == 0
    rows = (
        ledger(spark, sf)
        .withColumn("completed_at", F.when(user % 23 == 0, F.substring("completed_at", 1, 19))
                    .otherwise(F.col("completed_at")))
        .withColumn("elapsed_seconds", F.when(user % 37 == 0, -1.0)
                    .otherwise(F.col("elapsed_seconds")))
        .withColumn("artifact", F.when(bad & F.col("artifact").isNotNull(),
                    F.col("artifact").withField("sha256", F.lit("none")))
                    .otherwise(F.col("artifact")))
        .withColumn("error", F.when(bad & F.col("error").isNotNull(),
                    F.col("error").withField("type", F.lit("")).withField("reason", F.lit("other")))
                    .otherwise(F.col("error")))
    )
    return gates.ledger_gate(rows, RUN_KEY)


@query(
    "pending_conditions",
    f"WITH {LEDGER_SQL}, {RUNS_SQL} SELECT run, key FROM runs EXCEPT SELECT run, key FROM ledger WHERE state <> 'timeout'",
)
def q_pending(spark, sf):
    """What each run still has to do: keys without a row, and those that timed out."""
    done = ledger(spark, sf).filter("terminal_state <> 'timeout'")
    return L.pending_conditions(runs(spark, sf), done, RUN_KEY).select(*RUN_KEY)


_ORIGIN = f"""WITH {LEDGER_SQL}, {RUNS_SQL},
pilot AS (SELECT key FROM grid WHERE seed IN (0, 29) AND (dataset, retained_fraction_token) IN (('diabetes', '001pct'), ('diabetes', '050pct'), ('cleveland', '005pct'))),
origins AS (SELECT r.run, r.key, CASE WHEN p.key IS NOT NULL THEN 'reused' WHEN l.key IS NOT NULL THEN 'resumed' ELSE 'executed' END AS origin
  FROM runs r LEFT JOIN pilot p ON r.key = p.key LEFT JOIN (SELECT run, key FROM ledger WHERE state = 'success') l ON r.run = l.run AND r.key = l.key)"""


def _origins(spark, sf):
    from pairwright.operators.grid import condition_grid
    from pairwright.study import pilot_study

    expected = runs(spark, sf).select(*RUN_KEY)
    pilot = condition_grid(spark, pilot_study()).select("key")
    reused = expected.join(F.broadcast(pilot), "key", "left_semi")
    return L.classify_origin(
        expected, reused, ledger(spark, sf).filter("terminal_state = 'success'"), RUN_KEY
    )


@query("classify_origin", _ORIGIN + " SELECT run, key, origin FROM origins")
def q_origin(spark, sf):
    return _origins(spark, sf)


@query(
    "origin_accounting",
    _ORIGIN + " SELECT run, key, 'in_no_list' AS code FROM origins WHERE origin = 'executed' AND run % 2 = 0",
)
def q_origin_accounting(spark, sf):
    """Origin lists of which the even runs lost the executed keys."""
    lost = (F.col("origin") == "executed") & (F.col("run") % 2 == 0)
    return reconcile.disjoint_cover(_origins(spark, sf).filter(~lost), runs(spark, sf), RUN_KEY)


@query(
    "eligible_reuse",
    f"""WITH {LEDGER_SQL} SELECT event_id // 12 AS block, count(*) AS keys, bool_and(state = 'success') AS all_success,
        TRUE AS unique_keys, bool_and(seed_ok) AS inside_grid, bool_and(state = 'success') AND bool_and(seed_ok) AS eligible
        FROM (SELECT *, key NOT LIKE '%seed_29%' AS seed_ok FROM ledger) GROUP BY ALL""",
)
def q_reuse(spark, sf):
    """Blocks of twelve rows as earlier runs, against a grid without the last seed."""
    from pairwright.operators.grid import condition_grid
    from pairwright.study import SCARCITY_LEVELS, Study

    grid = condition_grid(spark, Study(levels=SCARCITY_LEVELS, seeds=tuple(range(29))))
    rows = ledger(spark, sf).withColumn("block", F.floor(F.col("event_id") / 12).cast("long"))
    return L.reuse_by_run(rows, ["block"], grid)


_ARTIFACTS = f"""WITH {LEDGER_SQL}, {RUNS_SQL},
files AS (
  SELECT run, key, event_id + CASE WHEN user_id % 41 = 0 THEN 1 ELSE 0 END AS bytes FROM ledger
  WHERE (state = 'success' AND user_id % 29 <> 0) OR (state = 'failure' AND user_id % 13 = 0)),
rows_kept AS (SELECT * FROM ledger WHERE user_id % 47 <> 0),
j AS (
  SELECT coalesce(r.run, l.run, f.run) AS run, coalesce(r.key, l.key, f.key) AS key, r.key IS NOT NULL AS in_grid,
         l.key IS NOT NULL AS in_ledger, coalesce(l.state = 'success', FALSE) AS success, f.key IS NOT NULL AS in_files,
         l.event_id AS lb, f.bytes AS fb
  FROM runs r FULL JOIN rows_kept l ON r.run = l.run AND r.key = l.key FULL JOIN files f ON f.run = r.run AND f.key = r.key),
findings AS (
  SELECT run, key, 'missing_checkpoint_artifacts' AS code FROM j WHERE in_grid AND NOT in_ledger
  UNION ALL SELECT run, key, 'unexpected_prediction_artifacts' FROM j WHERE in_files AND NOT success
  UNION ALL SELECT run, key, 'missing_prediction_artifacts' FROM j WHERE success AND NOT in_files
  UNION ALL SELECT run, key, 'orphan_prediction_artifacts' FROM j WHERE in_files AND NOT success
  UNION ALL SELECT run, key, 'mismatched_artifacts' FROM j WHERE success AND in_files AND lb <> fb)"""


def _artifacts(spark, sf):
    rows = ledger(spark, sf)
    user, state = F.col("user_id"), F.col("terminal_state")
    files = rows.filter(
        ((state == "success") & (user % 29 != 0)) | ((state == "failure") & (user % 13 == 0))
    ).select(
        *RUN_KEY,
        (F.col("event_id") + F.when(user % 41 == 0, 1).otherwise(0)).alias("bytes"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("sha256"),
    )
    kept = rows.filter(user % 47 != 0)
    return kept, L.reconcile_artifacts(runs(spark, sf).select(*RUN_KEY), kept, files, RUN_KEY)


@query("reconcile_artifacts", _ARTIFACTS + " SELECT run, key, code FROM findings")
def q_artifacts(spark, sf):
    return _artifacts(spark, sf)[1]


@query(
    "analysis_gate",
    _ARTIFACTS
    + """, t AS (SELECT run, count(*) AS terminal_key_count, count(*) FILTER (state = 'success') AS successful_key_count FROM rows_kept GROUP BY run),
       n AS (SELECT run, count(*) AS findings FROM findings GROUP BY run)
       SELECT run, terminal_key_count, successful_key_count, coalesce(findings, 0) AS findings,
         terminal_key_count = 540 AND successful_key_count = 540 AND coalesce(findings, 0) = 0 AS may_start FROM t LEFT JOIN n USING (run)""",
)
def q_analysis_gate(spark, sf):
    kept, findings = _artifacts(spark, sf)
    return L.analysis_gate(L.run_report(kept, ["run"], 540, key_lists=False), findings, ["run"], 540)
