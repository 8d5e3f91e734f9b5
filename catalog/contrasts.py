"""Arms, paired differences and bootstrap intervals over lineitem scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import KEY_SQL, KEYS, SCORE_STUDY, SCORES_SQL, arm_scores, query, with_key
from pairwright.operators import contrast as C
from pairwright.operators.grid import STRATUM, condition_grid
from pairwright.operators.metrics import roc_auc
from pairwright.operators.ordering import settle
from pairwright.plans import report
from pairwright.plans.analysis import analyze

BY = [*STRATUM, "contrast"]


def metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    """AUC of every condition and arm: one pass over the scores, a table of grid size."""
    return settle(roc_auc(arm_scores(spark, sf), [*KEYS, "arm"]))


def arms(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    metrics = metric_rows(spark, sf)
    return {
        name: with_key(metrics.filter(F.col("arm") == name))
        for name in ("replication", "gaussian", "real_only")
    }


def joined_arms(spark: SparkSession, sf: str) -> DataFrame:
    return C.arm_join(arms(spark, sf), KEYS)


def differences(spark: SparkSession, sf: str) -> DataFrame:
    return C.paired_differences(joined_arms(spark, sf), KEYS, SCORE_STUDY.contrasts)


JOIN_SQL = SCORES_SQL + """,
joined AS (
  SELECT r.dataset, r.retained_fraction, r.retained_fraction_token, r.seed, r.model,
         r.roc_auc AS replication, g.roc_auc AS gaussian, b.roc_auc AS real_only
  FROM (FROM auc WHERE arm = 'replication') r
  JOIN (FROM auc WHERE arm = 'gaussian') g USING (dataset, retained_fraction_token, seed, model)
  JOIN (FROM auc WHERE arm = 'real_only') b USING (dataset, retained_fraction_token, seed, model))"""

DIFF_SQL = JOIN_SQL + """,
diffs AS (
  SELECT dataset, retained_fraction, retained_fraction_token, seed, model, 'gaussian_minus_replication' AS contrast, gaussian - replication AS difference FROM joined
  UNION ALL
  SELECT dataset, retained_fraction, retained_fraction_token, seed, model, 'replication_minus_real_only', replication - real_only FROM joined
  UNION ALL
  SELECT dataset, retained_fraction, retained_fraction_token, seed, model, 'gaussian_minus_real_only', gaussian - real_only FROM joined)"""

SEED_SQL = """CAST(CAST('0x' || substr(sha256('{"contrast":"' || contrast || '","dataset":"' || dataset || '","model":"' || model
  || '","namespace":"pairwright.paired-bootstrap-seed.v1","resamples":10000,"retained_fraction_token":"' || retained_fraction_token || '"}'), 1, 16) AS UBIGINT) AS VARCHAR)"""

BOOT_SQL = DIFF_SQL + f""",
pairs AS (
  SELECT dataset, retained_fraction, retained_fraction_token, model, contrast,
         list(difference ORDER BY seed) AS d, avg(difference) AS estimate, count(*) AS pairs
  FROM diffs GROUP BY ALL),
seeded AS (SELECT *, {SEED_SQL} AS bootstrap_seed FROM pairs),
draws AS (
  SELECT dataset, retained_fraction_token, model, contrast, b, block, d, pairs,
         sha256(bootstrap_seed || '|' || b || '|' || block) AS h
  FROM seeded, range(0, 10000) t(b), range(0, 4) u(block)),
means AS (
  SELECT dataset, retained_fraction_token, model, contrast, b,
         sum(list_extract(d, CAST(CAST('0x' || substr(h, CAST(8 * k + 1 AS BIGINT), 8) AS BIGINT) % pairs AS BIGINT) + 1)) / max(pairs) AS mean
  FROM draws, range(0, 8) v(k) WHERE block * 8 + k < pairs
  GROUP BY ALL),
ends AS (
  SELECT dataset, retained_fraction_token, model, contrast,
         quantile_cont(mean, 0.025) AS ci_lower, quantile_cont(mean, 0.975) AS ci_upper
  FROM means GROUP BY ALL),
summary AS (
  SELECT s.dataset, s.retained_fraction, s.retained_fraction_token, s.model, s.contrast, pairs, estimate,
         ci_lower, ci_upper, bootstrap_seed,
         CASE WHEN ci_lower > 0.01 THEN 'helpful' WHEN ci_upper < -0.01 THEN 'harmful'
              ELSE 'no_clear_practically_meaningful_difference' END AS interpretation
  FROM seeded s JOIN ends e USING (dataset, retained_fraction_token, model, contrast))"""


def summary(spark: SparkSession, sf: str) -> DataFrame:
    return C.stratum_summaries(differences(spark, sf), SCORE_STUDY)


@query(
    "roc_auc",
    f"WITH {SCORES_SQL} SELECT dataset, retained_fraction_token, model, seed, arm, positives, negatives, roc_auc FROM auc",
)
def q_roc_auc(spark, sf):
    return roc_auc(arm_scores(spark, sf), [*KEYS, "arm"]).drop("retained_fraction")


@query(
    "three_arm_join",
    f"WITH {JOIN_SQL} SELECT {KEY_SQL} AS key, replication, gaussian, real_only FROM joined",
)
def q_three_arm_join(spark, sf):
    return with_key(joined_arms(spark, sf)).select("key", "replication", "gaussian", "real_only")


@query(
    "restrict_to_grid",
    f"WITH {SCORES_SQL} SELECT {KEY_SQL} AS key, roc_auc FROM auc WHERE arm = 'real_only' AND retained_fraction = 0.05",
)
def q_restrict(spark, sf):
    from pairwright.study import Study, decimals

    part = Study(levels={"F": decimals("0.05"), "O": decimals("0.05")})
    rows = arms(spark, sf)["real_only"]
    return C.restrict_to_grid(rows, condition_grid(spark, part), ["key"]).select("key", "roc_auc")


@query(
    "paired_differences",
    f"WITH {DIFF_SQL} SELECT {KEY_SQL} AS key, contrast, difference FROM diffs",
)
def q_differences(spark, sf):
    return with_key(differences(spark, sf)).select("key", "contrast", "difference")


@query(
    "mean_difference",
    f"""WITH {DIFF_SQL} SELECT dataset, retained_fraction_token, model, contrast, count(*) AS pairs,
        round(avg(difference), 9) AS estimate FROM diffs GROUP BY ALL""",
)
def q_mean(spark, sf):
    rows = C.mean_difference(differences(spark, sf), STRATUM)
    return rows.select("dataset", "retained_fraction_token", "model", "contrast", "pairs",
                       F.round("estimate", 9).alias("estimate"))


@query(
    "paired_bootstrap_ci",
    f"""WITH {BOOT_SQL} SELECT dataset, retained_fraction_token, model, contrast, pairs,
        round(estimate, 9) AS estimate, round(ci_lower, 9) AS ci_lower, round(ci_upper, 9) AS ci_upper,
        bootstrap_seed, interpretation FROM summary""",
)
def q_bootstrap(spark, sf):
    return rounded(summary(spark, sf))


def rounded(rows: DataFrame) -> DataFrame:
    return rows.select(
        "dataset", "retained_fraction_token", "model", "contrast",
        F.col("pairs").cast("long").alias("pairs"),
        *[F.round(c, 9).alias(c) for c in ("estimate", "ci_lower", "ci_upper")],
        F.col("bootstrap_seed").cast("string").alias("bootstrap_seed"),
        "interpretation",
    )


@query(
    "interpretation_counts",
    f"""WITH {BOOT_SQL} SELECT contrast, count(*) FILTER (interpretation = 'harmful') AS harmful,
        count(*) FILTER (interpretation = 'no_clear_practically_meaningful_difference') AS no_clear_practically_meaningful_difference,
        count(*) FILTER (interpretation = 'helpful') AS helpful FROM summary GROUP BY ALL""",
)
def q_interpretations(spark, sf):
    return C.interpretation_counts(summary(spark, sf))


@query(
    "finding_counts",
    f"""WITH {BOOT_SQL} SELECT contrast, count(*) AS strata, count(*) FILTER (estimate < 0) AS negative_estimates,
        count(*) FILTER (ci_upper < 0) AS intervals_below_zero FROM summary GROUP BY ALL""",
)
def q_findings(spark, sf):
    return C.finding_counts(summary(spark, sf))


@query(
    "accounting",
    f"""WITH {SCORES_SQL}, k AS (SELECT *, {KEY_SQL} AS key FROM auc),
        s AS (SELECT count(DISTINCT seed) AS n FROM k WHERE arm = 'replication' GROUP BY dataset, retained_fraction_token, model)
        SELECT count(DISTINCT key) FILTER (arm = 'replication') AS replication_keys,
        count(DISTINCT key) FILTER (arm = 'gaussian') AS gaussian_keys,
        count(DISTINCT key) FILTER (arm = 'real_only') AS baseline_source_keys,
        count(DISTINCT key) FILTER (arm = 'real_only') AS baseline_matched_keys,
        (SELECT count(*) FROM s) AS strata, (SELECT min(n) FROM s) AS paired_seeds_per_stratum FROM k""",
)
def q_accounting(spark, sf):
    sides = arms(spark, sf)
    return C.accounting(sides["replication"], sides["gaussian"], sides["real_only"],
                        condition_grid(spark, SCORE_STUDY))


@query(
    "forest_plot_rows",
    f"""WITH {BOOT_SQL} SELECT upper(dataset[1]) || lower(dataset[2:]) || ' · ' || CASE retained_fraction_token WHEN '005pct' THEN '5%' ELSE '50%' END
        || ' · ' || CASE model WHEN 'logistic_regression' THEN 'Logistic Regression' ELSE 'Random Forest' END AS label,
        round(estimate, 9) AS estimate, round(estimate - ci_lower, 9) AS lower_error,
        round(ci_upper - estimate, 9) AS upper_error, interpretation
        FROM summary WHERE contrast = 'gaussian_minus_replication'""",
)
def q_forest_rows(spark, sf):
    rows = report.forest_plot_rows(summary(spark, sf), "gaussian_minus_replication")
    return rows.select("label", *[F.round(c, 9).alias(c) for c in
                                  ("estimate", "lower_error", "upper_error")], "interpretation")


@query(
    "public_table",
    f"""WITH {BOOT_SQL} SELECT dataset AS "Dataset", CASE retained_fraction_token WHEN '005pct' THEN '5%' ELSE '50%' END AS "Retained fraction",
        CASE model WHEN 'logistic_regression' THEN 'Logistic Regression' ELSE 'Random Forest' END AS "Model",
        pairs AS "Paired seeds", format('{{:.4f}}', estimate) AS "Estimate", format('{{:.4f}}', ci_lower) AS "CI lower",
        format('{{:.4f}}', ci_upper) AS "CI upper",
        CASE interpretation WHEN 'helpful' THEN 'Helpful' WHEN 'harmful' THEN 'Harmful'
             ELSE 'No clear practically meaningful difference' END AS "Interpretation"
        FROM summary WHERE contrast = 'gaussian_minus_replication'""",
)
def q_public_table(spark, sf):
    return report.public_table(summary(spark, sf), "gaussian_minus_replication")


@query(
    "analyze_arms",
    f"""WITH {BOOT_SQL} SELECT dataset, retained_fraction_token, model, contrast, pairs,
        round(estimate, 9) AS estimate, round(ci_lower, 9) AS ci_lower, round(ci_upper, 9) AS ci_upper,
        bootstrap_seed, interpretation FROM summary""",
)
def q_analyze(spark, sf):
    """The whole analysis: gates, reconciliation, join, bootstrap, gate on the output."""
    sides = arms(spark, sf)
    return rounded(analyze(spark, sides, SCORE_STUDY))


@query(
    "summary_documents",
    f"""WITH {BOOT_SQL} SELECT dataset, retained_fraction_token, model, max(pairs) AS paired_seed_count, count(*) AS contrast_count,
        round(max(estimate) FILTER (contrast = 'gaussian_minus_replication'), 9) AS primary_estimate
        FROM summary GROUP BY ALL""",
)
def q_documents(spark, sf):
    from pairwright.sources.documents import nested_summary

    nested = nested_summary(summary(spark, sf))
    return nested.select(
        "dataset", "retained_fraction_token", "model",
        F.col("paired_seed_count").cast("long").alias("paired_seed_count"),
        F.size("contrasts").cast("long").alias("contrast_count"),
        F.round(F.col("contrasts")["gaussian_minus_replication"]["estimate"], 9).alias(
            "primary_estimate"
        ),
    )
