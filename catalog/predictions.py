"""Predictions from orders: metrics, archive checks, comparison of two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import query, table
from pairwright.functions.scores import cast_prediction
from pairwright.operators import gates, metrics, reconcile
from pairwright.operators.ordering import id_bucket, ranked
from pairwright.sources.predictions import from_arrays, to_arrays

KEY = ["o_orderpriority", "half"]


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """One archive per (priority, parity of customer), in order of the order id."""
    rows = table(spark, sf, "orders").select(
        "o_orderpriority",
        (F.col("o_custkey") % 2).cast("int").alias("half"),
        F.col("o_orderkey").alias("test_index"),
        *cast_prediction(
            (F.col("o_orderstatus") == "F"), (F.col("o_orderkey") * 7919 % 10007) / F.lit(10007.0)
        ),
    )
    return ranked(rows, KEY, id_bucket(F.col("test_index")), ["test_index"], "pos")


STORED_SQL = """
ref AS (
  SELECT o_orderpriority, CAST(o_custkey % 2 AS INT) AS half, o_orderkey AS test_index,
         row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 2 ORDER BY o_orderkey) - 1 AS pos,
         CAST(o_orderstatus = 'F' AS INT) AS y_true,
         CAST((o_orderkey * 7919 % 10007) / 10007.0 AS FLOAT) AS probability
  FROM orders)"""


def rerun(spark: SparkSession, sf: str) -> DataFrame:
    """The same archives with one change in each of five: a shifted probability, a lost
    last row, a flipped label, a probability that is not a number, an infinite one."""
    rows = stored(spark, sf)
    priority, half = F.col("o_orderpriority"), F.col("half")
    first = F.col("pos") == 0
    ends = rows.groupBy(*KEY).agg(F.max("pos").alias("_last"))
    return (
        rows.join(ends, KEY)
        .filter(~((priority == "2-HIGH") & (half == 0) & (F.col("pos") == F.col("_last"))))
        .withColumn(
            "y_true",
            F.when((priority == "3-MEDIUM") & (half == 0) & first, 1 - F.col("y_true"))
            .otherwise(F.col("y_true"))
            .cast("tinyint"),
        )
        .withColumn(
            "probability",
            F.when(
                (priority == "1-URGENT") & (half == 0) & first,
                F.col("probability") + F.lit(2e-4).cast("float"),
            )
            .when((priority == "5-LOW") & (half == 1) & first, F.lit(float("nan")).cast("float"))
            .when(
                (priority == "4-NOT SPECIFIED") & (half == 1) & first,
                F.lit(float("inf")).cast("float"),
            )
            .otherwise(F.col("probability"))
            .cast("float"),
        )
        .drop("_last")
    )


RERUN_SQL = STORED_SQL + """,
cand AS (
  SELECT o_orderpriority, half, test_index, pos,
         CASE WHEN o_orderpriority = '3-MEDIUM' AND half = 0 AND pos = 0 THEN 1 - y_true ELSE y_true END AS y_true,
         CASE WHEN o_orderpriority = '1-URGENT' AND half = 0 AND pos = 0 THEN probability + CAST(2e-4 AS FLOAT)
              WHEN o_orderpriority = '5-LOW' AND half = 1 AND pos = 0 THEN CAST('nan' AS FLOAT)
              WHEN o_orderpriority = '4-NOT SPECIFIED' AND half = 1 AND pos = 0 THEN CAST('inf' AS FLOAT)
              ELSE probability END AS probability
  FROM (SELECT *, max(pos) OVER (PARTITION BY o_orderpriority, half) AS last_pos FROM ref)
  WHERE NOT (o_orderpriority = '2-HIGH' AND half = 0 AND pos = last_pos))"""


def _metric_sql(source: str, name: str) -> str:
    """All six metrics of a prediction table, per archive."""
    return f"""
{name}_scores AS (SELECT o_orderpriority, half, probability, sum(y_true) AS p1, sum(1 - y_true) AS p0 FROM {source} GROUP BY ALL),
{name}_curve AS (
  SELECT *, coalesce(sum(p0) OVER up, 0) AS below, sum(p1) OVER down AS tp, sum(p0) OVER down AS fp,
         sum(p1) OVER (PARTITION BY o_orderpriority, half) AS pos, sum(p0) OVER (PARTITION BY o_orderpriority, half) AS neg
  FROM {name}_scores
  WINDOW up AS (PARTITION BY o_orderpriority, half ORDER BY probability ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         down AS (PARTITION BY o_orderpriority, half ORDER BY probability DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name} AS (
  SELECT o_orderpriority, half, CAST(max(pos) AS BIGINT) AS positives, CAST(max(neg) AS BIGINT) AS negatives,
         CAST(sum(2 * p1 * below + p1 * p0) AS DOUBLE) / CAST(2 * max(pos) * max(neg) AS DOUBLE) AS roc_auc,
         sum(p1 * tp / (tp + fp)) / max(pos) AS average_precision,
         CAST(coalesce(sum(p1) FILTER (probability >= 0.5), 0) AS BIGINT) AS tp, CAST(coalesce(sum(p0) FILTER (probability >= 0.5), 0) AS BIGINT) AS fp
  FROM {name}_curve GROUP BY ALL),
{name}_all AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS "precision",
         CASE WHEN positives = 0 THEN 0 ELSE tp / positives END AS recall,
         CASE WHEN 2 * tp + fp + positives - tp = 0 THEN 0 ELSE (2 * tp) / (2 * tp + fp + positives - tp) END AS f1,
         (tp + negatives - fp) / (positives + negatives) AS accuracy
  FROM {name})"""


@query(
    "scan_predictions",
    f"WITH {STORED_SQL} SELECT o_orderpriority, half, pos, test_index, y_true, probability FROM ref",
)
def q_scan(spark, sf):
    """Nested archives (three parallel arrays per key and block) opened to rows."""
    nested = to_arrays(stored(spark, sf), KEY)
    return from_arrays(nested, KEY).select(
        *KEY, "pos", "test_index", F.col("y_true").cast("int").alias("y_true"), "probability"
    )


@query(
    "cast_prediction",
    """SELECT o_orderkey AS test_index, CAST(o_orderstatus = 'F' AS INT) AS y_true,
       CAST((o_orderkey * 7919 % 10007) / 10007.0 AS FLOAT) AS probability FROM orders""",
)
def q_cast(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("test_index"),
        *cast_prediction(
            (F.col("o_orderstatus") == "F"), (F.col("o_orderkey") * 7919 % 10007) / F.lit(10007.0)
        ),
    )


@query(
    "average_precision",
    f"""WITH {STORED_SQL}, {_metric_sql('ref', 'm')} SELECT o_orderpriority, half, positives, negatives,
        round(average_precision, 9) AS average_precision FROM m""",
)
def q_average_precision(spark, sf):
    rows = metrics.average_precision(stored(spark, sf), KEY)
    return rows.withColumn("average_precision", F.round("average_precision", 9))


@query(
    "threshold_metrics",
    f"""WITH {STORED_SQL}, {_metric_sql('ref', 'm')} SELECT o_orderpriority, half, positives, negatives, tp, fp,
        round("precision", 9) AS "precision", round(recall, 9) AS recall, round(f1, 9) AS f1, round(accuracy, 9) AS accuracy FROM m_all""",
)
def q_threshold(spark, sf):
    rows = metrics.threshold_metrics(stored(spark, sf), KEY)
    return rows.select(*KEY, "positives", "negatives", "tp", "fp",
                       *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query(
    "evaluate_probabilities",
    f"""WITH {STORED_SQL}, {_metric_sql('ref', 'm')} SELECT o_orderpriority, half, roc_auc,
        round("precision", 9) AS "precision", round(recall, 9) AS recall, round(f1, 9) AS f1,
        round(accuracy, 9) AS accuracy, round(average_precision, 9) AS average_precision FROM m_all""",
)
def q_evaluate(spark, sf):
    rows = metrics.evaluate(stored(spark, sf), KEY)
    return rows.select(*KEY, "roc_auc", *[F.round(c, 9).alias(c) for c in
                                          ("precision", "recall", "f1", "accuracy",
                                           "average_precision")])


@query(
    "score_running_counts",
    """WITH s AS (SELECT l_returnflag, l_linestatus, CAST(l_quantity AS FLOAT) AS score,
         CAST(sum(CAST(l_discount > 0.05 AS INT)) AS BIGINT) AS p1, CAST(sum(CAST(l_discount <= 0.05 AS INT)) AS BIGINT) AS p0
       FROM lineitem GROUP BY ALL)
       SELECT l_returnflag, l_linestatus, score, p1, p0,
         CAST(coalesce(sum(p0) OVER w, 0) AS BIGINT) AS negatives_below, CAST(coalesce(sum(p1) OVER w, 0) AS BIGINT) AS positives_below
       FROM s WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def q_running(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", F.col("l_quantity").cast("float").alias("probability"),
        (F.col("l_discount") > 0.05).cast("tinyint").alias("y_true"),
    )
    return metrics.score_curve(rows, ["l_returnflag", "l_linestatus"]).drop(
        "positives", "negatives"
    )


@query(
    "gate_predictions",
    f"""WITH {RERUN_SQL},
        broken AS (SELECT * FROM cand UNION ALL SELECT o_orderpriority, half, test_index, pos, y_true, probability FROM cand
                   WHERE o_orderpriority = '4-NOT SPECIFIED' AND half = 0 AND pos < 3),
        g AS (SELECT o_orderpriority, half, count(*) AS n, count(DISTINCT test_index) AS ids, max(pos) AS last_pos,
              sum(CAST(isnan(probability) OR isinf(probability) AS INT)) AS nan_rows FROM broken GROUP BY ALL)
        SELECT o_orderpriority, half, 'duplicate_test_index' AS code FROM g WHERE n > ids
        UNION ALL SELECT o_orderpriority, half, 'array_length_mismatch' FROM g WHERE last_pos + 1 <> n
        UNION ALL SELECT o_orderpriority, half, 'nonfinite_probability' FROM g WHERE nan_rows > 0""",
)
def q_gate_predictions(spark, sf):
    rows = rerun(spark, sf)
    again = rows.filter((F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("half") == 0)
                        & (F.col("pos") < 3))
    return gates.prediction_gate(rows.unionByName(again), KEY)


@query(
    "gate_both_classes",
    """SELECT o_custkey, CAST(sum(CAST(o_orderstatus = 'F' AS INT)) AS BIGINT) AS positives,
       CAST(sum(CAST(o_orderstatus <> 'F' AS INT)) AS BIGINT) AS negatives, 'single_class' AS code
       FROM orders GROUP BY o_custkey HAVING positives = 0 OR negatives = 0""",
)
def q_both_classes(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_custkey", (F.col("o_orderstatus") == "F").cast("tinyint").alias("y_true")
    )
    return gates.single_class_groups(rows, ["o_custkey"])


_COMPARE_SQL = f"""WITH {RERUN_SQL}, {_metric_sql('ref', 'm')}, {_metric_sql('cand', 'k')},
pairs AS (
  SELECT coalesce(r.o_orderpriority, c.o_orderpriority) AS o_orderpriority, coalesce(r.half, c.half) AS half,
         r.test_index IS NOT DISTINCT FROM c.test_index AS same_index, r.y_true IS NOT DISTINCT FROM c.y_true AS same_label,
         r.test_index IS NOT NULL AND c.test_index IS NOT NULL AS both_there,
         c.probability IS NULL OR (NOT isnan(c.probability) AND c.probability BETWEEN 0 AND 1) AS bounded,
         (c.probability IS NULL OR NOT (isnan(c.probability) OR isinf(c.probability))) AS finite,
         abs(r.probability - c.probability) AS gap, (r.probability >= 0.5) = (c.probability >= 0.5) AS same_side
  FROM ref r FULL JOIN cand c ON r.o_orderpriority = c.o_orderpriority AND r.half = c.half AND r.pos = c.pos),
g AS (
  SELECT o_orderpriority, half, bool_and(same_index) AS test_index_exact, bool_and(same_label) AS y_true_exact,
         bool_and(both_there) AS probability_shape_exact, bool_and(bounded) AS probability_finite_and_bounded,
         bool_and(both_there) AND bool_and(finite) AS ready, max(gap) AS gap, bool_and(same_side) AS same_side
  FROM pairs GROUP BY ALL),
j AS (
  SELECT g.*, ready AND probability_finite_and_bounded AS measured, abs(m.roc_auc - k.roc_auc) AS d_auc,
         abs(m.average_precision - k.average_precision) AS d_ap, abs(m."precision" - k."precision") AS d_p,
         abs(m.recall - k.recall) AS d_r, abs(m.f1 - k.f1) AS d_f, abs(m.accuracy - k.accuracy) AS d_a
  FROM g JOIN m_all m USING (o_orderpriority, half) JOIN k_all k USING (o_orderpriority, half))"""


@query(
    "compare_predictions",
    _COMPARE_SQL
    + """ SELECT o_orderpriority, half, test_index_exact, y_true_exact, probability_shape_exact, probability_finite_and_bounded,
       ready AND gap <= 1e-6 AS probability_within_tolerance, ready AND same_side AS thresholded_prediction_exact,
       CASE WHEN ready THEN gap END AS maximum_probability_difference,
       coalesce(measured AND d_auc <= 1e-12, FALSE) AS metric_roc_auc_within_tolerance,
       coalesce(measured AND d_p = 0, FALSE) AS metric_precision_within_tolerance,
       coalesce(measured AND d_r = 0, FALSE) AS metric_recall_within_tolerance,
       coalesce(measured AND d_f = 0, FALSE) AS metric_f1_within_tolerance,
       coalesce(measured AND d_a = 0, FALSE) AS metric_accuracy_within_tolerance,
       coalesce(measured AND d_ap <= 1e-12, FALSE) AS metric_average_precision_within_tolerance,
       CASE WHEN measured THEN round(d_ap, 9) END AS difference_average_precision,
       CASE WHEN test_index_exact AND y_true_exact AND probability_shape_exact AND probability_finite_and_bounded AND ready AND gap <= 1e-6
            AND same_side AND d_auc <= 1e-12 AND d_ap <= 1e-12 AND d_p = 0 AND d_r = 0 AND d_f = 0 AND d_a = 0
            THEN 'pass' ELSE 'fail' END AS status FROM j""",
)
def q_compare(spark, sf):
    rows = reconcile.compare_predictions(stored(spark, sf), rerun(spark, sf), KEY)
    return rows.select(
        *KEY, "test_index_exact", "y_true_exact", "probability_shape_exact",
        "probability_finite_and_bounded", "probability_within_tolerance",
        "thresholded_prediction_exact", "maximum_probability_difference",
        *[f"metric_{m}_within_tolerance" for m in metrics.METRICS],
        F.round("difference_average_precision", 9).alias("difference_average_precision"), "status",
    )


@query(
    "compare_split_identity",
    _COMPARE_SQL
    + """ SELECT o_orderpriority, half, test_index_exact, y_true_exact,
       CASE WHEN test_index_exact AND y_true_exact THEN 'pass' ELSE 'fail' END AS status FROM g""",
)
def q_split_identity(spark, sf):
    return reconcile.compare_split_identity(stored(spark, sf), rerun(spark, sf), KEY)
