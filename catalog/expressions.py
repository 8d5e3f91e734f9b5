"""Column expressions and small projections over whole tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from catalog.base import SCORE_STUDY, arm_scores, query, table
from pairwright.functions import digests, keys, scores
from pairwright.functions.scores import round_half_up
from pairwright.operators import sampling as S
from pairwright.operators.grid import IDENTITY, canonical_order, condition_grid
from pairwright.study import BASELINE_LEVELS, Study


@query(
    "condition_key",
    """SELECT l_linestatus || '__' || lpad(CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR), 3, '0') || 'pct__seed_'
       || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '__' || l_returnflag AS key, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def q_key(spark, sf):
    token = keys.fraction_token(F.col("l_discount").cast("decimal(3,2)"))
    key = keys.condition_key(F.col("l_linestatus"), token, F.col("l_linenumber"), F.col("l_returnflag"))
    return table(spark, sf, "lineitem").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "fraction_token",
    """SELECT CAST(l_discount AS DECIMAL(3,2)) AS fraction, lpad(CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR), 3, '0') || 'pct' AS token,
       lpad(CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR), 3, '0') || 'pct' AS second_form, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def q_token(spark, sf):
    fraction = F.col("l_discount").cast("decimal(3,2)")
    return table(spark, sf, "lineitem").groupBy(
        fraction.alias("fraction"), keys.fraction_token(fraction).alias("token"),
        keys.percent_token(fraction).alias("second_form"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "canonical_json",
    """SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"nothing":null}' AS payload,
       sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"nothing":null}') AS digest FROM customer""",
)
def q_json(spark, sf):
    fields = {name: F.col(name) for name in ("c_name", "c_custkey", "c_nationkey", "c_mktsegment")}
    fields["nothing"] = F.lit(None).cast("string")
    return table(spark, sf, "customer").select(
        "c_custkey", digests.canonical_json(**fields).alias("payload"),
        digests.payload_digest(**fields).alias("digest"),
    )


@query(
    "order_digest",
    """SELECT o_orderkey, sha256('{"class_label":' || CAST(o_orderstatus = 'F' AS INT) || ',"dataset":"orders","namespace":"pairwright.replication-order.v1","original_source_row_index":'
       || o_orderkey || ',"retained_fraction_token":"005pct","split_seed":' || o_orderkey % 30 || '}') AS digest, TRUE AS both_forms_equal FROM orders""",
)
def q_order(spark, sf):
    label = (F.col("o_orderstatus") == "F").cast("int")
    seed, row_id = (F.col("o_orderkey") % 30).cast("int"), F.col("o_orderkey")
    namespace = SCORE_STUDY.order_namespace
    fast = digests.order_digest(namespace, F.lit("orders"), F.lit("005pct"), seed, label, row_id)
    plain = digests.payload_digest(
        namespace=F.lit(namespace), dataset=F.lit("orders"), retained_fraction_token=F.lit("005pct"),
        split_seed=seed, class_label=label, original_source_row_index=row_id,
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", fast.alias("digest"), (fast == plain).alias("both_forms_equal")
    )


@query(
    "derived_seed",
    """SELECT c_custkey, CAST(CAST('0x' || substr(sha256('{"contrast":"gaussian_minus_replication","dataset":"' || c_mktsegment || '","model":"random_forest","namespace":"pairwright.paired-bootstrap-seed.v1","resamples":'
       || '10000,"retained_fraction_token":"' || lpad(CAST(c_custkey % 101 AS VARCHAR), 3, '0') || 'pct"}'), 1, 16) AS UBIGINT) AS VARCHAR) AS bootstrap_seed FROM customer""",
)
def q_seed(spark, sf):
    fraction = (F.col("c_custkey") % 101).cast("decimal(5,2)") / 100
    seed = digests.bootstrap_seed(
        SCORE_STUDY.bootstrap_namespace, F.col("c_mktsegment"),
        keys.fraction_token(fraction.cast("decimal(3,2)")), F.lit("random_forest"),
        F.lit("gaussian_minus_replication"), 10_000,
    )
    return table(spark, sf, "customer").select("c_custkey", seed.cast("string").alias("bootstrap_seed"))


@query(
    "binarize_target",
    "SELECT event_type, CAST(value > 50 AS INT) AS target, count(*) AS n FROM events GROUP BY ALL",
)
def q_binarize(spark, sf):
    return table(spark, sf, "events").groupBy(
        "event_type", scores.binarize_target(F.col("value") - 50).alias("target")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "threshold_prediction",
    """SELECT l_linestatus, CAST(CAST((l_partkey * 7919 % 1001) / 1000.0 AS FLOAT) >= 0.5 AS INT) AS prediction, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def q_threshold(spark, sf):
    probability = ((F.col("l_partkey") * 7919 % 1001) / F.lit(1000.0)).cast("float")
    return table(spark, sf, "lineitem").groupBy(
        "l_linestatus", scores.threshold_prediction(probability).alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "interpret_interval",
    """SELECT l_suppkey, min(l_discount) - 0.02 AS ci_lower, min(l_tax) - 0.03 AS ci_upper,
       CASE WHEN min(l_discount) - 0.02 > 0.01 THEN 'helpful' WHEN min(l_tax) - 0.03 < -0.01 THEN 'harmful'
            ELSE 'no_clear_practically_meaningful_difference' END AS interpretation
       FROM (SELECT l_suppkey, l_linenumber, l_discount, l_tax FROM lineitem) GROUP BY l_suppkey, l_linenumber""",
)
def q_interpret(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(
        (F.min("l_discount") - 0.02).alias("ci_lower"), (F.min("l_tax") - 0.03).alias("ci_upper")
    )
    label = scores.interpret_interval(F.col("ci_lower"), F.col("ci_upper"))
    return rows.select("l_suppkey", "ci_lower", "ci_upper", label.alias("interpretation"))


@query(
    "archive_path",
    """SELECT l_linestatus || '/seed_' || lpad(CAST(l_orderkey % 30 AS VARCHAR), 2, '0') || '/random_forest_'
       || lpad(CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR), 3, '0') || 'pct.npz' AS path, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def q_path(spark, sf):
    path = keys.archive_path(
        F.col("l_linestatus"), F.col("l_discount").cast("decimal(3,2)"), F.col("l_orderkey") % 30,
        F.lit("random_forest"),
    )
    return table(spark, sf, "lineitem").groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "condition_grid",
    """WITH sizes AS (SELECT 'diabetes' AS dataset, count(*) AS n, 'F' AS kind FROM orders UNION ALL SELECT 'cleveland', count(*), 'L' FROM labels),
       pool AS (SELECT dataset, n - CAST(ceil(n * 0.2) AS BIGINT) AS pool FROM sizes),
       levels AS (SELECT * FROM (VALUES ('diabetes','1.00'),('diabetes','0.50'),('diabetes','0.25'),('diabetes','0.10'),('diabetes','0.05'),('diabetes','0.01'),
         ('cleveland','1.00'),('cleveland','0.50'),('cleveland','0.25'),('cleveland','0.10'),('cleveland','0.05')) t(dataset, f))
       SELECT dataset || '__' || lpad(CAST(CAST(CAST(f AS DECIMAL(3,2)) * 100 AS INT) AS VARCHAR), 3, '0') || 'pct__seed_' || lpad(CAST(s.s AS VARCHAR), 2, '0') || '__' || m.m AS key,
         CAST(s.s AS INT) AS seed, CAST(floor(pool * CAST(f AS DECIMAL(3,2)) + 0.5) AS BIGINT) AS retained_size
       FROM levels JOIN pool USING (dataset), range(0, 30) s(s), (VALUES ('logistic_regression'), ('random_forest')) m(m)""",
)
def q_grid(spark, sf):
    """The 660-condition grid with the retained size each condition has on two tables."""
    sizes = (
        table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("dataset", F.lit("diabetes"))
        .unionByName(
            table(spark, sf, "labels").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("dataset", F.lit("cleveland"))
        )
    )
    pool = sizes.select(
        "dataset",
        (F.col("n") - F.ceil(F.col("n").cast("decimal(19,0)") * F.lit(Decimal("0.2")))).alias("pool"),
    )
    grid = condition_grid(spark, Study(levels=BASELINE_LEVELS))
    size = round_half_up(F.col("pool").cast("decimal(19,0)") * F.col("retained_fraction"))
    return grid.join(F.broadcast(pool), "dataset").select(
        "key", "seed", size.cast("long").alias("retained_size")
    )


@query(
    "canonical_order",
    """WITH c AS (SELECT DISTINCT l_linestatus AS dataset, CASE WHEN l_tax < 0.04 THEN '005pct' ELSE '050pct' END AS retained_fraction_token,
         CASE WHEN l_suppkey % 2 = 0 THEN 'logistic_regression' ELSE 'random_forest' END AS model, l_orderkey % 30 AS seed FROM lineitem)
       SELECT dataset, retained_fraction_token, CAST(seed AS INT) AS seed, model,
         row_number() OVER (ORDER BY CASE dataset WHEN 'O' THEN 0 ELSE 1 END, retained_fraction_token DESC, seed, model) - 1 AS place FROM c""",
)
def q_canonical(spark, sf):
    """Conditions found in lineitem in a declared order that is not alphabetical."""
    study = Study(levels={"O": (Decimal("0.50"), Decimal("0.05")),
                          "F": (Decimal("0.50"), Decimal("0.05"))})
    found = arm_scores(spark, sf).select(*IDENTITY).distinct()
    placed = canonical_order(
        found.join(F.broadcast(condition_grid(spark, study).select(*IDENTITY, "ordinal")),
                   list(IDENTITY)), study,
    )
    return placed.select("dataset", "retained_fraction_token", "seed", "model",
                         F.col("ordinal").alias("place"))


@query(
    "allocation_gate",
    """WITH c AS (SELECT o_custkey, count(*) AS rows_all, count(DISTINCT o_orderstatus = 'F') AS classes FROM orders GROUP BY ALL)
       SELECT o_custkey, 'total_below_minimum' AS code FROM c WHERE CAST(floor(rows_all * 0.35 + 0.5) AS BIGINT) < 2 * classes""",
)
def q_allocation_gate(spark, sf):
    """Customers whose retained total cannot keep two rows of each class."""
    rows = table(spark, sf, "orders").select(
        "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("target")
    )
    totals = rows.groupBy("o_custkey").agg(
        round_half_up(F.count(F.lit(1)).cast("decimal(19,0)") * F.lit(Decimal("0.35"))).alias("total")
    )
    given = S.allocate_class_counts(
        S.class_counts(rows, ["o_custkey"]).join(totals, "o_custkey"), ["o_custkey"], "total"
    )
    return S.allocation_violations(given, ["o_custkey"], "total")
