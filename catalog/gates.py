"""Reconciliation and quality gates over whole tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import (
    digest_sql,
    DIRTY_SQL,
    KEY_SQL,
    RUNS_SQL,
    SCORE_STUDY,
    SCORES_SQL,
    dirty_metrics,
    query,
    runs,
    table,
)
from catalog.contrasts import BOOT_SQL, metric_rows, summary, with_key
from pairwright.operators import gates, reconcile
from pairwright.operators.grid import condition_grid, key_set_digest
from pairwright.study import Study, scarcity_study

KEYS = ["run", "key"]

_COUNTS = f"""WITH {DIRTY_SQL}, {RUNS_SQL},
e AS (SELECT run, key, count(*) AS n_expected FROM runs GROUP BY ALL),
o AS (SELECT run, key, count(*) AS n_observed FROM dirty GROUP BY ALL),
r AS (SELECT run, key, coalesce(n_expected, 0) AS n_expected, coalesce(n_observed, 0) AS n_observed,
      CASE WHEN n_observed IS NULL THEN 'missing' WHEN n_expected IS NULL THEN 'unexpected'
           WHEN n_observed > n_expected THEN 'duplicate' ELSE 'ok' END AS status
      FROM e FULL JOIN o USING (run, key))"""


@query("reconcile_keys", _COUNTS + " SELECT run, key, n_expected, n_observed, status FROM r WHERE status <> 'ok'")
def q_reconcile(spark, sf):
    rows = reconcile.reconcile_keys(runs(spark, sf), dirty_metrics(spark, sf), KEYS)
    return rows.filter("status != 'ok'")


@query(
    "reconciliation_report",
    _COUNTS
    + """ SELECT run, CAST(sum(n_expected) AS BIGINT) AS expected_rows, CAST(sum(n_observed) AS BIGINT) AS observed_rows,
       count(*) FILTER (status = 'missing') AS missing_keys, count(*) FILTER (status = 'unexpected') AS unexpected_keys,
       count(*) FILTER (status = 'duplicate') AS duplicate_keys, bool_and(status = 'ok') AS clean FROM r GROUP BY run""",
)
def q_report(spark, sf):
    rows = reconcile.reconcile_keys(runs(spark, sf), dirty_metrics(spark, sf), KEYS)
    return reconcile.reconciliation_report(rows, ["run"])


@query("missing_keys", _COUNTS + " SELECT run, key FROM r WHERE status = 'missing'")
def q_missing(spark, sf):
    return reconcile.missing_keys(runs(spark, sf), dirty_metrics(spark, sf), KEYS)


@query("unexpected_keys", _COUNTS + " SELECT run, key FROM r WHERE status = 'unexpected'")
def q_unexpected(spark, sf):
    return reconcile.unexpected_keys(runs(spark, sf), dirty_metrics(spark, sf), KEYS)


@query("duplicate_keys", _COUNTS + " SELECT run, key, n_observed AS n FROM r WHERE n_observed > 1")
def q_duplicates(spark, sf):
    return reconcile.duplicate_keys(dirty_metrics(spark, sf), KEYS)


@query("key_difference", _COUNTS + " SELECT run, key FROM runs EXCEPT SELECT run, key FROM dirty")
def q_difference(spark, sf):
    return reconcile.key_difference(runs(spark, sf), dirty_metrics(spark, sf), KEYS)


@query("key_intersection", _COUNTS + " SELECT run, key FROM runs INTERSECT SELECT run, key FROM dirty")
def q_intersection(spark, sf):
    return reconcile.key_intersection(runs(spark, sf), dirty_metrics(spark, sf), KEYS)


@query(
    "subset_test",
    """SELECT c.c_mktsegment, bool_and(o.o_custkey IS NOT NULL) AS is_subset, count(*) FILTER (o.o_custkey IS NULL) AS outside
       FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON c.c_custkey = o.o_custkey GROUP BY ALL""",
)
def q_subset(spark, sf):
    """Per segment: do all customers occur among the orders?"""
    customers = table(spark, sf, "customer").select("c_mktsegment", "c_custkey")
    buyers = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    outside = reconcile.missing_keys(customers, buyers, ["c_custkey"]).withColumn(
        "_out", F.lit(True)
    )
    return customers.join(outside, "c_custkey", "left").groupBy("c_mktsegment").agg(
        F.every(F.col("_out").isNull()).alias("is_subset"), F.count("_out").alias("outside")
    )


@query(
    "disjoint_cover",
    """WITH l AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')
               UNION ALL SELECT DISTINCT c_custkey, 'machinery' FROM customer WHERE c_mktsegment = 'MACHINERY'),
       n AS (SELECT o_custkey, count(*) AS k FROM l GROUP BY ALL)
       SELECT coalesce(o_custkey, c_custkey) AS c_custkey,
         CASE WHEN k IS NULL THEN 'in_no_list' WHEN c_custkey IS NULL THEN 'not_expected' ELSE 'in_several_lists' END AS code
       FROM n FULL JOIN customer ON o_custkey = c_custkey WHERE k IS NULL OR k > 1 OR c_custkey IS NULL""",
)
def q_cover(spark, sf):
    """Three lists of customers against all customers."""
    orders = table(spark, sf, "orders")
    buyers = orders.filter(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("list")
    ).distinct()
    customers = table(spark, sf, "customer")
    machinery = customers.filter("c_mktsegment = 'MACHINERY'").select(
        "c_custkey", F.lit("machinery").alias("list")
    ).distinct()
    return reconcile.disjoint_cover(buyers.unionByName(machinery), customers, ["c_custkey"])


@query(
    "scan_metric_keys",
    f"""WITH {SCORES_SQL} SELECT arm, count(DISTINCT {KEY_SQL}) AS condition_count,
        sha256(string_agg({KEY_SQL}, chr(10) ORDER BY {KEY_SQL}) || chr(10)) AS condition_keys_sha256 FROM auc GROUP BY arm""",
)
def q_metric_keys(spark, sf):
    """Keys of the metric tables and their digest; no metric is read."""
    from catalog.base import arm_scores

    keys = with_key(
        arm_scores(spark, sf)
        .select("dataset", "retained_fraction_token", "seed", "model", "arm")
        .distinct()
    ).select("arm", "key")
    counted = keys.groupBy("arm").agg(F.count_distinct("key").alias("condition_count"))
    return counted.join(key_set_digest(keys, ["arm"], name="condition_keys_sha256"), "arm")


@query(
    "gate_metric_range",
    f"""WITH {DIRTY_SQL} SELECT key, CASE WHEN isnan(roc_auc) THEN 'metric_not_finite' ELSE 'metric_out_of_range' END AS code
        FROM dirty WHERE isnan(roc_auc) OR roc_auc > 1""",
)
def q_range(spark, sf):
    return gates.metric_range(dirty_metrics(spark, sf))


@query(
    "gate_identity",
    f"""WITH {DIRTY_SQL} SELECT key, 'key_mismatch' AS code FROM dirty WHERE key LIKE '%x' AND key <> ({KEY_SQL})""",
)
def q_identity(spark, sf):
    return gates.identity_gate(dirty_metrics(spark, sf), scarcity_study())


@query(
    "gate_identity_levels",
    """WITH r AS (SELECT l_linestatus || '__' || lpad(CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR), 3, '0') || 'pct__seed_'
           || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '__' || CASE l_returnflag WHEN 'R' THEN 'random_forest' WHEN 'A' THEN 'logistic_regression' ELSE 'boosted' END AS key,
           l_linestatus AS dataset, CAST(l_discount AS DECIMAL(3,2)) AS f, l_returnflag FROM lineitem)
       SELECT key, code, count(*) AS n FROM (
         SELECT key, 'unknown_dataset' AS code FROM r WHERE dataset <> 'F' UNION ALL
         SELECT key, 'unknown_model' FROM r WHERE l_returnflag = 'N' UNION ALL
         SELECT key, 'unsupported_fraction' FROM r WHERE dataset = 'F' AND f NOT IN (0.01, 0.05, 0.10)) GROUP BY ALL""",
)
def q_levels(spark, sf):
    """Foreign datasets, models and fractions among lineitem-derived conditions."""
    from pairwright.functions.keys import fraction_token, identity

    study = Study(levels={"F": (Decimal("0.01"), Decimal("0.05"), Decimal("0.10"))})
    rows = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("dataset"),
        F.col("l_discount").cast("decimal(3,2)").alias("retained_fraction"),
        F.col("l_linenumber").alias("seed"),
        F.when(F.col("l_returnflag") == "R", "random_forest")
        .when(F.col("l_returnflag") == "A", "logistic_regression")
        .otherwise("boosted")
        .alias("model"),
    )
    rows = rows.withColumn(
        "retained_fraction_token", fraction_token(F.col("retained_fraction"))
    ).withColumn("key", identity())
    return gates.identity_gate(rows, study).groupBy("key", "code").agg(F.count(F.lit(1)).alias("n"))


# --- manifests: suppliers as declared files, with faults by supplier key

def declared(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.format_string("dataset/%d.npz", "s_suppkey").alias("path"),
        F.abs(F.round("s_acctbal")).cast("long").alias("bytes"),
        F.sha2("s_name", 256).alias("sha256"),
        "s_suppkey",
    )


def actual(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    rows = declared(spark, sf).filter(key % 5 != 1)
    extra = declared(spark, sf).filter(key % 7 == 0).withColumn(
        "path", F.concat(F.lit("extra/"), "path")
    )
    return (
        rows.withColumn("bytes", F.col("bytes") + F.when(key % 5 == 2, 1).otherwise(0))
        .withColumn("sha256", F.when(key % 5 == 3, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
        .unionByName(extra)
    )


FILES_SQL = """
declared AS (SELECT 'dataset/' || s_suppkey || '.npz' AS path, CAST(abs(round(s_acctbal)) AS BIGINT) AS bytes, sha256(s_name) AS sha256, s_suppkey FROM supplier),
actual AS (
  SELECT path, bytes + CASE WHEN s_suppkey % 5 = 2 THEN 1 ELSE 0 END AS bytes,
         CASE WHEN s_suppkey % 5 = 3 THEN sha256(sha256) ELSE sha256 END AS sha256, s_suppkey FROM declared WHERE s_suppkey % 5 <> 1
  UNION ALL SELECT 'extra/' || path, bytes, sha256, s_suppkey FROM declared WHERE s_suppkey % 7 = 0)"""


@query(
    "manifest_vs_files",
    f"""WITH {FILES_SQL}, j AS (SELECT coalesce(d.path, a.path) AS path, d.bytes AS db, a.bytes AS ab, d.sha256 AS ds, a.sha256 AS s
        FROM declared d FULL JOIN actual a ON d.path = a.path)
        SELECT path, 'artifact_missing' AS code, '' AS detail FROM j WHERE ab IS NULL
        UNION ALL SELECT path, 'unexpected_artifact', '' FROM j WHERE db IS NULL
        UNION ALL SELECT path, 'artifact_size_mismatch', 'expected ' || db || ', found ' || ab FROM j WHERE db <> ab
        UNION ALL SELECT path, 'artifact_hash_mismatch', 'expected ' || ds || ', found ' || s FROM j WHERE ds <> s""",
)
def q_manifest(spark, sf):
    return reconcile.manifest_vs_files(declared(spark, sf), actual(spark, sf))


@query(
    "manifest_totals",
    f"""WITH {FILES_SQL}, t AS (SELECT (SELECT count(*) FROM declared) AS dn, (SELECT count(*) FROM actual) AS an,
          (SELECT sum(bytes) FROM declared) AS db, (SELECT sum(bytes) FROM actual) AS ab)
        SELECT 'artifact_count_mismatch' AS code, 'declared ' || dn || ', listed ' || an AS detail FROM t WHERE dn <> an
        UNION ALL SELECT 'artifact_bytes_mismatch', 'declared ' || db || ', listed ' || ab FROM t WHERE db <> ab""",
)
def q_totals(spark, sf):
    count, size = declared(spark, sf).agg(F.count(F.lit(1)), F.sum("bytes")).first()
    return reconcile.manifest_totals(actual(spark, sf), F.lit(count), F.lit(size))


@query(
    "reuse_identity",
    f"""WITH {FILES_SQL} SELECT d.path, a.path IS NOT NULL AS present, coalesce(d.bytes = a.bytes AND d.sha256 = a.sha256, FALSE) AS byte_identical
        FROM declared d LEFT JOIN actual a ON d.path = a.path""",
)
def q_reuse(spark, sf):
    return reconcile.reuse_identity(declared(spark, sf), actual(spark, sf), ["path"])


@query(
    "package_digest",
    f"""WITH {FILES_SQL} SELECT count(*) AS file_count, CAST(sum(bytes) AS BIGINT) AS bytes,
        {digest_sql('path || chr(9) || bytes || chr(9) || sha256', 'path', '', 'chr(10)', 'chr(10)')} AS identity_sha256 FROM actual""",
)
def q_package(spark, sf):
    return reconcile.package_digest(actual(spark, sf))


@query(
    "gate_manifest_entries",
    """WITH e AS (SELECT CASE WHEN l_linenumber = 1 THEN '/' ELSE '' END || CASE WHEN l_linenumber = 2 THEN '../' ELSE '' END
         || l_orderkey || CASE WHEN l_returnflag = 'A' THEN '.npy' ELSE '.npz' END AS path,
         CAST(CASE WHEN l_linenumber = 3 THEN -1 ELSE l_quantity END AS BIGINT) AS bytes,
         CASE WHEN l_linenumber = 4 THEN upper(sha256('a' || l_partkey)) ELSE sha256('a' || l_partkey) END AS sha256 FROM lineitem),
       s AS (SELECT *, NOT (path LIKE '/%' OR path LIKE '../%' OR path NOT LIKE '%.npz') AS safe FROM e)
       SELECT path, code, count(*) AS n FROM (
         SELECT path, 'unsafe_artifact_path' AS code FROM s WHERE NOT safe
         UNION ALL SELECT path, 'invalid_artifact_bytes' FROM s WHERE safe AND bytes < 0
         UNION ALL SELECT path, 'invalid_artifact_sha256' FROM s WHERE safe AND NOT regexp_matches(sha256, '^[0-9a-f]{64}$')
         UNION ALL SELECT path, 'duplicate_artifact_path' FROM s GROUP BY path HAVING count(*) > 1) GROUP BY ALL""",
)
def q_entries(spark, sf):
    line = F.col("l_linenumber")
    digest = F.sha2(F.concat(F.lit("a"), F.col("l_partkey").cast("string")), 256)
    entries = table(spark, sf, "lineitem").select(
        F.concat(
            F.when(line == 1, "/").otherwise(""),
            F.when(line == 2, "../").otherwise(""),
            F.col("l_orderkey").cast("string"),
            F.when(F.col("l_returnflag") == "A", ".npy").otherwise(".npz"),
        ).alias("path"),
        F.when(line == 3, -1).otherwise(F.col("l_quantity")).cast("long").alias("bytes"),
        F.when(line == 4, F.upper(digest)).otherwise(digest).alias("sha256"),
    )
    return gates.manifest_entry_gate(entries).groupBy("path", "code").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "gate_summary",
    f"""WITH {BOOT_SQL} SELECT dataset, retained_fraction_token, model, contrast, unnest(['endpoints_reversed', 'seed_not_derivable']) AS code
        FROM summary WHERE model = 'random_forest' AND ci_lower < ci_upper
        UNION ALL SELECT dataset, retained_fraction_token, model, contrast, 'label_not_derivable' FROM summary
        WHERE model = 'random_forest' AND interpretation <> CASE WHEN ci_upper > 0.01 THEN 'helpful' WHEN ci_lower < -0.01 THEN 'harmful'
          ELSE 'no_clear_practically_meaningful_difference' END""",
)
def q_summary(spark, sf):
    """A summary whose forest rows have their interval ends swapped and seeds raised."""
    rows = summary(spark, sf)
    forest = F.col("model") == "random_forest"
    swapped = rows.select(
        *[c for c in rows.columns if c not in ("ci_lower", "ci_upper", "bootstrap_seed")],
        F.when(forest, F.col("ci_upper")).otherwise(F.col("ci_lower")).alias("ci_lower"),
        F.when(forest, F.col("ci_lower")).otherwise(F.col("ci_upper")).alias("ci_upper"),
        (F.col("bootstrap_seed") + F.when(forest, 1).otherwise(0)).alias("bootstrap_seed"),
    )
    return gates.summary_gate(swapped, SCORE_STUDY)


@query(
    "gate_metric_blind",
    """SELECT doc_id, 'forbidden_name' AS code FROM documents WHERE regexp_matches(lower(text),
       'roc_auc|average_precision|precision|recall|f1|accuracy|predictive_metric|predictive_metrics|probability_values')""",
)
def q_blind(spark, sf):
    """Documents whose text contains a metric name; whole texts are searched."""
    rows = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return gates.metric_blind(rows, ["doc_id"])


@query(
    "gate_metric_blind_planted",
    """SELECT doc_id, 'forbidden_name' AS code FROM (SELECT doc_id, CASE WHEN hash THEN text || ' ROC_AUC rose' ELSE text END AS text
         FROM (SELECT *, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 1) = 'a' AS hash FROM documents))
       WHERE regexp_matches(lower(text), 'roc_auc|average_precision|precision|recall|f1|accuracy|predictive_metric|predictive_metrics|probability_values')""",
)
def q_blind_planted(spark, sf):
    """The same after a metric name was put at the end of some documents."""
    rows = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    chosen = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 1) == "a"
    text = F.when(chosen, F.concat("text", F.lit(" ROC_AUC rose"))).otherwise(F.col("text"))
    return gates.metric_blind(rows.withColumn("text", text), ["doc_id"])


@query(
    "gate_metric_blind_nested",
    f"""WITH {SCORES_SQL} SELECT {KEY_SQL} AS key, 'forbidden_name' AS code FROM auc WHERE arm = 'gaussian' AND roc_auc > 0.5""",
)
def q_blind_nested(spark, sf):
    """The same on nested report rows: notes in an array of structs, digests exempt."""
    rows = with_key(metric_rows(spark, sf).filter("arm = 'gaussian'"))
    note = F.when(F.col("roc_auc") > 0.5, "Recall was high").otherwise("nothing to report")
    return gates.metric_blind(
        rows.select(
            "key",
            F.sha2("key", 256).alias("digest"),
            F.array(F.struct(note.alias("note"), F.lit(1).alias("n"))).alias("warnings"),
            F.create_map(F.lit("precision"), F.lit("field names are not values")).alias("extra"),
        ),
        ["key"],
    )


@query(
    "key_manifest",
    f"""WITH {SCORES_SQL}, k AS (SELECT DISTINCT dataset, {KEY_SQL} AS key FROM auc)
        SELECT dataset, count(*) AS condition_count, sha256(string_agg(key, chr(10) ORDER BY key) || chr(10)) AS condition_keys_sha256
        FROM k GROUP BY dataset""",
)
def q_key_manifest(spark, sf):
    """Key count and digest per dataset, for the declared conditions the scores cover."""
    observed = with_key(metric_rows(spark, sf)).select("key").distinct()
    grid = condition_grid(spark, SCORE_STUDY).join(observed, "key", "left_semi")
    counted = grid.groupBy("dataset").agg(F.count(F.lit(1)).alias("condition_count"))
    return counted.join(
        key_set_digest(grid, ["dataset"], name="condition_keys_sha256"), "dataset"
    )


@query(
    "key_manifest_gate",
    f"""WITH {SCORES_SQL}, k AS (SELECT DISTINCT {KEY_SQL} AS key FROM auc WHERE NOT (dataset = 'O' AND seed = 7))
        SELECT g.key AS subject, 'missing_key' AS code FROM (SELECT DISTINCT {KEY_SQL} AS key, dataset, seed FROM auc) g WHERE dataset = 'O' AND seed = 7
        UNION ALL SELECT 'manifest', 'count_changed' UNION ALL SELECT 'manifest', 'digest_changed'""",
)
def q_key_manifest_gate(spark, sf):
    """A stored manifest without seed 7 of one dataset, against the grid."""
    from pairwright.operators.grid import key_manifest_violations

    observed = with_key(metric_rows(spark, sf)).filter(
        ~((F.col("dataset") == "O") & (F.col("seed") == 7))
    ).select("key").distinct()
    stored = observed.join(
        condition_grid(spark, SCORE_STUDY).select("key", F.col("ordinal").alias("pos")), "key"
    )
    scoped = stored.withColumn("scope", F.lit("stored"))
    header = key_set_digest(scoped, ["scope"], name="condition_keys_sha256").join(
        scoped.groupBy("scope").agg(F.count(F.lit(1)).alias("condition_count")), "scope"
    )
    return key_manifest_violations(header, stored, SCORE_STUDY)
