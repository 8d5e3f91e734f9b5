"""Splits, nested subsets and restoration of the labelled orders table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import FRACTIONS, LABELLED_SQL, SEEDS, digest_sql, labelled, query, table
from pairwright.operators import ledger, restore
from pairwright.operators import sampling as S
from pairwright.operators.ordering import digest_bucket, digest_digits, id_bucket, ranked

NAME = "orders"
GROUP = list(restore.CONDITION)


def sampler(spark: SparkSession, sf: str) -> S.Sampler:
    return S.Sampler(labelled(spark, sf), NAME, SEEDS, FRACTIONS)


def retained(spark: SparkSession, sf: str) -> tuple[DataFrame, F.Column, S.Sampler]:
    sample = sampler(spark, sf)
    pool = sample.counts.agg(F.sum("n_train")).first()[0]
    return sample.subsets().withColumn("dataset", F.lit(NAME)), F.lit(pool), sample


def restorer(spark: SparkSession, sf: str) -> restore.Restorer:
    rows, pool, sample = retained(spark, sf)
    return restore.Restorer(rows, pool, counts=sample.retained_counts)


SPLIT_SQL = LABELLED_SQL + """,
seeds AS (SELECT CAST(unnest([0, 1]) AS INT) AS seed),
sizes AS (SELECT target, count(*) AS n, sum(count(*)) OVER () AS pool_rows FROM labelled GROUP BY target),
shares AS (
  SELECT *, CAST(ceil(pool_rows * 0.2) AS BIGINT) AS test_rows FROM sizes),
floors AS (SELECT *, CAST(n * test_rows // pool_rows AS BIGINT) AS low, n * test_rows % pool_rows AS rest FROM shares),
held AS (
  SELECT target, n, low + CASE WHEN row_number() OVER (ORDER BY rest DESC, target) <= test_rows - sum(low) OVER () THEN 1 ELSE 0 END AS n_test
  FROM floors),
drawn AS (
  SELECT l.*, s.seed, row_number() OVER (PARTITION BY s.seed, l.target ORDER BY
    sha256('pairwright.split.v1|orders|' || s.seed || '|' || l.target || '|' || l.row_id), l.row_id) AS place
  FROM labelled l, seeds s),
split AS (
  SELECT d.* EXCLUDE (place), CASE WHEN place <= n_test THEN 'test' ELSE 'train' END AS part
  FROM drawn d JOIN held h USING (target))"""

SUBSET_SQL = SPLIT_SQL + """,
pool AS (SELECT target, n - n_test AS n, CAST(sum(n - n_test) OVER () AS BIGINT) AS pool FROM held),
levels AS (SELECT CAST(unnest(['0.05', '0.25', '0.50']) AS DECIMAL(3,2)) AS retained_fraction),
totals AS (SELECT p.*, retained_fraction, CAST(floor(pool * retained_fraction + 0.5) AS BIGINT) AS retained_size FROM pool p, levels),
parts AS (SELECT *, CAST(n * retained_size // pool AS BIGINT) AS low, n * retained_size % pool AS rest FROM totals),
seats AS (
  SELECT *, low + CASE WHEN row_number() OVER (PARTITION BY retained_fraction ORDER BY rest DESC, target)
                        <= retained_size - sum(low) OVER (PARTITION BY retained_fraction) THEN 1 ELSE 0 END AS seat FROM parts),
allocations AS (
  SELECT target, retained_fraction, pool, retained_size, n,
         CAST(CASE WHEN seat < 2 THEN 2
              WHEN retained_size - seat < 2 THEN seat - (2 - (retained_size - seat)) ELSE seat END AS BIGINT) AS allocation
  FROM seats),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY seed, target ORDER BY
    sha256('pairwright.subset.v1|orders|' || seed || '|' || target || '|' || row_id), row_id) AS place
  FROM split WHERE part = 'train'),
subsets AS (
  SELECT o.* EXCLUDE (place, part), a.retained_fraction,
         lpad(CAST(CAST(a.retained_fraction * 100 AS INT) AS VARCHAR), 3, '0') || 'pct' AS retained_fraction_token
  FROM ordered o JOIN allocations a USING (target) WHERE place <= allocation)"""

RANK_SQL = SUBSET_SQL + """,
conditions AS (
  SELECT retained_fraction, retained_fraction_token, seed, count(*) AS n_original, (SELECT max(pool) FROM pool) AS final_size
  FROM subsets GROUP BY ALL),
per_class AS (SELECT retained_fraction_token, seed, target, count(*) AS n FROM subsets GROUP BY ALL),
extra AS (
  SELECT p.*, n_original, final_size, final_size - n_original AS n_extra,
         CAST(n * (final_size - n_original) // n_original AS BIGINT) AS low, n * (final_size - n_original) % n_original AS rest
  FROM per_class p JOIN conditions USING (retained_fraction_token, seed)),
plan AS (
  SELECT * EXCLUDE (low, rest), low + CASE WHEN row_number() OVER (PARTITION BY retained_fraction_token, seed ORDER BY rest DESC, target)
                        <= n_extra - sum(low) OVER (PARTITION BY retained_fraction_token, seed) THEN 1 ELSE 0 END AS duplicates
  FROM extra),
placed AS (
  SELECT s.*, p.n, p.n_original, p.duplicates, p.final_size,
         sha256('{"class_label":' || s.target || ',"dataset":"orders","namespace":"pairwright.replication-order.v1","original_source_row_index":'
           || row_id || ',"retained_fraction_token":"' || s.retained_fraction_token || '","split_seed":' || s.seed || '}') AS digest,
         row_number() OVER (PARTITION BY s.retained_fraction_token, s.seed ORDER BY row_id) - 1 AS own
  FROM subsets s JOIN plan p USING (retained_fraction_token, seed, target)),
ranks AS (
  SELECT *, row_number() OVER (PARTITION BY retained_fraction_token, seed, target ORDER BY digest, row_id) - 1 AS rank FROM placed),
counted AS (SELECT *, CAST(duplicates // n + CASE WHEN rank < duplicates % n THEN 1 ELSE 0 END AS BIGINT) AS copies FROM ranks),
restored AS (
  SELECT retained_fraction_token, seed, target, row_id, x_num, own AS pos, FALSE AS is_duplicate, n_original FROM counted
  UNION ALL
  SELECT retained_fraction_token, seed, target, row_id, x_num,
         n_original + CASE WHEN target = 1 THEN (SELECT max(duplicates) FROM plan q WHERE q.target = 0 AND q.seed = counted.seed
           AND q.retained_fraction_token = counted.retained_fraction_token) ELSE 0 END + j.j * n + rank, TRUE, n_original
  FROM counted, range(0, copies) j(j))"""


@query("class_counts", f"WITH {LABELLED_SQL} SELECT x_nom, target, count(*) AS n FROM labelled GROUP BY ALL")
def q_class_counts(spark, sf):
    return S.class_counts(labelled(spark, sf), ["x_nom"])


@query(
    "stratified_split",
    f"WITH {SPLIT_SQL} SELECT seed, row_id, target, part FROM split",
)
def q_split(spark, sf):
    return sampler(spark, sf).split().select("seed", "row_id", "target", "part")


_ALLOCATE_SQL = """WITH c AS (
  SELECT o_custkey, CAST(o_orderstatus = 'F' AS INT) AS target, count(*) AS n FROM orders GROUP BY ALL),
t AS (SELECT *, CAST(floor(sum(n) OVER (PARTITION BY o_custkey) * 0.35 + 0.5) AS BIGINT) + 3 AS total,
        sum(n) OVER (PARTITION BY o_custkey) AS everyone, count(*) OVER (PARTITION BY o_custkey) AS classes FROM c),
f AS (SELECT *, CAST(n * total // everyone AS BIGINT) AS low, CAST(n * total % everyone AS BIGINT) AS rest FROM t),
s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY rest DESC, target) AS place,
        total - sum(low) OVER (PARTITION BY o_custkey) AS open_seats FROM f),
a AS (SELECT *, low + CASE WHEN place <= open_seats THEN 1 ELSE 0 END AS seat FROM s)
"""


@query(
    "allocate_class_counts",
    _ALLOCATE_SQL
    + """SELECT o_custkey, total, target, n, CASE WHEN total < 2 * classes THEN NULL WHEN classes = 1 THEN seat
       WHEN seat < 2 THEN 2 WHEN total - seat < 2 THEN seat - (2 - (total - seat)) ELSE seat END AS allocation FROM a""",
)
def q_allocate(spark, sf):
    """One group per customer: small totals, so the minimum and ties matter."""
    return S.allocate_class_counts(_customers(spark, sf), ["o_custkey"], "total").drop("everyone")


def _customers(spark, sf):
    from pairwright.functions.scores import round_half_up

    rows = labelled_by_customer(spark, sf)
    counts = S.class_counts(rows, ["o_custkey"])
    totals = rows.groupBy("o_custkey").agg(
        (round_half_up(F.count(F.lit(1)).cast("decimal(19,0)") * F.lit(0.35).cast("decimal(3,2)"))
         + 3).alias("total")
    )
    return counts.join(totals, "o_custkey")


def labelled_by_customer(spark, sf):
    return table(spark, sf, "orders").select(
        "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("target")
    )


@query(
    "largest_remainders",
    _ALLOCATE_SQL + "SELECT o_custkey, target, seat AS allocation FROM a WHERE place <= open_seats",
)
def q_remainders(spark, sf):
    """Classes that get a seat for their remainder: the top ``open_seats`` of each group."""
    rows = S.allocate_class_counts(_customers(spark, sf), ["o_custkey"], "total", minimum=0)
    share = F.col("n").cast("decimal(19,0)") * F.col("total").cast("decimal(19,0)")
    return (
        rows.filter(F.col("allocation") > F.floor(share / F.col("everyone").cast("decimal(19,0)")))
        .select("o_custkey", "target", "allocation")
    )


@query(
    "subset_allocations",
    f"WITH {SUBSET_SQL} SELECT target, retained_fraction, retained_size, n, allocation FROM allocations",
)
def q_allocations(spark, sf):
    return sampler(spark, sf).allocations.drop("pool")


@query(
    "nested_scarcity_subsets",
    f"WITH {SUBSET_SQL} SELECT seed, retained_fraction_token, row_id, target FROM subsets",
)
def q_subsets(spark, sf):
    return sampler(spark, sf).subsets().select("seed", "retained_fraction_token", "row_id", "target")


@query(
    "nested_subset",
    f"""WITH {SUBSET_SQL} SELECT seed, row_id, min(retained_fraction) AS first_fraction, count(*) AS levels
        FROM subsets GROUP BY ALL""",
)
def q_membership(spark, sf):
    """The smallest fraction at which a row is kept: nested subsets in one column."""
    return sampler(spark, sf).subsets().groupBy("seed", "row_id").agg(
        F.min("retained_fraction").alias("first_fraction"), F.count(F.lit(1)).alias("levels")
    )


@query(
    "nestedness_check",
    f"""WITH {SUBSET_SQL} SELECT seed, row_id, 'subset_not_nested' AS code FROM subsets GROUP BY seed, row_id
        HAVING count(*) <> 4 - CASE CAST(min(retained_fraction) AS VARCHAR) WHEN '0.05' THEN 1 WHEN '0.25' THEN 2 ELSE 3 END
        UNION ALL SELECT target, 0, 'allocation_decreased' FROM (SELECT *, lag(allocation) OVER (PARTITION BY target ORDER BY retained_fraction) AS p FROM allocations) WHERE allocation < p""",
)
def q_nestedness(spark, sf):
    sample = sampler(spark, sf)
    decreased = S.nestedness_violations(sample.allocations)
    return S.subset_gaps(sample.subsets()).unionByName(
        decreased.select(F.col("target").alias("seed"), F.lit(0).cast("long").alias("row_id"), "code")
    )


@query(
    "nestedness_decrease",
    f"""WITH {SUBSET_SQL}, planted AS (SELECT target, retained_fraction, CASE WHEN target = 1 AND retained_fraction > 0.1 THEN allocation % 7 ELSE allocation END AS a FROM allocations)
        SELECT target, retained_fraction, 'allocation_decreased' AS code
        FROM (SELECT *, lag(a) OVER (PARTITION BY target ORDER BY retained_fraction) AS p FROM planted) WHERE a < p""",
)
def q_decrease(spark, sf):
    """The same check on allocations of which the larger ones of a class were cut down."""
    cut = (F.col("target") == 1) & (F.col("retained_fraction") > 0.1)
    planted = sampler(spark, sf).allocations.withColumn(
        "allocation", F.when(cut, F.col("allocation") % 7).otherwise(F.col("allocation"))
    )
    return S.nestedness_violations(planted)


@query(
    "subset_membership_gaps",
    f"""WITH {SUBSET_SQL}, holes AS (SELECT * FROM subsets WHERE NOT (retained_fraction = 0.50 AND row_id % 5 = 0)),
        firsts AS (SELECT seed, row_id, min(retained_fraction) AS f, count(*) AS kept FROM holes GROUP BY ALL)
        SELECT seed, row_id, 'subset_not_nested' AS code FROM firsts
        WHERE kept <> CASE CAST(f AS VARCHAR) WHEN '0.05' THEN 3 WHEN '0.25' THEN 2 ELSE 1 END""",
)
def q_gaps(spark, sf):
    """The same check on subsets that lost rows at the largest fraction."""
    rows = sampler(spark, sf).subsets()
    holes = rows.filter(~((F.col("retained_fraction") == 0.50) & (F.col("row_id") % 5 == 0)))
    return S.subset_gaps(holes)


@query(
    "retained_rows",
    f"""WITH {SUBSET_SQL} SELECT seed, retained_fraction_token, count(*) AS rows_kept, count(o.o_orderdate) AS dated,
        round(sum(o.o_totalprice), 2) AS price
        FROM subsets s JOIN orders o ON s.row_id = o.o_orderkey GROUP BY ALL""",
)
def q_retained(spark, sf):
    """Source rows looked up by retained id."""
    kept = sampler(spark, sf).subsets(labelled(spark, sf)).select(
        "seed", "retained_fraction_token", F.col("row_id").alias("o_orderkey")
    )
    source = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return kept.join(source, "o_orderkey").groupBy("seed", "retained_fraction_token").agg(
        F.count(F.lit(1)).alias("rows_kept"),
        F.count("o_orderdate").alias("dated"),
        F.round(F.sum(F.col("o_totalprice").cast("decimal(20,2)")), 2).cast("double").alias("price"),
    )


@query(
    "ordered_ids",
    f"""WITH {SUBSET_SQL} SELECT seed, retained_fraction_token, row_id,
        row_number() OVER (PARTITION BY seed, retained_fraction_token ORDER BY row_id) - 1 AS pos FROM subsets""",
)
def q_ordered(spark, sf):
    rows = sampler(spark, sf).subsets().select("seed", "retained_fraction_token", "row_id")
    return ranked(rows, ["seed", "retained_fraction_token"], id_bucket(F.col("row_id")),
                  ["row_id"], "pos")


@query(
    "digest_rank",
    f"WITH {RANK_SQL} SELECT retained_fraction_token, seed, target, row_id, rank FROM ranks",
)
def q_rank(spark, sf):
    """Digest rank of every retained row in its condition and class."""
    rows = restorer(spark, sf)
    ordered = rows._ordered(rows.retained)
    largest = sampler(spark, sf).largest_class  # no class of a condition has more rows
    return ranked(ordered, [*GROUP, "target"], digest_bucket(F.col("_digest"), digest_digits(largest)),
                  ["_digest", "row_id"], "rank").select(
        "retained_fraction_token", "seed", "target", "row_id", "rank"
    )


@query(
    "replication_weights",
    f"WITH {RANK_SQL} SELECT retained_fraction_token, seed, target, row_id, copies FROM counted",
)
def q_copies(spark, sf):
    """Copies per retained row without placing them: no row is shuffled."""
    return restorer(spark, sf).copies().select(
        "retained_fraction_token", "seed", "target", "row_id", "copies"
    )


@query(
    "replication_control",
    f"WITH {RANK_SQL} SELECT retained_fraction_token, seed, target, row_id, pos, is_duplicate FROM restored",
)
def q_restored(spark, sf):
    return restorer(spark, sf).restored().select(
        "retained_fraction_token", "seed", "target", "row_id", "pos", "is_duplicate"
    )


@query(
    "final_position",
    f"""WITH {RANK_SQL} SELECT retained_fraction_token, seed, is_duplicate, target, min(pos) AS first_pos, max(pos) AS last_pos,
        count(*) AS n FROM restored GROUP BY ALL""",
)
def q_position(spark, sf):
    return restorer(spark, sf).restored().groupBy(
        "retained_fraction_token", "seed", "is_duplicate", "target"
    ).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
          F.count(F.lit(1)).alias("n"))


@query(
    "restore_union",
    f"""WITH {RANK_SQL} SELECT retained_fraction_token, seed, count(*) AS n, count(DISTINCT row_id) AS sources,
        count(*) FILTER (NOT is_duplicate) AS originals, count(x_num) AS filled FROM restored GROUP BY ALL""",
)
def q_union(spark, sf):
    """Originals and duplicates together, with their features."""
    return restorer(spark, sf).restored().groupBy("retained_fraction_token", "seed").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("sources"),
        F.count_if(F.expr("NOT is_duplicate")).alias("originals"), F.count("x_num").alias("filled"),
    )


@query(
    "repetition_balance",
    f"""WITH {RANK_SQL} SELECT retained_fraction_token, seed, target, min(copies) AS least, max(copies) AS most,
        count(*) FILTER (copies = 0) AS uncopied FROM counted GROUP BY ALL""",
)
def q_balance(spark, sf):
    return restorer(spark, sf).copies().groupBy("retained_fraction_token", "seed", "target").agg(
        F.min("copies").alias("least"), F.max("copies").alias("most"),
        F.count_if(F.expr("copies = 0")).alias("uncopied"),
    )


_ORIGINALS = digest_sql("row_id", "pos", " FILTER (NOT is_duplicate)")
_DUPLICATES = digest_sql("row_id", "pos", " FILTER (is_duplicate)")


@query(
    "allocation_audit",
    f"""WITH {RANK_SQL} SELECT retained_fraction_token, seed, max(n_original) AS original_count,
        count(*) - max(n_original) AS duplicate_count, count(*) AS final_count,
        {_ORIGINALS} AS original_source_indices_sha256, {_DUPLICATES} AS duplicate_source_indices_sha256,
        {digest_sql('row_id', 'pos')} AS final_source_indices_sha256,
        {digest_sql('target', 'pos')} AS final_target_labels_sha256,
        sha256('{{"class_labels":[0,1],"dataset":"orders","namespace":"pairwright.replication-order.v1","retained_fraction_token":"'
          || retained_fraction_token || '","split_seed":' || seed || '}}') AS canonical_contract_sha256
        FROM restored GROUP BY retained_fraction_token, seed""",
)
def q_audit(spark, sf):
    return restorer(spark, sf).audit().drop(
        "dataset", "retained_target_counts", "duplicate_target_counts", "final_target_counts"
    )


@query(
    "sequence_digest",
    f"""WITH {RANK_SQL} SELECT retained_fraction_token, seed, target, count(*) AS retained_source_count,
        CAST(sum(copies) AS BIGINT) AS duplicate_count, min(copies) AS minimum_duplicates_per_source,
        max(copies) AS maximum_duplicates_per_source,
        {digest_sql('row_id', 'rank')} AS ranked_source_indices_sha256,
        max((SELECT {_DUPLICATES} FROM restored r WHERE r.seed = counted.seed AND r.target = counted.target
         AND r.retained_fraction_token = counted.retained_fraction_token)) AS duplicate_source_indices_sha256
        FROM counted GROUP BY retained_fraction_token, seed, target""",
)
def q_blocks(spark, sf):
    """Audit rows per class block, with the digests of both id sequences."""
    return restorer(spark, sf).class_blocks().drop("dataset")


@query(
    "gate_allocation",
    f"""WITH {RANK_SQL}, conditions_hit AS (SELECT DISTINCT retained_fraction_token, seed FROM plan)
        SELECT retained_fraction_token, seed, unnest(['total_count', 'retained_sum']) AS code FROM conditions_hit WHERE seed = 0
        UNION ALL SELECT retained_fraction_token, seed, 'floor_ceiling' FROM plan
        WHERE retained_fraction_token = '025pct' AND target = 1""",
)
def q_gate_allocation(spark, sf):
    """Audit rows with two faults put in: one count raised, one balance changed."""
    rows = restorer(spark, sf)
    audit = rows.audit().withColumn(
        "original_count", F.col("original_count") + F.when(F.col("seed") == 0, 1).otherwise(0)
    )
    hit = (F.col("retained_fraction_token") == "025pct") & (F.col("target") == 1)
    blocks = rows.class_blocks().withColumn(
        "maximum_duplicates_per_source",
        F.col("maximum_duplicates_per_source") + F.when(hit, 1).otherwise(0),
    )
    return restore.allocation_record_violations(audit, blocks).select(
        "retained_fraction_token", "seed", "code"
    )


@query(
    "restoration_invariants",
    f"""WITH {RANK_SQL}, broken AS (SELECT * FROM restored WHERE NOT (is_duplicate AND retained_fraction_token = '005pct' AND seed = 1 AND row_id % 11 = 0)),
        c AS (SELECT retained_fraction_token, seed, target, count(*) AS n, sum(pos) AS p FROM broken GROUP BY ALL),
        w AS (SELECT c.*, sum(c.n) OVER (PARTITION BY c.retained_fraction_token, c.seed) AS all_rows,
              sum(c.p) OVER (PARTITION BY c.retained_fraction_token, c.seed) AS all_pos, plan.n + duplicates AS want, final_size
              FROM c JOIN plan USING (retained_fraction_token, seed, target))
        SELECT retained_fraction_token, seed, target, 'wrong_final_size' AS code FROM w WHERE all_rows <> final_size
        UNION ALL SELECT retained_fraction_token, seed, target, 'wrong_class_count' FROM w WHERE n <> want
        UNION ALL SELECT retained_fraction_token, seed, target, 'positions_not_dense' FROM w WHERE 2 * all_pos <> all_rows * (all_rows - 1)""",
)
def q_invariants(spark, sf):
    """The invariants on a restored table that lost copies in one condition."""
    rows = restorer(spark, sf)
    lost = (
        F.col("is_duplicate") & (F.col("retained_fraction_token") == "005pct")
        & (F.col("seed") == 1) & (F.col("row_id") % 11 == 0)
    )
    return restore.restoration_violations(rows.restored().filter(~lost), rows.allocation).select(
        "retained_fraction_token", "seed", "target", "code"
    )


@query(
    "gate_restoration_input",
    """WITH e AS (SELECT event_type, CAST(event_id // 540 AS INT) AS run, user_id AS row_id,
         CAST(CASE WHEN value > 300 THEN 2 WHEN value > 50 THEN 1 ELSE 0 END AS INT) AS target FROM events),
       g AS (SELECT event_type, run, count(*) AS n, count(DISTINCT row_id) AS ids, count(*) FILTER (target = 2) AS bad,
             count(*) FILTER (target = 1) AS ones, count(*) FILTER (target = 0) AS zeros FROM e GROUP BY ALL)
       SELECT event_type, run, 'row_id_not_unique' AS code FROM g WHERE n > ids
       UNION ALL SELECT event_type, run, 'labels_not_zero_and_one' FROM g WHERE bad > 0 OR ones = 0 OR zeros = 0
       UNION ALL SELECT event_type, run, 'final_size_below_retained' FROM g WHERE n > 110""",
)
def q_gate_input(spark, sf):
    value = F.col("value")
    rows = table(spark, sf, "events").select(
        "event_type", F.floor(F.col("event_id") / 540).cast("int").alias("run"),
        F.col("user_id").alias("row_id"),
        F.when(value > 300, 2).when(value > 50, 1).otherwise(0).cast("int").alias("target"),
    )
    return restore.restoration_input_violations(rows, F.lit(110), group=["event_type", "run"])


@query(
    "condition_profile",
    f"""WITH {SUBSET_SQL} SELECT seed, retained_fraction_token, count(*) AS retained_size,
        count(*) FILTER (target = 0) AS retained_negative, count(*) FILTER (target = 1) AS retained_positive,
        {digest_sql('row_id', 'row_id')} AS retained_ids_sha256 FROM subsets GROUP BY seed, retained_fraction_token""",
)
def q_profile(spark, sf):
    group = ["seed", "retained_fraction_token"]
    rows = sampler(spark, sf).subsets().select(*group, "row_id", "target")
    placed = ranked(rows, group, id_bucket(F.col("row_id")), ["row_id"], "pos")
    return ledger.condition_profile(placed, group)


@query(
    "dataset_profile",
    f"WITH {LABELLED_SQL} SELECT 'orders' AS dataset, count(*) AS row_count, 5 AS column_count FROM labelled",
)
def q_dataset_profile(spark, sf):
    return ledger.dataset_profile(labelled(spark, sf), NAME)


@query(
    "round_half_up",
    """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(floor(CAST(l_quantity AS DECIMAL(9,0)) * CAST(l_tax AS DECIMAL(3,2)) + 0.5) AS BIGINT)) AS BIGINT) AS rounded
       FROM lineitem GROUP BY ALL""",
)
def q_round(spark, sf):
    from pairwright.functions.scores import round_half_up

    product = F.col("l_quantity").cast("decimal(9,0)") * F.col("l_tax").cast("decimal(3,2)")
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(round_half_up(product)).alias("rounded")
    )
