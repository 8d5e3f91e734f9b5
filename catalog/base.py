"""Registry and the views the queries share, as DataFrames and as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.keys import condition_key, fraction_token
from pairwright.operators.grid import condition_grid
from pairwright.operators.ordering import CHUNK, KEY_ROWS, settle, spread
from pairwright.study import Study, decimals, scarcity_study

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def digest_sql(value: str, order: str, only: str = "", glue: str = "','", end: str = "''") -> str:
    """The chunked digest of ``operators.ordering.ordered_digest`` as a DuckDB aggregate."""
    values = f"(list(CAST({value} AS VARCHAR) ORDER BY {order}){only})"
    chunk = f"array_to_string({values}[k + 1 : k + {CHUNK}], {glue}) || {end}"
    return (
        f"sha256('{CHUNK}:' || array_to_string(list_transform(range(0, len{values}, {CHUNK}), "
        f"lambda k: sha256({chunk})), ','))"
    )


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- labelled table: orders with a target, a numeric column with gaps, a nominal and a binary one

SEEDS = (0, 1)
FRACTIONS = decimals("0.05", "0.25", "0.50")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_custkey"]
    return spread(table(spark, sf, "orders").select(*columns)).select(
        F.col("o_orderkey").alias("row_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("target"),
        F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")).alias("x_num"),
        F.col("o_orderpriority").alias("x_nom"),
        (F.col("o_custkey") % 2).cast("double").alias("x_bin"),
    )


LABELLED_SQL = """
labelled AS (
  SELECT o_orderkey AS row_id, CAST(o_orderstatus = 'F' AS INT) AS target,
         CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS x_num,
         o_orderpriority AS x_nom, CAST(o_custkey % 2 AS DOUBLE) AS x_bin
  FROM orders)"""

# --- scores of three arms from lineitem; the study has both line states as datasets

SCORE_STUDY = Study(levels={"F": decimals("0.05", "0.50"), "O": decimals("0.05", "0.50")})
KEYS = ["dataset", "retained_fraction", "retained_fraction_token", "seed", "model"]


def arm_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(condition, arm, y_true, probability): one row per lineitem row and arm."""
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
               "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus"]
    lines = spread(table(spark, sf, "lineitem").select(*columns))
    retained = F.when(F.col("l_tax") < 0.04, F.lit("0.05")).otherwise("0.50")
    return lines.select(
        F.col("l_linestatus").alias("dataset"),
        retained.cast("decimal(3,2)").alias("retained_fraction"),
        F.when(F.col("l_suppkey") % 2 == 0, "logistic_regression")
        .otherwise("random_forest")
        .alias("model"),
        (F.col("l_orderkey") % 30).cast("int").alias("seed"),
        (F.col("l_returnflag") == "R").cast("tinyint").alias("y_true"),
        F.inline(
            F.array(
                F.struct(
                    F.lit("real_only").alias("arm"),
                    F.round("l_extendedprice").cast("long").cast("float").alias("probability"),
                ),
                F.struct(
                    F.lit("replication").alias("arm"),
                    ((F.col("l_partkey") * 7919 + F.col("l_linenumber")) % 10007)
                    .cast("float")
                    .alias("probability"),
                ),
                F.struct(
                    F.lit("gaussian").alias("arm"),
                    F.col("l_quantity").cast("float").alias("probability"),
                ),
            )
        ),
    ).withColumn("retained_fraction_token", fraction_token(F.col("retained_fraction")))


SCORES_SQL = """
lines AS (
  SELECT l_linestatus AS dataset,
         CAST(CASE WHEN l_tax < 0.04 THEN '0.05' ELSE '0.50' END AS DECIMAL(3,2)) AS retained_fraction,
         CASE WHEN l_tax < 0.04 THEN '005pct' ELSE '050pct' END AS retained_fraction_token,
         CASE WHEN l_suppkey % 2 = 0 THEN 'logistic_regression' ELSE 'random_forest' END AS model,
         CAST(l_orderkey % 30 AS INT) AS seed, CAST(l_returnflag = 'R' AS INT) AS y_true,
         CAST(round(l_extendedprice) AS BIGINT) AS s_real,
         (l_partkey * 7919 + l_linenumber) % 10007 AS s_repl,
         CAST(l_quantity AS BIGINT) AS s_gauss
  FROM lineitem),
scores AS (
  SELECT dataset, retained_fraction, retained_fraction_token, model, seed, y_true, 'real_only' AS arm, s_real AS score FROM lines
  UNION ALL
  SELECT dataset, retained_fraction, retained_fraction_token, model, seed, y_true, 'replication', s_repl FROM lines
  UNION ALL
  SELECT dataset, retained_fraction, retained_fraction_token, model, seed, y_true, 'gaussian', s_gauss FROM lines),
auc AS (
  SELECT dataset, retained_fraction, retained_fraction_token, model, seed, arm,
         CAST(sum(p1) AS BIGINT) AS positives, CAST(sum(p0) AS BIGINT) AS negatives,
         CAST(sum(2 * p1 * below + p1 * p0) AS DOUBLE) / CAST(2 * sum(p1) * sum(p0) AS DOUBLE) AS roc_auc
  FROM (SELECT *, coalesce(sum(p0) OVER (PARTITION BY dataset, retained_fraction_token, model, seed, arm
                  ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT dataset, retained_fraction, retained_fraction_token, model, seed, arm, score,
                     sum(y_true) AS p1, sum(1 - y_true) AS p0
              FROM scores GROUP BY ALL)) GROUP BY ALL)"""


def with_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "key",
        condition_key(
            F.col("dataset"), F.col("retained_fraction_token"), F.col("seed"), F.col("model")
        ),
    )


KEY_SQL = "dataset || '__' || retained_fraction_token || '__seed_' || lpad(CAST(seed AS VARCHAR), 2, '0') || '__' || model"

# --- the 540-condition grid, and runs of it from events

GRID_SQL = """
levels AS (
  SELECT * FROM (VALUES (0, 'diabetes', '0.01', '001pct'), (1, 'diabetes', '0.05', '005pct'),
    (2, 'diabetes', '0.10', '010pct'), (3, 'diabetes', '0.25', '025pct'), (4, 'diabetes', '0.50', '050pct'),
    (5, 'cleveland', '0.05', '005pct'), (6, 'cleveland', '0.10', '010pct'),
    (7, 'cleveland', '0.25', '025pct'), (8, 'cleveland', '0.50', '050pct'))
    t(place, dataset, fraction, retained_fraction_token)),
grid AS (
  SELECT CAST((place * 30 + s.seed) * 2 + m.i AS BIGINT) AS ordinal, dataset,
         CAST(fraction AS DECIMAL(3,2)) AS retained_fraction, retained_fraction_token,
         CAST(s.seed AS INT) AS seed, m.model,
         dataset || '__' || retained_fraction_token || '__seed_' || lpad(CAST(s.seed AS VARCHAR), 2, '0') || '__' || m.model AS key
  FROM levels, range(0, 30) s(seed), (VALUES (0, 'logistic_regression'), (1, 'random_forest')) m(i, model))"""


def grid(spark: SparkSession) -> DataFrame:
    return condition_grid(spark, scarcity_study())


def run_columns() -> list:
    """Each 540 consecutive events are one run of the grid."""
    return [
        F.floor(F.col("event_id") / 540).cast("long").alias("run"),
        (F.col("event_id") % 540).alias("ordinal"),
    ]


def events_on_grid(spark: SparkSession, sf: str) -> DataFrame:
    events = spread(table(spark, sf, "events"), KEY_ROWS).select("*", *run_columns())
    return events.join(F.broadcast(grid(spark)), "ordinal")


EVENTS_SQL = (
    GRID_SQL
    + """,
on_grid AS (
  SELECT e.*, e.event_id // 540 AS run, g.*
  FROM events e JOIN grid g ON e.event_id % 540 = g.ordinal)"""
)


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """The expected (run, key) pairs: the grid once for every run that events touch.

    The runs are few and small; they are dealt out by the number of rows they become.
    """
    touched = settle(table(spark, sf, "events").select(run_columns()[0]).distinct())
    touched = spread(touched, KEY_ROWS // 540)
    ordinals = touched.withColumn(
        "ordinal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(539).cast("long")))
    )
    return ordinals.join(F.broadcast(grid(spark)), "ordinal")


RUNS_SQL = "runs AS (SELECT r.run, g.* FROM (SELECT DISTINCT event_id // 540 AS run FROM events) r, grid g)"


def dirty_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metric rows with known faults: gaps, repeats, foreign seeds, bad values, bad keys."""
    rows = events_on_grid(spark, sf)
    kind, user = F.col("event_type"), F.col("user_id")
    foreign = (kind == "click") & (user % 17 == 0)
    shifted = rows.filter(~((kind == "signup") & (user % 11 == 0))).withColumn(
        "seed", F.when(foreign, F.col("seed") + 30).otherwise(F.col("seed"))
    )
    copies = F.when((kind == "view") & (user % 13 == 0), 2).otherwise(1)
    return (
        with_key(shifted)
        .withColumn(
            "key",
            F.when((kind == "purchase") & (user % 19 == 0), F.concat("key", F.lit("x"))).otherwise(
                F.col("key")
            ),
        )
        .withColumn(
            "roc_auc",
            F.when((kind == "error") & (user % 7 == 0), F.lit(1.5))
            .when((kind == "error") & (user % 29 == 0), F.lit(float("nan")))
            .otherwise((F.col("event_id") * 7919 % 1000) / 1000.0),
        )
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
        .select("run", "ordinal", "key", *KEYS, "roc_auc")
    )


DIRTY_SQL = (
    EVENTS_SQL
    + f""",
moved AS (
  SELECT * REPLACE (CAST(CASE WHEN event_type = 'click' AND user_id % 17 = 0 THEN seed + 30 ELSE seed END AS INT) AS seed)
  FROM on_grid WHERE NOT (event_type = 'signup' AND user_id % 11 = 0)),
dirty AS (
  SELECT run, ordinal, ({KEY_SQL}) || CASE WHEN event_type = 'purchase' AND user_id % 19 = 0 THEN 'x' ELSE '' END AS key,
         dataset, retained_fraction, retained_fraction_token, seed, model,
         CASE WHEN event_type = 'error' AND user_id % 7 = 0 THEN 1.5
              WHEN event_type = 'error' AND user_id % 29 = 0 THEN CAST('nan' AS DOUBLE)
              ELSE (event_id * 7919 % 1000) / 1000.0 END AS roc_auc
  FROM moved, range(1, CASE WHEN event_type = 'view' AND user_id % 13 = 0 THEN 3 ELSE 2 END) c(i))"""
)
