"""Class-stratified splits and nested subsets, ordered by digest.

Exact class counts come from one aggregate. Which rows fill them is decided by a
digest cut-off per (seed, class), so applying a split is a scan with a broadcast
lookup: rows are not shuffled, and a retry or another partitioning gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.digests import draw_digest
from pairwright.functions.keys import fraction_token
from pairwright.functions.scores import round_half_up
from pairwright.operators.gates import require_empty
from pairwright.operators.ordering import (
    BUCKET_ROWS,
    digest_cutoffs,
    digest_digits,
    settle,
    within_cut,
)
from pairwright.study import TEST_SIZE


def class_counts(rows: DataFrame, group: Sequence[str], label: str = "target") -> DataFrame:
    return rows.groupBy(*group, label).agg(F.count(F.lit(1)).alias("n"))


EVERYONE = "_everyone"


def allocate_class_counts(
    counts: DataFrame,
    group: Sequence[str],
    total: str | Column,
    label: str = "target",
    minimum: int = 2,
    name: str = "total",
) -> DataFrame:
    """Split ``total`` of each group over its classes; one row per (group, class).

    ``total`` is a column of ``counts`` that is constant in a group, or an expression
    over the group columns and ``EVERYONE``, the rows of the group; ``name`` names it.

    Largest remainders: every class gets the whole part of its share, and the seats left
    go to the largest remainders, equal ones to the smaller label. A class below
    ``minimum`` is lifted from the largest class that can spare the rows. Products are
    decimals, so shares stay exact for any row count. A total that cannot keep the
    minimum gives a null allocation (see ``allocation_violations``).

    ``counts`` has one row per group and class: a table of grid size.
    """
    wide = lambda name: f"CAST({name} AS DECIMAL(19,0))"
    share = f"{wide('c.n')} * {wide('_total')}"
    lack = f"greatest(0L, {minimum} - seats[place])"
    donor = (
        "array_min(filter(transform(seats, (seat, i) -> named_struct('lack', -seat, 'i', i)), "
        f"d -> d.i <> place AND -d.lack - {lack} >= {minimum})).i"
    )
    lifted = (
        "aggregate(sequence(0, size(_classes) - 1), _seats, (seats, place) -> transform(seats, "
        f"(seat, i) -> CASE WHEN {lack} = 0 THEN seat WHEN i = place THEN seat + {lack} "
        f"WHEN i = {donor} THEN seat - {lack} ELSE seat END))"
    )
    keys = [*group, total] if isinstance(total, str) else list(group)
    name = total if isinstance(total, str) else name
    return (
        counts.groupBy(*keys)
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(F.col(label).alias("label"), F.col("n").cast("long").alias("n"))
                )
            ).alias("_classes"),
            F.sum("n").cast("long").alias(EVERYONE),
        )
        .withColumn(name, F.col(total) if isinstance(total, str) else total.cast("long"))
        .withColumn("_total", F.col(name).cast("long"))
        .withColumn(
            "_shares",
            F.expr(
                f"transform(_classes, c -> named_struct('label', c.label, "
                f"'low', ({share}) div {wide('_everyone')}, "
                f"'rest', CAST(({share}) % {wide('_everyone')} AS BIGINT)))"
            ),
        )
        .withColumn("_open", F.expr("_total - aggregate(_shares, 0L, (t, s) -> t + s.low)"))
        .withColumn(
            "_seats",
            F.expr(
                "transform(_shares, s -> s.low + CASE WHEN size(filter(_shares, o -> o.rest > s.rest "
                "OR (o.rest = s.rest AND o.label < s.label))) < _open THEN 1L ELSE 0L END)"
            ),
        )
        .withColumn(
            "_seats",
            F.expr(
                f"CASE WHEN _total >= {minimum} * size(_classes) "
                f"THEN {lifted if minimum else '_seats'} END"
            ),
        )
        .select(
            *group, name, EVERYONE, F.posexplode("_classes").alias("_i", "_class"), "_seats"
        )
        .select(
            *group,
            name,
            F.col(EVERYONE).alias("everyone"),
            F.col("_class.label").alias(label),
            F.col("_class.n").alias("n"),
            F.expr("get(_seats, _i)").alias("allocation"),
        )
    )


def allocation_violations(allocated: DataFrame, group: Sequence[str], total: str) -> DataFrame:
    return (
        allocated.groupBy(*group, total)
        .agg(F.sum("allocation").alias("given"), F.count_if(F.expr("allocation IS NULL")).alias("open"))
        .select(
            *group,
            F.when(F.col("open") > 0, "total_below_minimum")
            .when(F.col("given") != F.col(total), "allocation_does_not_sum")
            .alias("code"),
        )
        .filter("code IS NOT NULL")
    )


def held_out(counts: DataFrame, test_size: Decimal = TEST_SIZE, label: str = "target") -> DataFrame:
    """Test and train rows per class: ceil(test_size * n) test rows, split by class."""
    wanted = F.ceil(
        F.col(EVERYONE).cast("decimal(19,0)") * F.lit(test_size).cast("decimal(9,8)")
    ).cast("long")
    return (
        allocate_class_counts(counts, [], wanted, label, minimum=0, name="test_rows")
        .withColumnRenamed("allocation", "n_test")
        .withColumn("n_train", F.col("n") - F.col("n_test"))
    )


class Sampler:
    """Split and nested subsets of one labelled table for all seeds at once.

    The cut-offs are computed on first use and kept; they hold one row per
    (seed, class) and per (seed, class, fraction).
    """

    def __init__(
        self,
        rows: DataFrame,
        dataset: str,
        seeds: Sequence[int],
        fractions: Sequence[Decimal] = (),
        *,
        row_id: str = "row_id",
        label: str = "target",
        test_size: Decimal = TEST_SIZE,
        split_namespace: str = "pairwright.split.v1",
        subset_namespace: str = "pairwright.subset.v1",
        bucket_rows: int = BUCKET_ROWS,
    ) -> None:
        self.rows, self.dataset, self.row_id, self.label = rows, dataset, row_id, label
        self.seeds = tuple(seeds)
        self.fractions = tuple(sorted(Decimal(f) for f in fractions))
        self.test_size = test_size
        self.split_namespace, self.subset_namespace = split_namespace, subset_namespace
        self.bucket_rows = bucket_rows
        self._memo: dict[str, object] = {}

    def _once(self, name, make):
        if name not in self._memo:
            self._memo[name] = make()
        return self._memo[name]

    def _seeded(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in self.seeds])))

    def _digest(self, namespace: str) -> Column:
        return draw_digest(
            namespace, F.lit(self.dataset), F.col("seed"), F.col(self.label), F.col(self.row_id)
        )

    @property
    def counts(self) -> DataFrame:
        """Rows per class, with test and train counts."""
        return self._once(
            "counts",
            lambda: settle(
                held_out(class_counts(self.rows, [], self.label), self.test_size, self.label)
            ),
        )

    @property
    def largest_class(self) -> int:
        return self._once("largest", lambda: self.counts.agg(F.max("n")).first()[0] or 0)

    @property
    def split_cuts(self) -> DataFrame:
        def make() -> DataFrame:
            quotas = self._seeded(self.counts.select(self.label, F.col("n_test").alias("_quota")))
            keyed = self._seeded(self.rows.select(self.row_id, self.label)).withColumn(
                "_digest", self._digest(self.split_namespace)
            )
            return digest_cutoffs(
                keyed, ["seed", self.label], quotas, row_id=self.row_id,
                digits=digest_digits(self.largest_class, self.bucket_rows),
            )

        return self._once("split", make)

    def split(self, rows: DataFrame | None = None) -> DataFrame:
        """Every row once per seed, with ``part`` train or test."""
        source = self.rows if rows is None else rows
        return (
            self._seeded(source)
            .withColumn("_digest", self._digest(self.split_namespace))
            .join(self.split_cuts, ["seed", self.label], "left")
            .withColumn(
                "part", F.when(within_cut(row_id=self.row_id), "test").otherwise("train")
            )
            .drop("_digest", "_quota", "_cut_digest", "_cut_id")
        )

    def train(self, rows: DataFrame | None = None) -> DataFrame:
        return self.split(rows).filter("part = 'train'").drop("part")

    def test(self, rows: DataFrame | None = None) -> DataFrame:
        return self.split(rows).filter("part = 'test'").drop("part")

    @property
    def allocations(self) -> DataFrame:
        """Retained rows per (fraction, class): the prefix each subset keeps."""

        def make() -> DataFrame:
            levels = F.array(*[F.lit(f).cast("decimal(3,2)") for f in self.fractions])
            counts = self.counts.select(
                self.label, F.col("n_train").alias("n"),
                F.explode(levels).alias("retained_fraction"),
            )
            size = round_half_up(
                F.col(EVERYONE).cast("decimal(19,0)") * F.col("retained_fraction")
            )
            given = settle(
                allocate_class_counts(
                    counts, ["retained_fraction"], size, self.label, name="retained_size"
                )
            )
            require_empty(
                allocation_violations(given, ["retained_fraction"], "retained_size"),
                f"retained rows of {self.dataset}",
            )
            return given.withColumnRenamed("everyone", "pool")

        return self._once("allocations", make)

    @property
    def retained_counts(self) -> DataFrame:
        """Rows per (seed, fraction, class) of the subsets, known without reading them."""
        return self._seeded(
            self.allocations.select(
                F.lit(self.dataset).alias("dataset"),
                fraction_token(F.col("retained_fraction")).alias("retained_fraction_token"),
                self.label,
                F.col("allocation").alias("n"),
            )
        )

    @property
    def subset_cuts(self) -> DataFrame:
        def make() -> DataFrame:
            quotas = self._seeded(
                self.allocations.select(
                    "retained_fraction", self.label, F.col("allocation").alias("_quota")
                )
            )
            keyed = self.train(self.rows.select(self.row_id, self.label)).withColumn(
                "_digest", self._digest(self.subset_namespace)
            )
            return digest_cutoffs(
                keyed, ["seed", self.label], quotas, ["retained_fraction"], row_id=self.row_id,
                digits=digest_digits(self.largest_class, self.bucket_rows),
            )

        return self._once("subset", make)

    def subsets(self, rows: DataFrame | None = None) -> DataFrame:
        """The retained training rows of every (seed, fraction)."""
        return (
            self.train(rows)
            .withColumn("_digest", self._digest(self.subset_namespace))
            .join(self.subset_cuts, ["seed", self.label])
            .filter(within_cut(row_id=self.row_id))
            .drop("_digest", "_quota", "_cut_digest", "_cut_id")
            .withColumn("retained_fraction_token", fraction_token(F.col("retained_fraction")))
        )


def nestedness_violations(allocations: DataFrame, label: str = "target") -> DataFrame:
    """Allocations that decrease from one fraction to the next larger one."""
    from pyspark.sql import Window

    along = Window.partitionBy(label).orderBy("retained_fraction")
    return (
        allocations.withColumn("_previous", F.lag("allocation").over(along))
        .filter(F.col("allocation") < F.col("_previous"))
        .select(label, "retained_fraction", F.lit("allocation_decreased").alias("code"))
    )


def subset_gaps(subsets: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows kept at some fraction but missing at a larger one."""
    levels = subsets.select("seed", "retained_fraction").distinct()
    kept = subsets.groupBy("seed", row_id).agg(
        F.min("retained_fraction").alias("first_fraction"), F.count(F.lit(1)).alias("kept_levels")
    )
    from pyspark.sql import Window

    down = Window.partitionBy("seed").orderBy(F.desc("retained_fraction"))
    expected = levels.withColumn("want_levels", F.row_number().over(down))
    return (
        kept.join(
            expected.withColumnRenamed("retained_fraction", "first_fraction"),
            ["seed", "first_fraction"],
        )
        .filter(F.col("kept_levels") != F.col("want_levels"))
        .select("seed", row_id, F.lit("subset_not_nested").alias("code"))
    )
