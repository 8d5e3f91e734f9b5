"""Restoration of a scarce table by class-preserving row replication."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.digests import is_sha256, order_digest, payload_digest
from pairwright.operators.ordering import (
    BUCKET_ROWS,
    CHUNK,
    digest_bucket,
    digest_cutoffs,
    digest_digits,
    id_buckets,
    ordered_digest,
    ranked,
    settle,
    within_cut,
)
from pairwright.operators.gates import require_empty
from pairwright.operators.sampling import (
    EVERYONE,
    allocate_class_counts,
    allocation_violations,
    class_counts,
)

CONDITION = ("dataset", "retained_fraction_token", "seed")


class Restorer:
    """Replication control for every condition in ``retained`` at once.

    ``retained`` has the condition columns, a unique row id, a label and any
    features; ``final_size`` is a column that is constant within a condition.
    ``counts`` may give the rows per (condition, class) if they are known already,
    which saves a pass over the rows.
    """

    def __init__(
        self,
        retained: DataFrame,
        final_size: Column,
        *,
        group: Sequence[str] = CONDITION,
        row_id: str = "row_id",
        label: str = "target",
        position: str | None = None,
        namespace: str = "pairwright.replication-order.v1",
        bucket_rows: int = BUCKET_ROWS,
        counts: DataFrame | None = None,
    ) -> None:
        self.group, self.row_id, self.label = list(group), row_id, label
        self.position, self.namespace, self.bucket_rows = position, namespace, bucket_rows
        self.retained = retained.withColumn("_final", final_size.cast("long"))
        self.counts = None if counts is None else counts.withColumn(
            "_final", final_size.cast("long")
        )
        self._plan: DataFrame | None = None
        self._places: DataFrame | None = None
        self._id_bucket: Column | None = None
        self._digits: int | None = None

    def _ordered(self, rows: DataFrame) -> DataFrame:
        dataset, token, seed = (F.col(name) for name in self.group)
        return rows.withColumn(
            "_digest",
            order_digest(
                self.namespace, dataset, token, seed, F.col(self.label), F.col(self.row_id)
            ),
        )

    @property
    def allocation(self) -> DataFrame:
        """One row per (condition, class): counts, duplicates, full cycles, rest."""
        if self._plan is None:
            below = (
                Window.partitionBy(*self.group)
                .orderBy(self.label)
                .rowsBetween(Window.unboundedPreceding, -1)
            )
            known = self.counts
            if known is None:
                known = class_counts(self.retained, [*self.group, "_final"], self.label)
            given = allocate_class_counts(
                known, [*self.group, "_final"], F.col("_final") - F.col(EVERYONE), self.label,
                minimum=0, name="n_extra",
            )
            given = settle(given)
            require_empty(
                allocation_violations(given, [*self.group, "_final"], "n_extra"),
                "rows to add",
            )
            self._plan = settle(
                given.withColumnRenamed("allocation", "duplicates")
                .withColumnRenamed("everyone", "n_original")
                .withColumn("class_offset", F.coalesce(F.sum("duplicates").over(below), F.lit(0)))
                .withColumn("cycles", F.floor(F.col("duplicates") / F.col("n")).cast("long"))
                .withColumn("_quota", (F.col("duplicates") % F.col("n")).cast("long"))
                .withColumnRenamed("_final", "final_size")
            )
            self._digits = digest_digits(
                self._plan.agg(F.max("n")).first()[0] or 0, self.bucket_rows
            )
        return self._plan

    def copies(self) -> DataFrame:
        """Retained rows with ``copies``, the duplicates each one gets.

        No row is shuffled: a row gets one copy more than the full cycles when its
        digest is below the cut-off of its class.
        """
        keys = [*self.group, self.label]
        plan = self.allocation
        ordered = self._ordered(self.retained.drop("_final"))
        cuts = digest_cutoffs(
            ordered, keys, plan.select(*keys, "cycles", "_quota"),
            row_id=self.row_id, digits=self._digits,
        )
        return (
            ordered.join(cuts, keys)
            .withColumn(
                "copies",
                F.col("cycles") + F.when(within_cut(row_id=self.row_id), 1).otherwise(0),
            )
            .drop("_digest", "_quota", "_cut_digest", "_cut_id", "cycles")
        )

    def placed(self) -> DataFrame:
        """Retained rows with their own place and their digest rank in the class."""
        return self._place(self.retained.drop("_final"))

    def _place(self, rows: DataFrame) -> DataFrame:
        """``placed`` of ``rows``, which may have their order digest already."""
        keys = [*self.group, self.label]
        plan = self.allocation.select(
            *keys, "n", "n_original", "class_offset", "cycles", "_quota"
        )
        known = rows if "_digest" in rows.columns else None
        if self.position is None:
            if self._id_bucket is None:
                self._id_bucket = id_buckets(rows, self.row_id)
            rows = ranked(rows, self.group, self._id_bucket, [self.row_id], "_own")
        else:
            rows = rows.withColumnRenamed(self.position, "_own")
        ordered = self._ordered(rows) if known is None else rows
        bucket = digest_bucket(F.col("_digest"), self._digits)
        return (
            ranked(ordered, keys, bucket, ["_digest", self.row_id], "rank",
                   counted=self._ordered(self.retained) if known is None else known)
            .join(plan, keys)
            .withColumn(
                "copies",
                F.col("cycles") + F.when(F.col("rank") < F.col("_quota"), 1).otherwise(0),
            )
            .drop("_digest")
        )

    def _placed_once(self) -> DataFrame:
        """The places and ranks alone, written once for all digests."""
        if self._places is None:
            own = [] if self.position is None else [self.position]
            rows = settle(
                self._ordered(self.retained.select(*self.group, self.label, self.row_id, *own))
            )
            self._places = settle(
                self._place(rows).select(
                    *self.group, self.label, self.row_id, "_own", "rank", "copies",
                    "n", "n_original", "class_offset", "cycles", "_quota",
                )
            )
        return self._places

    def restored(self) -> DataFrame:
        """Originals, then the class blocks of duplicates; ``pos`` gives the order.

        The place of a duplicate is arithmetic on its rank and cycle, so the union of
        originals and duplicates needs no sort.
        """
        return self._repeated(self.placed())

    def _repeated(self, placed: DataFrame) -> DataFrame:
        step = F.col("cycle")
        return (
            placed
            .withColumn("cycle", F.explode(F.sequence(F.lit(-1).cast("long"), F.col("copies") - 1)))
            .withColumn(
                "pos",
                F.when(step < 0, F.col("_own"))
                .otherwise(
                    F.col("n_original") + F.col("class_offset") + step * F.col("n") + F.col("rank")
                )
                .cast("long"),
            )
            .withColumn("is_duplicate", step >= 0)
            .drop("_own", "rank", "copies", "cycle", "n", "n_original", "class_offset",
                  "cycles", "_quota")
        )

    def class_blocks(self) -> DataFrame:
        """Audit rows per (condition, class): counts, balance and two digests."""
        keys = [*self.group, self.label]
        placed = self._placed_once()
        counts = placed.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("retained_source_count"),
            F.sum("copies").cast("long").alias("duplicate_count"),
            F.min("copies").alias("minimum_duplicates_per_source"),
            F.max("copies").alias("maximum_duplicates_per_source"),
        )
        row_id = F.col(self.row_id)
        sources = ordered_digest(placed, keys, "rank", ranked_source_indices_sha256=row_id)
        copies = placed.filter("copies > 0").withColumn(
            "cycle", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
        ).withColumn("_pos", F.col("cycle") * F.col("n") + F.col("rank"))
        block = ordered_digest(copies, keys, "_pos", duplicate_source_indices_sha256=row_id)
        return (
            counts.join(sources, keys)
            .join(block, keys, "left")
            .fillna({"duplicate_source_indices_sha256": EMPTY_SHA256})
        )

    def audit(self) -> DataFrame:
        """Audit row per condition: counts, class counts and sequence digests."""
        group, label = self.group, self.label
        plan = self.allocation
        per_class = lambda column: F.map_from_entries(
            F.sort_array(
                F.collect_list(F.struct(F.col(label).cast("string"), F.col(column).cast("long")))
            )
        )
        dataset, token, seed = (F.col(name) for name in group)
        counts = (
            plan.withColumn("_both", F.col("n") + F.col("duplicates"))
            .groupBy(*group)
            .agg(
                F.max("n_original").alias("original_count"),
                F.max("n_extra").alias("duplicate_count"),
                F.max("final_size").alias("final_count"),
                per_class("n").alias("retained_target_counts"),
                per_class("duplicates").alias("duplicate_target_counts"),
                per_class("_both").alias("final_target_counts"),
            )
            .withColumn(
                "canonical_contract_sha256",
                payload_digest(
                    namespace=F.lit(self.namespace), dataset=dataset,
                    retained_fraction_token=token, split_seed=seed,
                    class_labels=F.array(F.lit(0), F.lit(1)),
                ),
            )
        )
        # One pass: each restored row stands in the final sequence and in one of the two
        # others, at its place there.
        block = F.when(F.col("is_duplicate"), "duplicate").otherwise("original")
        own = F.col("pos") - F.when(F.col("is_duplicate"), F.col("n_original")).otherwise(0)
        entry = lambda name, place: F.struct(name.alias("sequence"), place.alias("_at"))
        digests = ordered_digest(
            self._repeated(self._placed_once())
            .join(plan.select(*group, "n_original").distinct(), group)
            .select(
                *group, self.row_id, label,
                F.inline(F.array(entry(F.lit("final"), F.col("pos")), entry(block, own))),
            ),
            [*group, "sequence"], "_at", ids=F.col(self.row_id), labels=F.col(label),
        )
        of = lambda sequence, column: F.max(
            F.when(F.col("sequence") == sequence, F.col(column))
        )
        wide = digests.groupBy(*group).agg(
            of("original", "ids").alias("original_source_indices_sha256"),
            F.coalesce(of("duplicate", "ids"), F.lit(EMPTY_SHA256)).alias(
                "duplicate_source_indices_sha256"
            ),
            of("final", "ids").alias("final_source_indices_sha256"),
            of("final", "labels").alias("final_target_labels_sha256"),
        )
        return counts.join(wide, group)


# The digest of a sequence without values.
EMPTY_SHA256 = hashlib.sha256(f"{CHUNK}:".encode()).hexdigest()


def restoration_input_violations(
    retained: DataFrame,
    final_size: Column,
    *,
    group: Sequence[str] = CONDITION,
    row_id: str = "row_id",
    label: str = "target",
) -> DataFrame:
    """Conditions whose retained table may not be restored, with the reason."""
    types = dict(retained.dtypes)
    for name in (row_id, label):
        if types[name] not in ("tinyint", "smallint", "int", "bigint"):
            raise TypeError(f"{name} must be an integer column, found {types[name]}")
    per_id = retained.withColumn("_final", final_size.cast("long")).groupBy(*group, row_id).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col(label).isin(0, 1) | F.col(label).isNull()).alias("foreign"),
        F.count_if(F.col(label) == 0).alias("zeros"),
        F.count_if(F.col(label) == 1).alias("ones"),
        F.min("_final").alias("final"),
    )
    summed = per_id.groupBy(*group).agg(
        F.max("n").alias("repeats"),
        F.count_if(F.col(row_id).isNull()).alias("null_ids"),
        F.min(row_id).alias("lowest"),
        F.sum("foreign").alias("foreign"),
        F.sum("zeros").alias("zeros"),
        F.sum("ones").alias("ones"),
        F.sum("n").alias("rows"),
        F.min("final").alias("final"),
    )
    codes = F.array(
        F.when(F.col("repeats") > 1, "row_id_not_unique"),
        F.when((F.col("lowest") < 0) | (F.col("null_ids") > 0), "row_id_negative_or_null"),
        F.when(
            (F.col("foreign") > 0) | (F.col("zeros") == 0) | (F.col("ones") == 0),
            "labels_not_zero_and_one",
        ),
        F.when(F.col("final") < F.col("rows"), "final_size_below_retained"),
    )
    return summed.select(
        *group, F.explode(F.filter(codes, lambda code: code.isNotNull())).alias("code")
    )


def restoration_violations(
    restored: DataFrame,
    allocation: DataFrame,
    *,
    group: Sequence[str] = CONDITION,
    row_id: str = "row_id",
    label: str = "target",
    planned: DataFrame | None = None,
) -> DataFrame:
    """Check size, class counts, order of originals and blocks, and the positions.

    ``planned``, the retained rows with their ``copies`` (:meth:`Restorer.copies`), adds the
    test of membership: each retained row stands once, with its planned duplicates, and no
    other row stands at all.
    """
    per_class = restored.groupBy(*group, label).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.expr("NOT is_duplicate")).alias("originals"),
        F.max(F.when(~F.col("is_duplicate"), F.col("pos"))).alias("last_original"),
        F.min(F.when(F.col("is_duplicate"), F.col("pos"))).alias("first_copy"),
        F.max(F.when(F.col("is_duplicate"), F.col("pos"))).alias("last_copy"),
        F.sum(F.col("pos").cast("decimal(38,0)")).alias("pos_sum"),
    )
    whole = Window.partitionBy(*group)
    checked = allocation.join(per_class, [*group, label], "full_outer").select(
        "*",
        F.sum("rows").over(whole).alias("all_rows"),
        F.sum("pos_sum").over(whole).alias("all_pos"),
    )
    start = F.col("n_original") + F.col("class_offset")
    size = F.col("all_rows").cast("decimal(19,0)")
    codes = F.array(
        F.when(~F.col("all_rows").eqNullSafe(F.col("final_size")), "wrong_final_size"),
        F.when(~F.col("rows").eqNullSafe(F.col("n") + F.col("duplicates")), "wrong_class_count"),
        F.when(~F.col("originals").eqNullSafe(F.col("n")), "foreign_or_missing_original"),
        F.when(F.col("last_original") >= F.col("n_original"), "originals_not_first"),
        F.when(
            (F.col("first_copy") < start) | (F.col("last_copy") >= start + F.col("duplicates")),
            "class_blocks_out_of_order",
        ),
        F.when(F.col("all_pos") * 2 != size * (size - 1), "positions_not_dense"),
    )
    found = checked.select(
        *group, label, F.explode(F.filter(codes, lambda code: code.isNotNull())).alias("code")
    )
    if planned is None:
        return found
    return found.unionByName(membership_violations(restored, planned, [*group, label], row_id))


def membership_violations(
    restored: DataFrame, planned: DataFrame, keys: Sequence[str], row_id: str = "row_id"
) -> DataFrame:
    """Classes with a row that was never retained, is missing, or has the wrong copies."""
    held = restored.groupBy(*keys, row_id).agg(
        F.count_if(~F.col("is_duplicate")).alias("_originals"),
        F.count_if("is_duplicate").alias("_duplicates"),
    )
    wanted = planned.select(*keys, row_id, F.col("copies").alias("_copies"))
    both = held.join(wanted, [*keys, row_id], "full_outer")
    codes = F.array(
        F.when(F.col("_copies").isNull(), "row_never_retained"),
        F.when(
            F.col("_copies").isNotNull() & (F.coalesce("_originals", F.lit(0)) != 1),
            "original_missing_or_repeated",
        ),
        F.when(F.coalesce("_duplicates", F.lit(0)) != F.col("_copies"), "wrong_copies_of_row"),
    )
    return both.select(
        *keys, F.explode(F.filter(codes, lambda code: code.isNotNull())).alias("code")
    ).distinct()


def allocation_record_violations(
    audit: DataFrame, blocks: DataFrame, *, group: Sequence[str] = CONDITION, label: str = "target"
) -> DataFrame:
    """Check that stored audit rows add up, per condition and per class block."""
    at = lambda column, key: F.element_at(F.col(column), key)
    both = lambda column: at(column, "0") + at(column, "1")
    digests = [name for name in audit.columns if name.endswith("_sha256")]
    codes = F.array(
        F.when(
            F.col("original_count") + F.col("duplicate_count") != F.col("final_count"),
            "total_count",
        ),
        F.when(
            (at("retained_target_counts", "0") + at("duplicate_target_counts", "0")
             != at("final_target_counts", "0"))
            | (at("retained_target_counts", "1") + at("duplicate_target_counts", "1")
               != at("final_target_counts", "1")),
            "class_count",
        ),
        F.when(both("retained_target_counts") != F.col("original_count"), "retained_sum"),
        F.when(both("duplicate_target_counts") != F.col("duplicate_count"), "duplicate_sum"),
        F.when(both("final_target_counts") != F.col("final_count"), "final_sum"),
        *[F.when(~is_sha256(F.col(name)), F.lit("hash_field")) for name in digests],
    )
    of_record = audit.select(
        *group,
        F.explode(F.array_distinct(F.filter(codes, lambda c: c.isNotNull()))).alias("code"),
    )
    joined = blocks.withColumnRenamed("duplicate_count", "k").join(
        audit.select(*group, "retained_target_counts", "duplicate_target_counts"), list(group)
    )
    n, k = F.col("retained_source_count"), F.col("k")
    low = F.floor(k / n).cast("long")
    mine = F.col(label).cast("string")
    block_codes = F.array(
        F.when(n <= 0, "block_without_sources"),
        F.when(
            (F.col("minimum_duplicates_per_source") != low)
            | (F.col("maximum_duplicates_per_source") != low + F.when(k % n != 0, 1).otherwise(0)),
            "floor_ceiling",
        ),
        F.when(
            (k != F.element_at(F.col("duplicate_target_counts"), mine))
            | (n != F.element_at(F.col("retained_target_counts"), mine)),
            "block_count",
        ),
    )
    of_blocks = joined.select(
        *group, F.explode(F.filter(block_codes, lambda c: c.isNotNull())).alias("code")
    )
    return of_record.unionByName(of_blocks)
