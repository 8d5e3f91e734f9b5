"""Exact ranks and cut-offs inside groups of any size.

A window over a whole group would put that group in one task. Every operator here
first cuts the group into buckets by a rule that depends on the row alone (a digest
prefix, a step of the id or of the score), counts the buckets, and ranks only inside
a bucket. The bucket rule is repeatable, so a retried task cannot change a rank.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.operators.shared import settle

BUCKET_ROWS = 1_000_000  # rows one digest bucket should hold
ID_STEP = 1 << 20  # unique ids per id bucket
CHUNK = 1 << 20  # ordered values per digest chunk
KEY_ROWS = 250_000  # rows of a task that folds them by a key of (nearly) their own


def side_by_side(*totals: DataFrame) -> DataFrame:
    """One-row tables with different columns as one row, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), totals)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])


def spread(scan: DataFrame, rows: int | None = None) -> DataFrame:
    """A plain table scan in at least as many partitions as there are cores.

    For scans that feed much work per row (a digest per row and seed). A table with
    more splits than cores, so any large one, comes back as it is. With ``rows`` no
    partition has many more rows than that, however small the files are: for scans whose
    tasks hold something for each row.
    """
    parts = scan.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        parts = max(parts, -(-scan.count() // rows))
    return scan if scan.rdd.getNumPartitions() >= parts else scan.repartition(parts)


def digest_digits(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Hex digits of the digest prefix that keep a bucket near ``bucket_rows``."""
    digits = 0
    while rows > bucket_rows * 16**digits and digits < 6:
        digits += 1
    return digits


def digest_bucket(digest: Column, digits: int) -> Column:
    return F.substring(digest, 1, digits) if digits else F.lit("")


def id_bucket(row_id: Column, step: int = ID_STEP) -> Column:
    return F.floor(row_id / step).cast("long")


def id_buckets(rows: DataFrame, row_id: str, step: int = ID_STEP) -> Column:
    """Bucket rule for the ids of ``rows``, from one aggregate over them.

    Dense ids take fixed steps. Ids spread so thin that steps would hold few rows each
    are cut by a fixed sample of them instead.
    """
    low, high, count = rows.agg(F.min(row_id), F.max(row_id), F.count(row_id)).first()
    if not count or (high - low) // step <= 4 * (count // step) + 1024:
        return id_bucket(F.col(row_id), step)
    return range_bucket(F.col(row_id), splitters(rows, row_id, 256))


def ranked(
    rows: DataFrame,
    group: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    name: str,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add the zero-based rank of each row in its group, as ``name``.

    ``bucket`` must not decrease along ``order``. ``counted`` may give the same rows in
    an earlier, cheaper form to count the buckets from.
    """
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        (rows if counted is None else counted)
        .groupBy(*group, bucket.alias("_bucket"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_bucket", bucket)
        .withColumn("_inside", F.row_number().over(inside) - 1)
        .join(offsets, [*group, "_bucket"])
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_bucket", "_before", "_inside")
    )


def digest_cutoffs(
    rows: DataFrame,
    group: Sequence[str],
    quotas: DataFrame,
    tags: Sequence[str] = (),
    *,
    digest: str = "_digest",
    row_id: str = "row_id",
    quota: str = "_quota",
    digits: int = 0,
) -> DataFrame:
    """The digest and id of the last row taken for each ``(group, tags)`` quota.

    ``quotas`` is a settled table. No row of ``rows`` is shuffled: buckets are
    counted, the bucket in which a quota ends is found, and only the rows of that
    bucket are ranked.
    """
    wanted = quotas.filter(F.col(quota) > 0)
    if digits:
        running = Window.partitionBy(*group).orderBy("_bucket")
        counted = (
            rows.groupBy(*group, digest_bucket(F.col(digest), digits).alias("_bucket"))
            .agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_upto", F.sum("_n").over(running))
        )
        ends = settle(
            counted.join(wanted, list(group))
            .filter((F.col("_upto") >= F.col(quota)) & (F.col("_upto") - F.col("_n") < F.col(quota)))
            .select(*group, *tags, "_bucket",
                    (F.col(quota) - (F.col("_upto") - F.col("_n"))).alias("_left"))
        )
        last = (
            rows.select(*group, digest, row_id)
            .withColumn("_bucket", digest_bucket(F.col(digest), digits))
            .join(ends, [*group, "_bucket"])
        )
    else:
        last = rows.select(*group, digest, row_id).join(
            wanted.select(*group, *tags, F.col(quota).alias("_left")), list(group)
        )
    inside = Window.partitionBy(*group, *tags).orderBy(digest, row_id)
    cuts = (
        last.withColumn("_place", F.row_number().over(inside))
        .filter(F.col("_place") == F.col("_left"))
        .select(*group, *tags, F.col(digest).alias("_cut_digest"), F.col(row_id).alias("_cut_id"))
    )
    return settle(quotas.join(cuts, [*group, *tags], "left"))


def within_cut(digest: str = "_digest", row_id: str = "row_id") -> Column:
    """Whether a row joined with :func:`digest_cutoffs` is among those taken."""
    taken = (F.col(digest) < F.col("_cut_digest")) | (
        (F.col(digest) == F.col("_cut_digest")) & (F.col(row_id) <= F.col("_cut_id"))
    )
    return F.coalesce(taken, F.lit(False))


def _chunk_digests(keys: Sequence[str], names: Sequence[str], glue: str, end: str):
    """Arrow function: rows in the order of their places to one row of digests for each chunk.

    Several chunks may be open at once; each holds its digests only.
    """
    glued = glue.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[tuple, list] = {}
        kinds = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch.select(keys)
            kinds = held.schema
            code = np.zeros(batch.num_rows, np.int64)
            for column in held.columns:
                found = column.dictionary_encode(null_encoding="encode")
                code = code * len(found.dictionary) + found.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            starts = [0, *(np.flatnonzero(np.diff(code[order])) + 1).tolist(), len(order)]
            for start, stop in zip(starts, starts[1:]):
                mine = pa.array(order[start:stop])
                key = tuple(column[int(order[start])].as_py() for column in held.columns)
                if key not in chunks:
                    chunks[key] = [[hashlib.sha256(), b""] for _ in names]
                for name, state in zip(names, chunks[key]):
                    texts = batch.column(name).take(mine).drop_null()
                    if not len(texts):
                        continue
                    whole = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)
                    digest, before = state
                    digest.update(before)
                    digest.update(pc.binary_join(whole, glue)[0].as_buffer())
                    state[1] = glued
        if chunks:
            for states in chunks.values():
                for digest, _ in states:
                    digest.update(end.encode())
            columns = [pa.array([key[i] for key in chunks], kind.type) for i, kind in enumerate(kinds)]
            texts = [pa.array([states[i][0].hexdigest() for states in chunks.values()]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, *texts], names=[*keys, *names])

    return run


def ordered_digest(
    rows: DataFrame, group: Sequence[str], pos: str, *, glue: str = ",", **values: Column
) -> DataFrame:
    """SHA-256 of the values of each group, joined in the order of ``pos``.

    ``pos`` is dense from zero. Every sequence is cut into chunks of ``CHUNK`` values, so
    no task holds a whole group, and chunks are read as streams in the order of their places,
    so none holds a whole chunk. The digest is that of the text ``CHUNK:`` followed by
    the digests of the chunks, comma-joined: one definition at every length.
    """
    end = "\n" if glue == "\n" else ""
    keys = [*group, "_chunk"]
    listed = rows.select(
        *group, F.floor(F.col(pos) / CHUNK).cast("long").alias("_chunk"), F.col(pos).alias("_place"),
        *[value.alias(name) for name, value in values.items()],
    )
    ordered = listed.repartition(*keys).sortWithinPartitions("_place")
    texts = ordered.select(*keys, *[F.col(name).cast("string").alias(name) for name in values])
    chunks = texts.mapInArrow(_chunk_digests(keys, list(values), glue, end), texts.schema)

    def joined(name: str) -> Column:
        items = F.sort_array(F.collect_list(F.struct(F.col("_chunk").alias("p"), F.col(name).alias("v"))))
        return F.sha2(F.concat(F.lit(f"{CHUNK}:"), F.array_join(items["v"], ",")), 256)

    return chunks.groupBy(*group).agg(*[joined(name).alias(name) for name in values])


def splitters(rows: DataFrame, column: str, parts: int = 64) -> list:
    """Values that cut ``column`` into about equal ranges, as plain literals.

    The sample is the ``parts * 32`` rows with the smallest digests: a fixed choice,
    bounded, and taken by a distributed top-k.
    """
    digest = F.sha2(F.col(column).cast("string"), 256)
    sample = (
        rows.select(column).distinct().orderBy(digest).limit(parts * 32).toPandas()[column]
    )
    ordered = sorted(sample)
    step = max(1, len(ordered) // parts)
    return ordered[step::step]


def range_bucket(value: Column, cuts: Sequence) -> Column:
    """Number of cuts at or below ``value``, found by halving."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(cuts[middle]), search(low, middle)).otherwise(
            search(middle + 1, high)
        )

    return search(0, len(cuts))
