"""File inventories, source manifests and outputs that are written once."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators.gates import GateError, ledger_gate, require_empty
from pairwright.operators.grid import key_set_digest
from pairwright.operators.ordering import side_by_side
from pairwright.operators.shared import settle
from pairwright.operators.reconcile import manifest_vs_files, package_digest, reuse_identity
from pairwright.sources.commits import CommitLog
from pairwright.sources.tables import header_of, scan_metric_keys


HASH_BLOCK = 4 << 20  # bytes read at a time
LISTING = "path STRING, bytes LONG"


def _opened(path: str) -> tuple[pafs.FileSystem, str, str]:
    """File system of a path, the path there, and what stands before it."""
    scheme, rest = path.split("://", 1)
    if scheme == "file":
        return pafs.LocalFileSystem(), rest, "file://"
    authority, _, place = rest.partition("/")
    files, base = pafs.FileSystem.from_uri(f"{scheme}://{authority}/")
    base = base.rstrip("/")
    return files, f"{base}/{place}", f"{scheme}://{authority}".removesuffix(base)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folders to their entries: folders again (``bytes`` null) and files."""
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            files, place, prefix = _opened(folder)
            found = files.get_file_info(pafs.FileSelector(place))
            found = [f for f in found if not f.base_name.startswith((".", "_"))]
            sizes = [f.size if f.type == pafs.FileType.File else None for f in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([prefix + f.path for f in found], pa.string()), pa.array(sizes, pa.int64())],
                names=["path", "bytes"],
            )


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes) of every file below ``root``, as a table.

    Folders are listed by tasks, one level of the tree in each pass; hidden entries, those
    that begin with a dot or an underscore, are left out. A number a level comes to the driver.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = base.getFileSystem(spark._jsc.hadoopConfiguration())
    top = re.sub("^file:/+", "file:///", files.makeQualified(base).toString())
    level = spark.createDataFrame([(top,)], "path STRING")
    levels = []
    while True:
        found = settle(level.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(_listed, LISTING))
        levels.append(found.filter("bytes IS NOT NULL"))
        level = found.filter("bytes IS NULL").select("path")
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for path in batch.column(0).to_pylist():
            files, place, _ = _opened(path)
            digest = hashlib.sha256()
            with files.open_input_stream(place) as stream:
                while block := stream.read(HASH_BLOCK):
                    digest.update(block)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=["path", "bytes", "sha256"])


def file_inventory(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path below root, bytes, sha256) of every file whose name fits ``pattern``.

    Listing and hashing run in tasks; a file of any size is read as a stream, in blocks of
    ``HASH_BLOCK`` bytes. Large files come first and are dealt out one by one.
    """
    like = "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"
    listing = file_listing(spark, root)
    chosen = listing.filter(F.substring_index("path", "/", -1).rlike(like))
    total, most = chosen.agg(F.count(F.lit(1)), F.max("bytes")).first()
    parts = max(1, min(total, 8 * spark.sparkContext.defaultParallelism + total // 1000))
    hashed = chosen.repartition(parts, "path").sortWithinPartitions(F.desc("bytes")).mapInArrow(
        _hashed, "path STRING, bytes LONG, sha256 STRING"
    )
    base = root.rstrip("/") + "/"
    return hashed.withColumn("path", F.expr(f"substring_index(path, '{base}', -1)"))


def same_content(left: DataFrame, right: DataFrame) -> bool:
    """Equal as bags of rows, column by column name."""
    right = right.select(*left.columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def write_once(rows: DataFrame, path: str) -> str:
    """Write ``rows`` as Parquet, or find the very same rows there.

    Returns ``written`` or ``unchanged``; other content at ``path`` is an error and
    stays as it is. The rows are written beside ``path`` and renamed when complete, and a
    folder there without its success marker, left by a failed job, counts as absent.
    """
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if files.exists(mark):
        stored = spark.read.parquet(path)
        if set(stored.columns) != set(rows.columns) or not same_content(stored, rows):
            raise GateError(f"different content already stored at {path}")
        return "unchanged"
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    if files.exists(place):
        files.delete(place, True)
    if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), place):
        raise GateError(f"could not move the complete output to {path}")
    return "written"


def read_ledger(spark: SparkSession, path: str, schema) -> DataFrame:
    """The committed rows of the ledger at ``path``."""
    return CommitLog(spark, path).read("ledger", schema)


def append_ledger(rows: DataFrame, path: str, run: str = "run") -> int:
    """Append terminal rows, gated first, in one commit; its number.

    A key has one terminal row in a run: repeats inside the batch and keys that the ledger
    has are refused. Several writers may append at once. Each stages its rows and then takes
    the next free commit number; one that comes second first looks at the rows that came in
    between, so of two rows of one (run, key) only the first is ever committed.
    """
    spark = rows.sparkSession
    require_empty(ledger_gate(rows, [run, "key"]), "ledger rows")
    twice = rows.groupBy(run, "key").count().filter("count > 1")
    require_empty(twice.select(run, "key", F.lit("repeated_in_batch").alias("code")), "ledger rows")
    log = CommitLog(spark, path)
    keys = rows.select(run, "key")

    def check(since: int, upto: int) -> None:
        stored = log.read("ledger", keys.schema, since, upto)
        there = keys.join(stored, [run, "key"], "left_semi")
        require_empty(there.withColumn("code", F.lit("already_terminal")), "ledger rows")

    check(0, log.versions())
    return log.commit(log.stage({"ledger": rows}), check)


def source_manifest(
    spark: SparkSession, root: str, tables: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Inventory of input tables with columns, key count and key digest.

    ``tables`` maps metric CSV names to their expected columns; other files get nulls.
    """
    inventory = file_inventory(spark, root)
    reports = None
    for name, columns in tables.items():
        path = f"{root.rstrip('/')}/{name}"
        found = header_of(spark, path)
        keys = scan_metric_keys(spark, path, columns).withColumn("path", F.lit(name))
        counted = keys.groupBy("path").agg(
            F.count(F.lit(1)).alias("row_count"), F.count_distinct("key").alias("key_count")
        )
        report = counted.join(
            key_set_digest(keys, ["path"], name="keys_sha256"), "path"
        ).withColumn("columns", F.lit(",".join(found)))
        reports = report if reports is None else reports.unionByName(report)
    return inventory if reports is None else inventory.join(reports, "path", "left")


def manifest_drift(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows of either manifest that the other does not have."""
    rebuilt = rebuilt.select(*stored.columns)
    return (
        stored.exceptAll(rebuilt)
        .withColumn("side", F.lit("stored"))
        .unionByName(rebuilt.exceptAll(stored).withColumn("side", F.lit("rebuilt")))
    )


def expected_package(keys: DataFrame) -> DataFrame:
    """Paths a complete run leaves: two files per key and one report."""
    spark = keys.sparkSession
    per_key = keys.select(
        F.explode(
            F.array(
                F.concat(F.lit("checkpoints/"), "key", F.lit(".json")),
                F.concat(F.lit("predictions/"), "key", F.lit(".npz")),
            )
        ).alias("path")
    )
    return per_key.unionByName(spark.createDataFrame([("operational_report.json",)], "path STRING"))


def evidence_manifest(
    inventory: DataFrame, keys: DataFrame, earlier: DataFrame, reused_keys: DataFrame
) -> DataFrame:
    """One row: package identity, missing and unexpected paths, and reuse identity.

    ``earlier`` is the inventory of the run whose artifacts were taken over.
    """
    expected = expected_package(keys)
    missing = expected.join(inventory, "path", "left_anti").agg(
        F.count(F.lit(1)).alias("missing_paths")
    )
    unexpected = inventory.join(expected, "path", "left_anti").agg(
        F.count(F.lit(1)).alias("unexpected_paths")
    )
    taken = expected_package(reused_keys).filter("path <> 'operational_report.json'")
    reuse = reuse_identity(earlier.join(taken, "path", "left_semi"), inventory, ["path"]).agg(
        F.count(F.lit(1)).alias("reused_files"),
        F.coalesce(F.every("byte_identical"), F.lit(True)).alias("reuse_byte_identical"),
    )
    return side_by_side(package_digest(inventory), missing, unexpected, reuse)


def bundle_violations(
    spark: SparkSession, root: str, declared: DataFrame, suffix: str = ".npz"
) -> DataFrame:
    """Declared entries against the files below ``root``."""
    return manifest_vs_files(declared, file_inventory(spark, root, f"*{suffix}"))
