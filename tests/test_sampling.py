from __future__ import annotations

import hashlib
import math
import random
from decimal import Decimal

from conftest import rows
from pyspark.sql import functions as F

from pairwright.operators import sampling as S
from pairwright.operators.ordering import (
    digest_bucket,
    digest_digits,
    id_bucket,
    id_buckets,
    range_bucket,
    ranked,
    settle,
    splitters,
)
from pairwright.study import decimals

FRACTIONS = decimals("0.05", "0.25", "0.50")


def allocate(counts, total, minimum):
    """Brute force of the largest-remainder rule with the minimum step."""
    everyone = sum(counts.values())
    seats = {k: n * total // everyone for k, n in counts.items()}
    rest = {k: n * total % everyone for k, n in counts.items()}
    for k in sorted(counts, key=lambda k: (-rest[k], k))[: total - sum(seats.values())]:
        seats[k] += 1
    for k in sorted(counts):
        lack = max(0, minimum - seats[k])
        if lack:
            donor = next(d for d in sorted(seats, key=lambda d: (-seats[d], d))
                         if d != k and seats[d] - lack >= minimum)
            seats[donor] -= lack
            seats[k] += lack
    return seats


def test_published_allocation_and_tie(spark):
    frame = spark.createDataFrame([("g", 0, 7, 5), ("g", 1, 3, 5)], "g STRING, target INT, n LONG, total LONG")
    get = lambda minimum: dict(rows(
        S.allocate_class_counts(frame, ["g"], "total", minimum=minimum), "target", "allocation"))
    assert get(2) == {0: 3, 1: 2}
    assert get(0) == {0: 4, 1: 1}


def test_allocation_matches_brute_force(spark):
    random.seed(3)
    groups, data = {}, []
    for g in range(400):
        classes = random.choice([2, 2, 2, 3, 4])
        counts = {k: random.choice([1, 2, 3, 5, 50, 999]) for k in range(classes)}
        total = random.randrange(2 * classes, 2 * classes + 60)
        try:
            groups[g] = allocate(counts, total, 2)
        except StopIteration:
            continue
        data += [(g, k, n, total) for k, n in counts.items()]
    frame = spark.createDataFrame(data, "g INT, target INT, n LONG, total LONG")
    got = S.allocate_class_counts(frame, ["g"], "total")
    assert rows(got, "g", "target", "allocation") == sorted(
        (g, k, n) for g, seats in groups.items() for k, n in seats.items())
    assert S.allocation_violations(got, ["g"], "total").isEmpty()


def test_allocation_is_exact_for_huge_counts(spark):
    n0, n1, total = 333_333_333_333, 666_666_666_667, 499_999_999_999
    frame = spark.createDataFrame([(0, n0, total), (1, n1, total)], "target INT, n LONG, total LONG")
    got = dict(rows(S.allocate_class_counts(frame, [], "total"), "target", "allocation"))
    assert got == allocate({0: n0, 1: n1}, total, 2)


def test_total_below_minimum_is_reported(spark):
    frame = spark.createDataFrame([(0, 5, 3), (1, 5, 3)], "target INT, n LONG, total LONG")
    given = S.allocate_class_counts(frame, [], "total")
    assert rows(S.allocation_violations(given, [], "total"), "code") == [("total_below_minimum",)]


def digest(namespace, seed, label, row):
    return hashlib.sha256(f"{namespace}|toy|{seed}|{label}|{row}".encode()).hexdigest()


def expected_split(table, seeds):
    counts = {k: sum(1 for t in table.values() if t == k) for k in (0, 1)}
    tests = allocate(counts, math.ceil(len(table) * Decimal("0.2")), 0)
    result = {}
    for seed in seeds:
        for label in (0, 1):
            order = sorted((digest("pairwright.split.v1", seed, label, r), r)
                           for r, t in table.items() if t == label)
            for place, (_, r) in enumerate(order):
                result[seed, r] = "test" if place < tests[label] else "train"
    return result


def toy(spark, n=500, parts=3):
    table = {i * 3: int(i % 7 < 2) for i in range(n)}
    frame = spark.createDataFrame(list(table.items()), "row_id LONG, target INT").repartition(parts)
    return table, frame


def test_split_matches_brute_force_for_every_bucket_size(spark):
    table, frame = toy(spark)
    want = sorted((s, r, p) for (s, r), p in expected_split(table, (0, 7)).items())
    for bucket_rows in (1_000_000, 40, 3):
        got = S.Sampler(frame, "toy", (0, 7), bucket_rows=bucket_rows).split()
        assert rows(got, "seed", "row_id", "part") == want


def test_subsets_are_nested_prefixes_with_exact_counts(spark):
    table, frame = toy(spark)
    split = expected_split(table, (0, 7))
    pool = {k: sum(1 for r, t in table.items() if t == k and split[0, r] == "train") for k in (0, 1)}
    want = []
    for fraction in FRACTIONS:
        size = math.floor(Decimal(sum(pool.values())) * fraction + Decimal("0.5"))
        seats = allocate(pool, size, 2)
        for seed in (0, 7):
            for label in (0, 1):
                order = sorted((digest("pairwright.subset.v1", seed, label, r), r)
                               for r, t in table.items() if t == label and split[seed, r] == "train")
                want += [(seed, f"{int(fraction * 100):03d}pct", r) for _, r in order[: seats[label]]]
    for bucket_rows in (1_000_000, 10):
        sample = S.Sampler(frame, "toy", (0, 7), FRACTIONS, bucket_rows=bucket_rows)
        kept = sample.subsets()
        assert rows(kept, "seed", "retained_fraction_token", "row_id") == sorted(want)
        assert S.subset_gaps(kept).isEmpty()
        assert S.nestedness_violations(sample.allocations).isEmpty()


def test_partitioning_does_not_change_a_sample(spark):
    _, frame = toy(spark)
    one = S.Sampler(frame.coalesce(1), "toy", (1,), FRACTIONS, bucket_rows=20).subsets()
    many = S.Sampler(frame.repartition(9), "toy", (1,), FRACTIONS, bucket_rows=20).subsets()
    columns = ("retained_fraction_token", "row_id")
    assert rows(one, *columns) == rows(many, *columns)


def test_a_hole_in_a_subset_is_found(spark):
    _, frame = toy(spark)
    kept = S.Sampler(frame, "toy", (1,), FRACTIONS).subsets()
    smallest = kept.filter("retained_fraction = 0.05").agg(F.min("row_id")).first()[0]
    broken = kept.filter(~((F.col("row_id") == smallest) & (F.col("retained_fraction") == 0.50)))
    assert rows(S.subset_gaps(broken), "row_id") == [(smallest,)]


def test_ranks_inside_one_hot_group(spark):
    data = [("hot", i) for i in range(3000)] + [("cold", i) for i in range(5)]
    frame = spark.createDataFrame(data, "g STRING, row_id LONG").withColumn(
        "d", F.sha2(F.concat_ws("|", "g", F.col("row_id").cast("string")), 256))
    by_digest = ranked(frame, ["g"], digest_bucket(F.col("d"), 2), ["d", "row_id"], "rank")
    for group in ("hot", "cold"):
        want = [r for _, r in sorted(
            (hashlib.sha256(f"{g}|{i}".encode()).hexdigest(), i) for g, i in data if g == group)]
        got = by_digest.filter(F.col("g") == group).orderBy("rank").select("rank", "row_id").collect()
        assert [r["rank"] for r in got] == list(range(len(want)))
        assert [r["row_id"] for r in got] == want
    by_id = ranked(frame, ["g"], id_bucket(F.col("row_id"), 64), ["row_id"], "rank")
    assert by_id.filter(F.col("rank") != F.col("row_id")).isEmpty()


def test_settle_checks_the_size(spark):
    frame = spark.range(50)
    assert settle(frame).count() == 50
    assert digest_digits(10, 100) == 0
    assert digest_digits(1000, 10) == 2


def test_splitters_cut_strings_in_order(spark):
    frame = spark.range(1000).select(F.format_string("p/%05d", "id").alias("path"))
    cuts = splitters(frame, "path", 8)
    got = frame.select("path", range_bucket(F.col("path"), cuts).alias("b")).orderBy("path").collect()
    buckets = [r["b"] for r in got]
    assert buckets == sorted(buckets) and len(set(buckets)) == len(cuts) + 1


def test_sparse_ids_are_cut_by_a_sample(spark):
    frame = spark.range(500).select(F.lit("g").alias("g"), (F.col("id") * 2**52).alias("row_id"))
    bucket = id_buckets(frame, "row_id")
    assert frame.select(bucket.alias("b")).distinct().count() > 50
    got = ranked(frame, ["g"], bucket, ["row_id"], "rank")
    assert got.filter(F.col("rank") * 2**52 != F.col("row_id")).isEmpty()
    dense = spark.range(500).withColumnRenamed("id", "row_id")
    assert dense.select(id_buckets(dense, "row_id").alias("b")).distinct().count() == 1
