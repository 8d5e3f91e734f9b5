"""Condition identity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fraction_token(fraction: Column) -> Column:
    """``0.05`` -> ``005pct``; exact because fractions are DECIMAL(3,2)."""
    percent = (fraction.cast("decimal(3,2)") * 100).cast("int").cast("string")
    return F.concat(F.lpad(percent, 3, "0"), F.lit("pct"))


def percent_token(fraction: Column) -> Column:
    """The second published form: round(f * 100), zero-padded to three digits."""
    return F.format_string("%03dpct", F.round(fraction.cast("double") * 100).cast("int"))


def condition_key(dataset: Column, token: Column, seed: Column, model: Column) -> Column:
    return F.format_string("%s__%s__seed_%02d__%s", dataset, token, seed.cast("int"), model)


def archive_path(dataset: Column, fraction: Column, seed: Column, model: Column) -> Column:
    return F.format_string(
        "%s/seed_%02d/%s_%s.npz", dataset, seed.cast("int"), model, percent_token(fraction)
    )


def identity() -> Column:
    """The key recomputed from the identity columns of a condition row."""
    return condition_key(
        F.col("dataset"),
        fraction_token(F.col("retained_fraction")),
        F.col("seed"),
        F.col("model"),
    )
