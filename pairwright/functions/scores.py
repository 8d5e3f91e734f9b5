"""Scalar rules on labels, probabilities and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.study import HARMFUL, HELPFUL, NO_CLEAR, PRACTICAL_THRESHOLD

# 128 steps per power of two: at most 65,536 neighbouring FLOAT values share a step.
STEPS_PER_OCTAVE = 128
_LOWEST_EXPONENT = 150
_BEYOND = 1 << 40  # the step of infinity; NaN, which sorts last, has the one behind it


def round_half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5).cast("decimal(2,1)")).cast("long")


def binarize_target(value: Column) -> Column:
    return (value > 0).cast("tinyint")


def threshold_prediction(probability: Column) -> Column:
    return (probability >= F.lit(0.5)).cast("int")


def cast_prediction(y_true: Column, probability: Column) -> tuple[Column, Column]:
    return y_true.cast("tinyint").alias("y_true"), probability.cast("float").alias("probability")


def interpret_interval(
    lower: Column, upper: Column, threshold: float = PRACTICAL_THRESHOLD
) -> Column:
    return (
        F.when(lower > threshold, HELPFUL).when(upper < -threshold, HARMFUL).otherwise(NO_CLEAR)
    )


def is_finite(value: Column) -> Column:
    number = value.cast("double")
    return F.coalesce(
        ~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), F.lit(False)
    )


def score_bucket(score: Column) -> Column:
    """A non-decreasing step function of a FLOAT score.

    Depends on the value alone, so a retried task puts a row where it was before.
    A bucket holds at most 65,536 distinct FLOAT values, however skewed the data.
    Infinities and NaN have buckets of their own.
    """
    steps = lambda magnitude: F.floor(
        (F.log2(magnitude.cast("double")) + _LOWEST_EXPONENT) * STEPS_PER_OCTAVE
    )
    return (
        F.when(F.isnan(score), _BEYOND + 1)
        .when(score == float("inf"), _BEYOND)
        .when(score == float("-inf"), -_BEYOND)
        .when(score > 0, steps(score) + 1)
        .when(score < 0, -steps(-score) - 1)
        .otherwise(0)
    ).cast("long")
