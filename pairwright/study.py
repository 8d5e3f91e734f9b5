"""Study parameters: what a user declares before any table is read."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from decimal import Decimal

_PRINTABLE = re.compile(r"^[A-Za-z0-9_.\-]+$")

# Model and label names, and the practical threshold.
LOGISTIC = "logistic_regression"
FOREST = "random_forest"
HELPFUL = "helpful"
HARMFUL = "harmful"
NO_CLEAR = "no_clear_practically_meaningful_difference"
LABELS = (HARMFUL, NO_CLEAR, HELPFUL)
PRACTICAL_THRESHOLD = 0.01
RESAMPLES = 10_000
TEST_SIZE = Decimal("0.2")
TERMINAL_STATES = ("success", "failure", "timeout")


@dataclass(frozen=True)
class TableSpec:
    """One labelled table: its name, target and feature roles."""

    name: str
    target: str
    numeric: tuple[str, ...] = ()
    nominal: tuple[str, ...] = ()
    binary: tuple[str, ...] = ()
    fractions: tuple[Decimal, ...] = ()


@dataclass(frozen=True)
class Contrast:
    """``name`` is the metric of arm ``minuend`` minus that of ``subtrahend``."""

    name: str
    minuend: str
    subtrahend: str


@dataclass(frozen=True)
class Study:
    """The condition grid and the constants of the analysis.

    ``levels`` maps each dataset, in declared order, to its retained fractions.
    Namespaces separate the hash orders; pass those of an existing study to
    reproduce its digests.
    """

    levels: Mapping[str, tuple[Decimal, ...]]
    seeds: tuple[int, ...] = tuple(range(30))
    models: tuple[str, ...] = (LOGISTIC, FOREST)
    contrasts: tuple[Contrast, ...] = field(
        default=(
            Contrast("gaussian_minus_replication", "gaussian", "replication"),
            Contrast("replication_minus_real_only", "replication", "real_only"),
            Contrast("gaussian_minus_real_only", "gaussian", "real_only"),
        )
    )
    resamples: int = RESAMPLES
    threshold: float = PRACTICAL_THRESHOLD
    split_namespace: str = "pairwright.split.v1"
    subset_namespace: str = "pairwright.subset.v1"
    order_namespace: str = "pairwright.replication-order.v1"
    bootstrap_namespace: str = "pairwright.paired-bootstrap-seed.v1"

    def __post_init__(self) -> None:
        names = [*self.levels, *self.models, self.split_namespace,
                 self.subset_namespace, self.order_namespace, self.bootstrap_namespace]
        bad = [name for name in names if not _PRINTABLE.match(name)]
        if bad:
            raise ValueError(f"names must be plain printable text: {bad}")
        spaces = {self.split_namespace, self.subset_namespace, self.order_namespace}
        if len(spaces) != 3:
            raise ValueError("split, subset and order namespaces must differ")
        for fractions in self.levels.values():
            for fraction in fractions:
                if not Decimal("0") < Decimal(fraction) <= 1:
                    raise ValueError(f"retained fraction out of range: {fraction}")

    @property
    def size(self) -> int:
        """Number of conditions, the bound for every grid-sized table."""
        return sum(map(len, self.levels.values())) * len(self.seeds) * len(self.models)


def decimals(*values: str) -> tuple[Decimal, ...]:
    return tuple(Decimal(value) for value in values)


# The published two-table scarcity grid (540 conditions).
SCARCITY_LEVELS = {
    "diabetes": decimals("0.01", "0.05", "0.10", "0.25", "0.50"),
    "cleveland": decimals("0.05", "0.10", "0.25", "0.50"),
}
# The same with the full table, 660 conditions, largest first.
BASELINE_LEVELS = {
    "diabetes": decimals("1.00", "0.50", "0.25", "0.10", "0.05", "0.01"),
    "cleveland": decimals("1.00", "0.50", "0.25", "0.10", "0.05"),
}
# The 12-condition pilot and the 16-condition replay.
PILOT_LEVELS = {"diabetes": decimals("0.01", "0.50"), "cleveland": decimals("0.05")}
REPLAY_LEVELS = {
    "diabetes": decimals("0.01", "0.50"),
    "cleveland": decimals("0.05", "0.50"),
}
EDGE_SEEDS = (0, 29)


def scarcity_study() -> Study:
    return Study(levels=SCARCITY_LEVELS)


def baseline_study() -> Study:
    return Study(levels=BASELINE_LEVELS)


def pilot_study() -> Study:
    return Study(levels=PILOT_LEVELS, seeds=EDGE_SEEDS)


def replay_study() -> Study:
    return Study(levels=REPLAY_LEVELS, seeds=EDGE_SEEDS)
