"""Registered queries over the given tables, each with its SQL twin where SQL can say it."""

from catalog.base import ORACLES, QUERIES
from catalog import (  # noqa: F401  (importing registers the queries)
    contrasts,
    expressions,
    gates,
    ledgers,
    models,
    predictions,
    sampling,
)

__all__ = ["ORACLES", "QUERIES"]
