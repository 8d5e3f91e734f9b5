"""Matched-control experiments on labelled tables, written on Spark DataFrames.

``functions``  column builders (keys, digests, scores)
``operators``  DataFrame-in, DataFrame-out operators
``sources``    readers and writers
``plans``      the composed jobs: analysis, condition grid, replay check
"""

from pairwright.study import Contrast, Study, TableSpec

__all__ = ["Contrast", "Study", "TableSpec"]
