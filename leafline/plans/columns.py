"""Helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row.

    A filter on a derived column is pushed below the projections, which puts the definitions of all
    columns into it in full; inside a function of array elements they would be computed for each element.
    """
    return F.get(F.transform(F.array(value), body), 0)
