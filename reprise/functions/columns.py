"""Helpers for columns of nested values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` uses it; within a lambda a column is computed at every use."""
    return F.transform(F.array(value), body)[0]
