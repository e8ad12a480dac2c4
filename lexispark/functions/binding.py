"""``let`` for Column expressions.

A lambda body is evaluated once per element, with all the expressions it
refers to; binding a value first keeps work on arrays linear.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once per row."""
    return F.get(F.transform(F.array(value), body), 0)
