"""Values bound once inside expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body, or a lambda in it, uses it.

    Lambdas of higher-order functions compute what they capture anew for each element; a bound value is only looked up.
    """
    return F.get(F.transform(F.array(value), body), 0)
