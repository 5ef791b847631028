"""Small helpers for expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being computed once even where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def pick(condition: Column, value: Column) -> Column:
    """An array that holds value where the condition is met, else an empty one."""
    return F.filter(F.array(value), lambda _: F.coalesce(condition, F.lit(False)))


