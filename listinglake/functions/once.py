"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it.

    Repeating a large expression repeats it in the plan as well, which the optimizer walks in full;
    and mentioned inside a lambda, it would be computed again for every element.
    """
    return F.transform(F.array(value), use)[0]
