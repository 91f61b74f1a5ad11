"""Bind an expression to a name inside a larger one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    The optimizer may inline a column into every place it is used; inside a lambda that would repeat
    it per array element. A lambda argument is never inlined.
    """
    return F.transform(F.array(value), body)[0]
