"""Local names inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(*parts) -> Column:
    """let(value, ..., body): body(value, ...) with every value computed once per row.

    Used as it stands, an expression inside another expression's lambda is computed again for every element.
    """
    *values, body = parts
    bound = body

    def bind(index: int, names: list[Column]) -> Column:
        if index == len(values):
            return bound(*names)
        value = values[index]
        value = value(*names) if isinstance(value, Callable) else value
        return F.get(F.transform(F.array(value), lambda v: bind(index + 1, [*names, v])), 0)

    return bind(0, [])
