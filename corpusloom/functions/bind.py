"""Compute a value once and use it several times inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row.

    A column expression that is named twice is computed twice inside lambdas
    and conditions; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
