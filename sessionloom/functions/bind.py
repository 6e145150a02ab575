"""Evaluate an expression once and use it several times inside one larger expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` bound to a lambda variable instead of copied into every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
