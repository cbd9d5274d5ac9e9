"""Small building blocks of column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, whatever ``body`` does with it."""
    return F.transform(F.array(value), body)[0]


def is_blank(text: Column) -> Column:
    """Empty or white space only, of any script."""
    return F.regexp_like(text, F.lit(r"(?U)^\s*$"))


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
