"""Array expression helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name an intermediate value, so that it is evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
