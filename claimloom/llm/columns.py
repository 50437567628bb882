"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, evaluated once a row however often `body` or a lambda inside it uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column, start: Column) -> Column:
    return F.aggregate(values, start, lambda a, x: a + x)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front where `df` has columns of that name."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        out.append(name)
    return out
