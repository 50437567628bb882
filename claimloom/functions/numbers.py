"""Numeric and time column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000
# What a decimal half may lack: a fixed part for the last digits of sums, and some float steps.
TIE_GUARD, TIE_STEPS = 1e-9, 2e-15


def half_up(value: Column, digits: int) -> Column:
    """Round half away from zero.

    The guard lifts values that are a decimal half but sit a few float steps below it,
    so that the result is the same whichever engine evaluates it, and no others.
    """
    scale = float(10**digits)
    value = value.cast("double")
    scaled = F.abs(value) * scale
    return F.signum(value) * F.floor(scaled + 0.5 + TIE_GUARD + scaled * TIE_STEPS) / scale + 0.0


def money(value: Column) -> Column:
    """Exact decimal for sums and comparisons of amounts."""
    return value.cast("decimal(18,4)")


def money_sum(value: Column, digits: int = 2) -> Column:
    return half_up(F.coalesce(F.sum(money(value)), F.lit(0)), digits)


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between two instants, floored (also for negative spans)."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / DAY_MICROS)


def flag(condition: Column) -> Column:
    """1 when true, 0 when false or null."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def band(value: Column, steps: Sequence[tuple[float, str]], default: str, strict: bool = False) -> Column:
    """Threshold ladder; `steps` go from the highest bound to the lowest."""
    chain = None
    for bound, label in steps:
        hit = value > bound if strict else value >= bound
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise(default)


def constant_map(table: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
