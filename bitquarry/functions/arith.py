"""Integer arithmetic of the engine as Column expressions: truncating division, clipping, shifts, integer logarithms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str | int) -> Column:
    """A column by name, a number as a long literal, a column as it is."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x).cast("long")


def div(a: Column | str | int, b: Column | str | int) -> Column:
    """Division of integers towards zero."""
    return F.call_function("div", col(a), col(b))


def ceil_div(a: Column | str | int, b: Column | str | int) -> Column:
    return div(col(a) + col(b) - 1, b)


def clip(value: Column, low: Column | int, high: Column | int) -> Column:
    return F.greatest(col(low), F.least(value, col(high)))


def clip_sample(value: Column, depth: Column | str | int) -> Column:
    """To 0 .. 2**depth - 1."""
    return clip(value, 0, power2(col(depth)) - 1)


def power2(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def shift_right(value: Column, n: Column | int) -> Column:
    """Arithmetic shift: rounds towards minus infinity."""
    return F.call_function("shiftright", value.cast("long"), col(n).cast("int"))


def sign(value: Column) -> Column:
    return F.when(value > 0, 1).when(value < 0, -1).otherwise(0).cast("long")


def is_power_of_two(value: Column) -> Column:
    return (value > 0) & (value.bitwiseAND(value - 1) == 0)


def pick(values: list[int], index: Column) -> Column:
    """values[index] from a fixed list, null outside."""
    return F.get(F.array(*(F.lit(v).cast("long") for v in values)), index.cast("int"))


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)
