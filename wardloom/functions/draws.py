"""Counter-based random draws in whole-number arithmetic, the same in Spark, SQL and Python.

A draw depends only on its numbers, so results don't depend on partitioning and SQL can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modulus and multipliers of the mixing steps.
M, A, B = 2147483647, 48271, 69621
P1, P2, P3 = 7919, 104729, 1299709


def draw_of(seed: int, *numbers: int) -> int:
    """A number from 0 to M - 1 for up to two counters."""
    i, j = (*numbers, 0, 0)[:2]
    h = (seed * P1 + i * P2 + j * P3 + 12345) % M
    g = (h * A + 11) % M
    return ((g * B + h) % M * A + 7) % M


def draw(seed: int, *numbers: Column) -> Column:
    i, j = (*numbers, F.lit(0), F.lit(0))[:2]
    h = (F.lit(seed * P1 + 12345).cast("bigint") + i.cast("bigint") * P2 + j.cast("bigint") * P3) % M
    g = (h * A + 11) % M
    return ((g * B + h) % M * A + 7) % M


def sql_draw(seed: int, i: str = "0", j: str = "0") -> str:
    h = f"(({seed * P1 + 12345}::bigint + ({i})::bigint * {P2} + ({j})::bigint * {P3}) % {M})"
    g = f"(({h} * {A} + 11) % {M})"
    return f"((({g} * {B} + {h}) % {M} * {A} + 7) % {M})"
