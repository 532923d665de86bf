"""Rounding that agrees with half-even rounding of the exact binary value.

``bround`` rounds the shortest decimal print of a double, which differs on values such
as 2.65 (stored just below). Whether a double lies above, below or on the half-way
point is found without error here: the value is split into a 24-bit and a 29-bit half,
both of whose products with 2 * 10**digits are exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_exact(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    low = F.floor(x * scale).cast("double")
    high_part = x.cast("float").cast("double")
    side = (high_part * (2 * scale) - (low * 2 + 1)) + (x - high_part) * (2 * scale)
    return (
        F.when(x.isNull(), F.lit(None).cast("double"))
        .when(side > 0, (low + 1) / scale)
        .when(side < 0, low / scale)
        .when(low % 2 == 0, low / scale)
        .otherwise((low + 1) / scale)
    )


def round_exact_sql(x: str, digits: int) -> str:
    """The same rounding as a SQL expression, for the comparison queries."""
    s = f"{float(10 ** digits)}::DOUBLE"
    s2 = f"{float(2 * 10 ** digits)}::DOUBLE"
    low = f"floor(({x}) * {s})"
    hi = f"(({x})::FLOAT::DOUBLE)"
    side = f"(({hi} * {s2} - ({low} * 2 + 1)) + (({x}) - {hi}) * {s2})"
    return (
        f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN {side} > 0 THEN ({low} + 1) / {s} "
        f"WHEN {side} < 0 THEN {low} / {s} "
        f"WHEN {low} % 2 = 0 THEN {low} / {s} ELSE ({low} + 1) / {s} END)"
    )


def fixed(x: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded as above."""
    return F.format_string(f"%.{digits}f", round_exact(x, digits))
