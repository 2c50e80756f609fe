"""Rounding to decimal places, half to even on the exact binary value, as columns and as SQL text.

round() of the engines works on the shortest decimal text or multiplies first, and so differs at ties. Here the product with
the power of ten is taken exactly, as a double and its error (by splitting the factor in halves), before it is compared with
a half.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def exact_round(x: Column, places: int) -> Column:
    p = 10.0**places

    def body(v: Column) -> Column:
        c = v * _SPLIT
        high = c - (c - v)
        y = v * p
        error = (high * p - y) + (v - high) * p
        down = F.floor(y).cast("double")
        rest = (y - down - 0.5) + error
        up = F.when(rest > 0, 1.0).when(rest < 0, 0.0).otherwise(F.pmod(down, F.lit(2.0)))
        return (down + up) / p

    return let(x.cast("double"), body)


def exact_round_sql(x: str, places: int) -> str:
    """The same as DuckDB SQL; x is a column of doubles (it is written several times)."""
    p, split = f"{10**places}::DOUBLE", "134217729::DOUBLE"
    high = f"({x} * {split} - ({x} * {split} - {x}))"
    rest = f"(({x} * {p} - floor({x} * {p}) - 0.5::DOUBLE) + (({high} * {p} - {x} * {p}) + ({x} - {high}) * {p}))"
    return f"((floor({x} * {p}) + CASE WHEN {rest} > 0 THEN 1 WHEN {rest} < 0 THEN 0 ELSE (floor({x} * {p})::BIGINT % 2 + 2) % 2 END) / {p})"
