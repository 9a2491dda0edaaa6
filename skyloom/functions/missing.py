"""Missing-value rules shared by all operators.

NULL is a masked value: it propagates through arithmetic, comparisons and boolean
operators and a filter drops it, negated or not. NaN follows IEEE: every comparison
with it is false but ``!=``. Division never raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inf() -> Column:
    return F.lit(float("inf"))


def nan() -> Column:
    return F.lit(float("nan"))


def is_finite(x: Column) -> Column:
    """False for NULL, NaN and infinities."""
    x = x.cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < inf()), F.lit(False))


def finite_or_null(x: Column) -> Column:
    return F.when(is_finite(x), x.cast("double"))


def strict(result: Column, *inputs: Column) -> Column:
    """NULL wherever an input is NULL, even if the result would not be."""
    masked = inputs[0].isNull()
    for x in inputs[1:]:
        masked = masked | x.isNull()
    return F.when(masked, None).otherwise(result)


def divide(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is a signed infinity, 0/0 and NaN give NaN."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(a) | (a == 0), nan()).when(a > 0, inf()).otherwise(-inf())
    return strict(F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b)), a, b)


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; NaN for a zero divisor."""
    return strict(F.when(b == 0, nan()).otherwise(a - b * F.floor(divide(a, b))), a, b)


def ieee_compare(op: str, a: Column, b: Column) -> Column:
    """A comparison of numbers in which NaN equals nothing, itself included."""
    either = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
    plain = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return strict(F.when(either, F.lit(op == "!=")).otherwise(plain), a, b)


def guarded(x: Column, undefined: Column, at_zero: Column | None, value: Column) -> Column:
    """value with NaN where undefined, and at_zero where x is zero."""
    out = F.when(x.isNull(), None).when(F.isnan(x) | undefined, nan())
    if at_zero is not None:
        out = out.when(x == 0, at_zero)
    return out.otherwise(value)
