"""Rounding of doubles that goes by their exact binary value, ties to even: 2.675 has two digits 2.67, as the double is below it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = float((1 << 27) + 1)
_EXACT = float(1 << 53)


def _halves(x: Column) -> tuple[Column, Column]:
    """x as a sum of two doubles of 26 bits each."""
    wide = x * _SPLIT
    high = wide - (wide - x)
    return high, x - high


def round_exact(x: Column, digits: int) -> Column:
    """The double nearest to the decimal of so many digits (0 to 22) that is nearest to x.

    x times a power of ten is a product and its error, both exact; so the fraction's side of one half is known exactly, and what is divided
    at the end is a whole number below 2**53 by a power of ten that a double holds. Larger products need no rounding. Null stays null; NaN
    and infinities stay what they are.
    """
    if not 0 <= digits <= 22:
        raise ValueError("digits are 0 to 22")
    power = float(10**digits)
    x = x.cast("double")
    size = F.abs(x)
    product = size * F.lit(power)
    (a, b), c = _halves(size), F.lit(power)
    c, d = _halves(c)
    error = ((a * c - product) + a * d + b * c) + b * d
    whole = F.floor(F.least(product, F.lit(_EXACT))).cast("double")
    above = (product - whole - 0.5) + error
    up = (above > 0) | ((above == 0) & (F.pmod(whole, F.lit(2.0)) == 1))
    # a product that is whole, half a unit too large: the tie lies below it
    down = (product == whole) & (error == -0.5) & (F.pmod(whole, F.lit(2.0)) == 1)
    found = (whole + F.when(up, 1.0).when(down, -1.0).otherwise(0.0)) / F.lit(power)
    kept = F.isnan(x) | (product >= _EXACT)
    return F.when(x.isNull() | kept, x).otherwise(F.when(F.signum(x) < 0, -found).otherwise(found))
