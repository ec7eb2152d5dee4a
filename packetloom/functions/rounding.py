"""Ratios rounded the way IEEE-754 half-even libraries round them.

``round(k / n, d)`` of a float rounds the exact binary value of the quotient
and sends exact halves to the even digit.  Spark's ``round`` and ``bround``
look at the shortest decimal text of the double instead, which differs when
``k / n`` lies on a decimal tie.  ``round_ratio`` works on the integers ``k``
and ``n``: away from ties integer arithmetic decides, on a tie the binary
value of the tie does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions.literals import literal_array


def round_ratio(k: Column, n: Column, digits: int) -> Column:
    """``round(k / n, digits)`` for non-negative integer ``k``, positive ``n``; 0.0 when ``n`` is 0."""
    scale = 10**digits
    k, n = k.cast("bigint"), F.nullif(n.cast("bigint"), F.lit(0).cast("bigint"))
    quotient = (k * F.lit(scale) / n).cast("double")
    # Integer division and remainder keep the tie test exact.
    whole = F.call_function("div", k * F.lit(scale), n)
    twice_rest = (k * F.lit(scale) - whole * n) * 2
    tie_is_above = _binary_tie_sign(k.cast("double") / n, whole, scale)
    even = F.when(whole % 2 == 0, whole).otherwise(whole + 1)
    rounded = (
        F.when(twice_rest > n, whole + 1)
        .when(twice_rest < n, whole)
        .when(tie_is_above > 0, whole + 1)
        .when(tie_is_above < 0, whole)
        .otherwise(even)
    )
    return F.when(quotient.isNull(), F.lit(0.0)).otherwise(rounded.cast("double") / F.lit(float(scale)))


def _binary_tie_sign(value: Column, whole: Column, scale: int) -> Column:
    """Sign of (binary value of the double) - (exact decimal tie ``(2 whole + 1) / (2 scale)``)."""
    exponent = F.floor(F.log2(value)).cast("int")
    shift = F.lit(53) - exponent  # one spare bit: log2 may round up to the next integer
    high = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(shift - 30, F.lit(0)))
    low = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(shift, F.lit(30)))
    mantissa = (value * high.cast("double") * low.cast("double")).cast("bigint")
    wide = "decimal(38,0)"
    left = mantissa.cast("decimal(19,0)").cast(wide) * F.lit(2 * scale).cast("decimal(10,0)")
    right = (whole * 2 + 1).cast("decimal(19,0)") * high.cast("decimal(19,0)")
    right = right.cast(wide) * low.cast("decimal(10,0)")
    return F.sign((left.cast(wide) - right.cast(wide)).cast("double"))


def round_share(k: Column, n: Column, digits: int = 2) -> Column:
    """``round_ratio`` for shares (``k <= n``) and up to two digits.

    There are only ``10**digits`` ties below 1, so their results come from a
    small literal array; the expression stays small enough to compile where a
    projection holds many of them.
    """
    scale = 10**digits
    ties = literal_array([round((2 * q + 1) / (2 * scale), digits) for q in range(scale)])
    k, n = k.cast("bigint") * scale, F.nullif(n.cast("bigint"), F.lit(0).cast("bigint"))
    whole = F.call_function("div", k, n)
    twice_rest = (k - whole * n) * 2
    up = (twice_rest > n).cast("int")
    rounded = F.when(twice_rest == n, F.get(ties, whole.cast("int"))).otherwise((whole + up).cast("double") / float(scale))
    return F.coalesce(rounded, F.lit(0.0))


def ratio(k: Column, n: Column) -> Column:
    """Unrounded ``k / n`` with 0.0 for an empty denominator."""
    return F.coalesce(F.try_divide(k.cast("double"), n.cast("double")), F.lit(0.0))
