"""Numbers as text, rounded as the value itself lies and not as its shortest decimal form does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = float((1 << 27) + 1)


def _halves(x: Column) -> tuple[Column, Column]:
    """A double as two of 26 bits each, so products of halves are exact."""
    c = x * _SPLIT
    high = c - (c - x)
    return high, x - high


def rounded(value: Column, digits: int) -> Column:
    """``value`` rounded to ``digits`` decimals: to the nearer one of the exact value, half to even."""
    scale = float(10 ** digits)
    x = F.abs(value.cast("double"))
    product = x * scale
    high, low = _halves(x)
    s_high = scale * _SPLIT - (scale * _SPLIT - scale)
    s_low = scale - s_high
    error = ((high * s_high - product) + high * s_low + low * s_high) + low * s_low     # what the product lost
    whole = F.floor(product).cast("double")
    rest = product - whole
    odd = F.pmod(whole, F.lit(2.0)) == 1
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & odd)))
    near = (whole + up.cast("double")) / scale
    return F.when(value < 0, -near).otherwise(near)


def fixed(value: Column, digits: int, sign: bool = False) -> Column:
    """``value`` with exactly ``digits`` decimals, with its sign where ``sign`` asks for it."""
    return F.format_string(f"%{'+' if sign else ''}.{digits}f", rounded(value, digits))
