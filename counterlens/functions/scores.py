"""Row-level score comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def win(x: Column, y: Column) -> Column:
    """1 above, one half on an exact tie, 0 below; null when either side is null."""
    return F.when(x > y, 1.0).when(x == y, 0.5).when(x < y, 0.0)


def decision_correct(margin: Column, strong: Column) -> Column:
    """Approve the strong record, decline the weak one; a tie is half right."""
    return (F.when(margin.isNull(), F.lit(None).cast("double"))
            .when(margin == 0, 0.5)
            .when(strong, (margin > 0).cast("double"))
            .otherwise((margin < 0).cast("double")))


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` with null for a zero denominator."""
    return num / F.when(den != 0, den)


def tie_precision(score: Column, digits: int = 3) -> Column:
    """Round to ``digits`` significant digits, the resolution at which half-precision scores tie."""
    magnitude = F.floor(F.log10(F.abs(score)))
    step = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - magnitude)
    return F.when(score == 0, 0.0).otherwise(F.round(score * step) / step)
