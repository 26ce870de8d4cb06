"""Column expressions on ``array<double>`` vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8


def col(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def total(v) -> Column:
    return F.aggregate(col(v), F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def scale(v, k) -> Column:
    return F.transform(col(v), lambda x: x * k)


def plus(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x.cast("double") + y.cast("double"))


def minus(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x.cast("double") - y.cast("double"))


def unit(v) -> Column:
    """Unit length; a vector shorter than ``TINY`` becomes null (its direction is undefined)."""
    n = norm(v)
    return F.when(n >= TINY, F.transform(col(v), lambda x: x / n))


def cosine(a, b) -> Column:
    na, nb = norm(a), norm(b)
    return F.when((na >= TINY) & (nb >= TINY), dot(a, b) / (na * nb))


def project_out(h, direction, alpha=1.0) -> Column:
    """``h - alpha (h.u) u`` for a unit direction ``u``; a null direction leaves ``h`` as it is."""
    h, u = col(h), col(direction)
    along = dot(h, u) * F.lit(float(alpha))
    return F.when(u.isNull(), F.transform(h, lambda x: x.cast("double"))).otherwise(
        F.zip_with(h, u, lambda x, y: x.cast("double") - along * y))


def full_sample_reliability(rho: Column) -> Column:
    """Spearman-Brown step from half samples to the whole."""
    return F.when(rho > 0, 2 * rho / (1 + rho))


def cosine_ceiling(rel_a: Column, rel_b: Column) -> Column:
    return F.when((rel_a > 0) & (rel_b > 0), F.sqrt(rel_a * rel_b))


def disparity_share(w, delta, u) -> Column:
    """Share of ``w.delta`` carried along the unit direction ``u``; null when there is no disparity."""
    whole = dot(w, delta)
    return F.when(F.abs(whole) >= 1e-12, dot(w, u) * dot(delta, u) / whole)
