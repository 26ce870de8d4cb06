"""Deterministic draws keyed by strings: the same key gives the same draw on any cluster layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def joined(*parts) -> Column:
    """``a|b|c`` of literals and columns."""
    return F.concat_ws("|", *[_text(p) for p in parts])


def digest(*parts) -> Column:
    """SHA-256 of the joined parts as hex; hex order is byte order."""
    return F.sha2(joined(*parts), 256)


def hash15(*parts) -> Column:
    """The first 15 hex digits of the digest as a non-negative long."""
    return F.conv(F.substring(digest(*parts), 1, 15), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """A draw from [0, 1) on a grid of one millionth."""
    return F.pmod(hash15(*parts), F.lit(1000000)) / F.lit(1000000.0)


def choice_index(n: int | Column, *parts) -> Column:
    """An index in ``0..n-1``."""
    return F.pmod(hash15(*parts), n if isinstance(n, Column) else F.lit(n)).cast("int")


def choose(options: list[str], *parts) -> Column:
    """One of a short literal list."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), choice_index(len(options), *parts) + 1)


def coin(*parts) -> Column:
    """Heads when the first digest byte is below 128."""
    return F.substring(digest(*parts), 1, 1) < F.lit("8")


def text_key(text: Column, max_length: int) -> Column:
    """Content address of a scored text under a length limit."""
    return F.sha2(F.concat(F.lit(f"[{max_length},"), F.to_json(F.array(text)), F.lit("]")), 256)


def short_hash(*parts) -> Column:
    """Twelve digits, as templates and models are fingerprinted."""
    return F.substring(digest(*parts), 1, 12)
