"""Sentences inserted into a text at a position, and the decomposition of their effect against the text without them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from counterlens.functions.keyed import choice_index
from counterlens.functions.scores import win
from counterlens.functions.text import insert_at, sentence_boundaries

POSITIONS = ("opening", "middle", "random", "conclusion")


def insertion_cut(text: str, position: str, seed: int = 0, key: str = "record_id") -> Column:
    """Character offset at which a sentence goes in: the start, the end, the sentence boundary nearest to the middle (the
    earlier of two equally near), or one drawn by the row's key. Null where a text has no boundary to choose."""
    if position == "opening":
        return F.lit(0)
    if position == "conclusion":
        return F.length(text)
    bounds = sentence_boundaries(text)
    if position == "middle":
        middle = F.floor(F.length(text) / 2)
        return F.array_min(F.transform(bounds, lambda b: F.struct(F.abs(b - middle).alias("d"), b.alias("at"))))["at"]
    if position == "random":
        n = F.size(bounds)
        return F.when(n > 0, F.element_at(bounds, F.pmod(choice_index(1 << 30, F.lit(seed), F.col(key), F.lit("cut")), F.greatest(n, F.lit(1))) + 1))
    raise ValueError(f"position must be one of {POSITIONS}, got {position!r}")


def positioned(text: str, sentence, position: str, seed: int = 0, key: str = "record_id") -> Column:
    """The text with the sentence at the position: a paragraph of its own at either end. A text that ends in white space
    takes no conclusion; a text without a boundary gives null in the middle."""
    cut = insertion_cut(text, position, seed, key)
    out = insert_at(F.col(text), sentence, cut)
    if position != "conclusion":
        return out
    bad = F.col(text) != F.rtrim(text)
    return F.when(bad, F.raise_error(F.lit("a conclusion needs a text without trailing white space")).cast("string")).otherwise(out)


def positioned_sums() -> dict[str, Column]:
    """Additive parts of the decomposition over (neutral, a, b) rows."""
    n, a, b = F.col("neutral"), F.col("a"), F.col("b")
    return {"n": F.lit(1.0), "sn": n, "sa": a, "sb": b, "wins": win(a, b), "a_up": win(a, n), "b_up": win(b, n)}


#: Name to expression over the totals of `positioned_sums`; each is its interval's point estimate.
POSITIONED_STATS = {
    "delta_a": lambda s: (s["sa"] - s["sn"]) / s["n"],
    "delta_b": lambda s: (s["sb"] - s["sn"]) / s["n"],
    "main_effect": lambda s: ((s["sa"] + s["sb"]) / 2 - s["sn"]) / s["n"],
    "identity_gap": lambda s: (s["sa"] - s["sb"]) / s["n"],
    "pref_a_rate": lambda s: s["wins"] / s["n"],
    "auto_influence": lambda s: F.abs(s["wins"] / s["n"] - 0.5) * 2,
    "frac_a_above_neutral": lambda s: s["a_up"] / s["n"],
    "frac_b_above_neutral": lambda s: s["b_up"] / s["n"],
}
