"""Contract checks: each returns the offending rows or a count; `require_empty` turns offenders into a refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks the contract of the step that reads it."""


def require_empty(df: DataFrame, what: str) -> None:
    """Fail with up to three offending rows (one short job, a bounded number of rows on the driver)."""
    bad = df.limit(3).collect()
    if bad:
        raise ContractError(f"{what}: e.g. {[r.asDict() for r in bad]}")


def cube_holes(rewards: DataFrame, n_cells: int, n_responses: int, by: list[str] = ("record_id", "template", "encoding")
               ) -> DataFrame:
    """Blocks that are neither complete nor free of duplicates."""
    per = rewards.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("cell", "response").alias("entries"))
    full = n_cells * n_responses
    return per.filter((F.col("rows") != full) | (F.col("entries") != full))


def conflicting_labels(df: DataFrame, key: str, label: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).filter("lo <> hi")


def unknown_levels(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(known)).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def two_record_holes(rewards: DataFrame) -> DataFrame:
    """Blocks without 8 (marked) or 4 (unmarked) distinct rewards."""
    per = rewards.groupBy("pair_id", "template", "encoding", "axis", "kind").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(F.coalesce("protected", F.lit("-")), "order", "chosen").alias("entries"))
    need = F.when(F.col("axis") == "unmarked", 4).otherwise(8)
    return per.filter((F.col("rows") != need) | (F.col("entries") != need))


def block_problems(blocks: DataFrame) -> DataFrame:
    """Adds ``problems``: cells missing or repeated, a clause not exactly once, several unmarked texts or positions, a
    proxy block without names. Evaluated inside the block's row."""
    cells = F.col("cells")
    count = lambda f: F.size(F.array_distinct(F.transform(cells, f)))
    once = F.forall(cells, lambda c: (F.length(c["text"]) - F.length(F.replace(c["text"], c["clause"], F.lit("")))) == F.length(c["clause"]))
    checks = [("cells", (F.size(cells) != 8) | (count(lambda c: c["cell"]) != 8)), ("clause_not_once", ~once),
              ("unmarked_texts", count(lambda c: F.md5(F.replace(c["text"], c["clause"], F.lit("")))) != 1),
              ("positions", count(lambda c: F.position(c["clause"], c["text"])) != 1),
              ("no_names", (F.col("encoding") == "proxy") & (F.size(F.map_keys("names")) == 0))]
    return blocks.withColumn("problems", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks]), lambda x: x.isNotNull()))


def non_finite(df: DataFrame, column: str) -> DataFrame:
    v = F.col(column).cast("double")
    return df.filter(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def unpaired_swaps(rows: DataFrame) -> DataFrame:
    """Two-record rows without their counterpart under the other assignment, counted per block side by side."""
    key = ["pair_id", "template", "order", "kind", "chosen"]
    per = rows.groupBy(*key).agg(F.count_if(F.col("protected") == "X").alias("x"), F.count_if(F.col("protected") == "Y").alias("y"))
    return per.filter("x <> 1 or y <> 1")


def mixed_labels(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.groupBy(*by).agg(F.count_distinct("label_a", "label_b").alias("labels")).filter("labels > 1")


def label_values(df: DataFrame, label: str) -> list[int]:
    """The values of a 0/1 label; anything else, or a single class, is refused."""
    seen = df.agg(F.min(label).alias("lo"), F.max(label).alias("hi"),
                  F.count_if(F.col(label).isNull() | ~F.col(label).isin(0, 1)).alias("bad")).first()
    if seen["bad"] or seen["lo"] == seen["hi"]:
        raise ContractError(f"{label} must be 0/1 with both classes: {seen.asDict()}")
    return [0, 1]


def missing_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows lacking each required field, as rows (field, missing) where any are."""
    counts = df.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in fields])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("missing")) for f in fields])).alias("e")
                         ).select("e.*").filter("missing > 0")


def score_disagreement(df: DataFrame, ours: Column, theirs: Column, absolute: float = 0.02, relative: float = 0.02) -> DataFrame:
    """Rows whose recomputed score differs from the supplied one by more than ``absolute + relative |score|``."""
    return df.filter(F.abs(ours - theirs) > absolute + relative * F.abs(theirs))
