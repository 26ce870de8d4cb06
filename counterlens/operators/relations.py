"""How a source direction relates to a target it is applied to, and probe pairs without private fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterlens.operators.design import INTERSECTION, Design


def source_table(spark, designs: dict[str, Design]) -> DataFrame:
    """Every (domain, encoding, axis) that a design marks, with the factors its pairs flip as an array of (factor, pole
    A, pole B), and the factors whose proxy measures something else. One row per source: a few dozen."""
    rows = []
    for domain, d in designs.items():
        for encoding in d.clauses:
            for axis in d.marked_axes(encoding):
                flipped = [(f, *poles) for f, poles in d.levels.items() if axis in (INTERSECTION, f)]
                rows.append((domain, encoding, axis, flipped, sorted(d.proxy_labels)))
    return spark.createDataFrame(rows, "domain string, encoding string, axis string, flips array<struct<factor:string,a:string,b:string>>, "
                                       "proxies array<string>")


def relation(s: str = "s", t: str = "t") -> Column:
    """``own``, what differs (``domain``, ``encoding``), ``component`` where only some flipped factors agree,
    ``off_axis`` or ``unrelated`` where none does; over struct columns ``s`` and ``t`` of `source_table`."""
    a, b = F.col(f"{s}.flips"), F.col(f"{t}.flips")
    shared = F.array_intersect(a, b)
    same = (F.size(shared) == F.size(a)) & (F.size(shared) == F.size(b))
    near = F.col(f"{s}.domain") == F.col(f"{t}.domain")
    parts = F.concat_ws("+", F.when(~same, F.lit("component")), F.when(~near, F.lit("domain")),
                        F.when(F.col(f"{s}.encoding") != F.col(f"{t}.encoding"), F.lit("encoding")))
    none = F.when(near, "off_axis").otherwise("unrelated")
    return F.when(F.size(shared) == 0, none).otherwise(F.when(parts == "", "own").otherwise(parts))


def proxy_differs(s: str = "s", t: str = "t") -> Column:
    """Whether, across encodings, a shared factor's proxy measures another construct; null within one encoding."""
    shared = F.transform(F.array_intersect(F.col(f"{s}.flips"), F.col(f"{t}.flips")), lambda x: x["factor"])
    proxies = F.when(F.col(f"{s}.encoding") == "proxy", F.col(f"{s}.proxies")).otherwise(F.col(f"{t}.proxies"))
    return F.when((F.col(f"{s}.encoding") != F.col(f"{t}.encoding")) & (F.size(shared) > 0), F.arrays_overlap(shared, proxies))


def transfer_grid(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Every target row against every source (one row per source, broadcast), labelled. ``targets`` carries struct ``t``."""
    return targets.crossJoin(F.broadcast(sources.select(F.struct("*").alias("s")))).withColumn("relation", relation())


def probe_pairs(pairs: DataFrame) -> DataFrame:
    """Pair rows as contrastive pairs: the A side is positive."""
    return pairs.select("id", "axis", "encoding", "record_id", "label_a", "label_b", F.col("text_a").alias("positive"),
                        F.col("text_b").alias("negative"))


def evaluation_examples(pairs: DataFrame, strong: str, prompt: str | None = None) -> DataFrame:
    """Pair rows for evaluation: ids, labels, texts, the quality flag and the prompt; no other real field leaves. A row
    without a quality flag is an error."""
    flag = F.when(F.col(strong).isNull(), F.raise_error(F.concat(F.lit("no quality flag in "), F.col("id"))).cast("boolean")).otherwise(F.col(strong))
    return pairs.select("id", "axis", "encoding", "record_id", "template", "label_a", "label_b", flag.alias("strong"),
                        *([F.col(prompt).alias("prompt")] if prompt else []), F.col("text_a").alias("a"), F.col("text_b").alias("b"))


def reasoning_labels(cell: str, favourable_true: Column) -> dict[str, Column]:
    """Correctness, conclusion and valence of a reasoning cell (``true_advance`` and so on)."""
    true, advance = F.col(cell).startswith("true_"), F.col(cell).endswith("_advance")
    return {"correctness": true.cast("int"), "conclusion": advance.cast("int"), "valence": (true == favourable_true).cast("int")}


def concept_pairs(concept: str, favourable_true: bool) -> list[tuple[str, str]]:
    """The two matched (positive, negative) cells of a concept, the other factor held."""
    if concept == "conclusion":
        return [(f"{c}_advance", f"{c}_reject") for c in ("true", "false")]
    if concept not in ("correctness", "valence"):
        raise ValueError(f"unknown concept {concept!r}")
    up, down = ("true", "false") if concept == "correctness" or favourable_true else ("false", "true")
    return [(f"{up}_{d}", f"{down}_{d}") for d in ("reject", "advance")]


def reward_gaps(scored: DataFrame, key: str, by: list[str], label: str, reward: str) -> DataFrame:
    """Per record and ``by``: mean reward of its label-1 rows minus its label-0 rows. A record with one label is an error."""
    y = F.col(label) == 1
    g = scored.groupBy(*by, key).agg(F.avg(F.when(y, F.col(reward))).alias("one"), F.avg(F.when(~y, F.col(reward))).alias("zero"))
    gap = F.when(F.col("one").isNull() | F.col("zero").isNull(),
                 F.raise_error(F.concat(F.lit("one label only in "), F.col(key).cast("string"))).cast("double")).otherwise(F.col("one") - F.col("zero"))
    return g.select(*by, key, gap.alias("gap"))


def nested(smaller: DataFrame, larger: DataFrame, key: str) -> DataFrame:
    """Keys of ``smaller`` that ``larger`` lacks: empty if the prefixes are nested."""
    return smaller.select(key).join(larger.select(key), key, "left_anti")
