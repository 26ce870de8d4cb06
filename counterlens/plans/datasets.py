"""Dataset builds: records to gated blocks, as one lazy plan per domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterlens.functions.keyed import digest
from counterlens.functions.text import with_article
from counterlens.operators import blocks as B, rules as R, splits as S
from counterlens.operators.design import CREDIT, EDUCATION, HIRING, Design
from counterlens.session import cut_lineage
from counterlens.sources import codebook as C
from counterlens.sources.corpora import NEAR_SYNONYMS


def gated_blocks(block: DataFrame, design: Design) -> DataFrame:
    """The blocks of both encodings all of whose pairs pass the gate."""
    parts = [B.kept_blocks(B.with_pairs(block, design, e)).drop("pairs") for e in ("explicit", "proxy")]
    return parts[0].unionByName(parts[1])


def credit_blocks(lines: DataFrame, seed: int) -> DataFrame:
    """Coded lines to records, consistency and factorial rules, cells, gate."""
    r = R.apply_rules(C.decode(lines), R.credit_record_rules() + R.credit_factorial_rules())
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = r.repartition(parts, "source_record_id")
    render = lambda t, m: C.render(C.CREDIT_TEMPLATES[t], C.credit_slots(), m)
    b = B.blocks(r, CREDIT, list(C.CREDIT_TEMPLATES), render, seed, "source_record_id", ["credit_good", "raw_sex"])
    return gated_blocks(b, CREDIT)


def essay_blocks(essays: DataFrame, seed: int, key: str = "record_id") -> DataFrame:
    """Essays (key, essay_text, prompt_id, assignment, high_quality) through the pupil, money and ending rules to gated blocks."""
    r = R.apply_rules(essays, R.essay_rules(prompts=None))
    parts = int(essays.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = {"assignment": C.assignment_block(F.col("assignment")), "body": F.col("essay_text")}
    render = lambda t, m: C.render(C.ESSAY_TEMPLATES[t], slots, m)
    b = B.blocks(r.repartition(parts, key), EDUCATION, list(C.ESSAY_TEMPLATES), render, seed, key, ["high_quality", "prompt_id"])
    return gated_blocks(b, EDUCATION)


def hiring_records(bios: DataFrame, seed: int, key: str = "source_record_id", cap: float | None = 0.10, n: int | None = None,
                   forbidden: list[tuple[str, str]] = NEAR_SYNONYMS) -> DataFrame:
    """Biographies (key, profession, bio_text, already scrubbed) that fit every level, with a clean role label: the rules for both
    ages, no profession above ``cap`` of the pool, the first ``n`` in hashed order, half of every profession qualified for its own
    role, the others with a derangement of their professions that avoids near-synonyms. Adds qualified, target_role, role."""
    kept = R.apply_rules(bios, R.hiring_rules())
    if cap:
        kept = S.cap_groups(kept, "profession", digest(seed, "cap", F.col(key)), key, cap)
    if n:
        kept = S.seeded_order(kept, key, seed, n).select(*bios.columns)
    headed = cut_lineage(S.half_labels(kept, key, "profession", seed, "qualified"))
    heads = headed.filter("qualified").withColumn("target_role", F.col("profession"))
    tails = S.derangement(headed.filter(~F.col("qualified")).select(key, "profession"), key, "profession", seed, forbidden)
    tails = headed.filter(~F.col("qualified")).join(tails.select(key, F.col("target").alias("target_role")), key)
    return heads.unionByName(tails.select(*heads.columns)).withColumn("role", with_article("target_role"))


def hiring_blocks(bios: DataFrame, seed: int, key: str = "source_record_id", cap: float | None = 0.10, n: int | None = None,
                  forbidden: list[tuple[str, str]] = NEAR_SYNONYMS) -> DataFrame:
    """`hiring_records` to gated blocks under both profile templates."""
    r = hiring_records(bios, seed, key, cap, n, forbidden)
    parts = int(bios.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = {"role": F.col("role"), "body": F.col("bio_text")}
    render = lambda t, m: C.render(C.BIO_TEMPLATES[t], slots, C.checked_marker(m))
    b = B.blocks(r.repartition(parts, key), HIRING, list(C.BIO_TEMPLATES), render, seed, key, ["profession", "target_role", "role", "qualified"])
    return gated_blocks(b, HIRING)
