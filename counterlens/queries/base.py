"""The audit tables derived from the given parquet tables, once as DataFrames and once as SQL text.

``records``: labelled documents; ``rewards``: one score per (record, template, encoding, cell, response);
``states``: one embedding per scored text; plus the two-record and best-of-n forms. Scores are whole
thousandths, so both engines hold the same doubles and exact ties occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterlens.functions.keyed import hash15
from counterlens.operators.design import CREDIT, Design

RESPONSES = ("approve", "decline", "coded", "overt", "evasive")
TEMPLATES = ("v1", "v2")
ENCODINGS = ("explicit", "proxy")
SEED = 42


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r9(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table fixed by the design (cells, responses, templates)."""
    return spark.createDataFrame(rows, schema)


def records(spark: SparkSession, sf: str, text: bool = True) -> DataFrame:
    d = table(spark, sf, "documents")
    r = d.join(table(spark, sf, "labels"), "doc_id").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("record_id"), "doc_id",
        (F.col("quality") == 1).alias("strong"), F.col("source").alias("grp"), F.col("lang").alias("prompt"),
        F.regexp_count("text", F.lit(r"\S+")).cast("bigint").alias("n_words"), "text")
    return r if text else r.drop("text")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Distribute compact rows by key before they fan out, so that later groupings by the key move nothing."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def reward_grid(spark: SparkSession, design: Design = CREDIT, unmarked: bool = True) -> DataFrame:
    rows = [(t, e, c.key, c.signs[0], c.signs[1], c.signs[2], r)
            for t in TEMPLATES for e in ENCODINGS for c in design.cells() for r in RESPONSES]
    if unmarked:
        rows += [(t, e, "unmarked", 0, 0, 0, r) for t in TEMPLATES for e in ENCODINGS for r in RESPONSES]
    return literal_rows(spark, rows, "template string, encoding string, cell string, s1 int, s2 int, s3 int, response string")


def planted(noise: Column, strong: Column, response: Column, s1: Column, s2: Column, s3: Column,
            n_words: Column) -> Column:
    """Thousandths: hash noise, a quality term, a sex and an age penalty on approval, a length term."""
    approve = response == "approve"
    return (noise + F.when(approve & strong, 300).otherwise(0) - F.when(approve, 150 * s1 + 60 * s2).otherwise(0)
            + F.when((response == "coded") & (s3 == 1), 40).otherwise(0)
            + F.when(approve, F.least(n_words, F.lit(400)) / 4).otherwise(0).cast("bigint"))


def rewards(spark: SparkSession, sf: str) -> DataFrame:
    """Long decision table: 45 rows per (record, template, encoding) block."""
    base = spread(records(spark, sf, text=False), "record_id").crossJoin(F.broadcast(reward_grid(spark)))
    noise = F.pmod(hash15(F.col("record_id"), F.col("template"), F.col("encoding"), F.col("cell"),
                          F.col("response")), F.lit(1000))
    milli = planted(noise, F.col("strong"), F.col("response"), F.col("s1"), F.col("s2"), F.col("s3"),
                    F.col("n_words"))
    return base.select("record_id", "strong", "grp", "prompt", "n_words", "template", "encoding", "cell",
                       "s1", "s2", "s3", "response", (milli / F.lit(1000.0)).alias("reward"))


def sql_h15(expr: str) -> str:
    return f"(('0x' || substr(sha256({expr}), 1, 15))::BIGINT)"


SQL_RECORDS = r"""records AS (
  SELECT 'doc-' || d.doc_id AS record_id, d.doc_id, l.quality = 1 AS strong, d.source AS grp, d.lang AS prompt,
         len(regexp_extract_all(d.text, '\S+'))::BIGINT AS n_words, d.text
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def sql_cells(design: Design = CREDIT, unmarked: bool = True) -> str:
    rows = [f"('{c.key}', {c.signs[0]}, {c.signs[1]}, {c.signs[2]})" for c in design.cells()]
    if unmarked:
        rows.append("('unmarked', 0, 0, 0)")
    return "cells AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(cell, s1, s2, s3))"


def sql_values(name: str, column: str, values) -> str:
    return f"{name} AS (SELECT * FROM (VALUES " + ", ".join(f"('{v}')" for v in values) + f") t({column}))"


SQL_REWARDS = ",\n".join([
    SQL_RECORDS, sql_cells(), sql_values("responses", "response", RESPONSES),
    sql_values("templates", "template", TEMPLATES), sql_values("encodings", "encoding", ENCODINGS),
    f"""rewards AS (
  SELECT record_id, strong, grp, prompt, n_words, template, encoding, cell, s1, s2, s3, response,
    ({sql_h15("record_id || '|' || template || '|' || encoding || '|' || cell || '|' || response")} % 1000
     + CASE WHEN response = 'approve' AND strong THEN 300 ELSE 0 END
     - CASE WHEN response = 'approve' THEN 150 * s1 + 60 * s2 ELSE 0 END
     + CASE WHEN response = 'coded' AND s3 = 1 THEN 40 ELSE 0 END
     + CASE WHEN response = 'approve' THEN least(n_words, 400) // 4 ELSE 0 END) / 1000 AS reward
  FROM records CROSS JOIN templates CROSS JOIN encodings CROSS JOIN cells CROSS JOIN responses)"""])


# ---- draws, as in counterlens.operators.resampling -----------------------------------------------------------
def sql_draws(name: str, sizes: str, by: list[str], replicates: int, seed: int, salt: int = 0,
              n: str = "n") -> str:
    """CTE ``name(by, b, j, idx)`` from the CTE ``sizes(by, n)``."""
    from counterlens.operators.resampling import MODULUS, ROUND_KEYS
    keys = "".join(f"{k}, " for k in by)
    parts = [f"{name}_0 AS (SELECT {keys}{n} AS n, b, j, {(seed + 7919 * salt) % MODULUS}::BIGINT AS x "
             f"FROM {sizes}, range({replicates}) rb(b), range({n}::BIGINT) rj(j))"]
    last = f"{name}_0"
    for i, (k, word) in enumerate(zip(ROUND_KEYS, ("b", "j", None))):
        plus = f" + {word}" if word else ""
        parts.append(f"{name}_{i}a AS (SELECT * REPLACE (((x + {k}{plus}) % {MODULUS})::BIGINT AS x) FROM {last})")
        parts.append(f"{name}_{i}b AS (SELECT *, (x * x) % {MODULUS} AS x2 FROM {name}_{i}a)")
        parts.append(f"{name}_{i}c AS (SELECT *, (x2 * x2) % {MODULUS} AS x4 FROM {name}_{i}b)")
        parts.append(f"{name}_{i}d AS (SELECT * EXCLUDE (x, x2, x4), (x4 * x) % {MODULUS} AS x FROM {name}_{i}c)")
        last = f"{name}_{i}d"
    parts.append(f"{name} AS (SELECT {keys}b, j, (x * n // {MODULUS})::BIGINT AS idx FROM {last})")
    return ",\n".join(parts)


def sql_index(source: str, key: str, by: list[str] = ()) -> str:
    """Expression: 0-based index of a cluster inside ``by`` in digest order."""
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    return f"(row_number() OVER ({part}ORDER BY sha256({key}::VARCHAR), {key}) - 1)"
