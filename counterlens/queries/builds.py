"""Dataset builds over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from counterlens.plans.datasets import credit_blocks, essay_blocks, hiring_blocks
from counterlens.queries.base import SEED, SQL_RECORDS, records, table
from counterlens.queries.design import SQL_DEC, SQL_RULES, coded
from counterlens.queries.registry import query
from counterlens.queries.splits import BARRED
from counterlens.queries.texts import ESSAY_SQL, HIRING_SQL, SQL_LAST


@query("r1_credit_build", f"""WITH {SQL_DEC}, k AS (SELECT source_record_id FROM dec WHERE NOT ({' OR '.join(f'({e})' for e in SQL_RULES.values())}))
SELECT t AS template, e AS encoding, count(*)::BIGINT AS blocks FROM k, (VALUES ('credit_v1'), ('credit_v2')) a(t), (VALUES ('explicit'), ('proxy')) b(e) GROUP BY ALL""")
def r1(spark, sf):
    """No block fails the gate: the clauses were written to pass it."""
    return credit_blocks(coded(spark, sf), SEED).groupBy("template", "encoding").agg(F.count(F.lit(1)).alias("blocks"))


_ESSAY = " OR ".join(f"({e})" for k, e in ESSAY_SQL.items() if k != "prompt_presupposes_a_pupil")


@query("r3_essay_build", f"""WITH {SQL_RECORDS}, {SQL_LAST.replace('FROM documents', 'FROM records')}, k AS (SELECT strong FROM lastline WHERE NOT ({_ESSAY}))
SELECT t AS template, e AS encoding, strong AS high_quality, count(*)::BIGINT AS blocks FROM k, (VALUES ('edu_v1'), ('edu_v2')) a(t), (VALUES ('explicit'), ('proxy')) b(e) GROUP BY ALL""")
def r3(spark, sf):
    e = records(spark, sf).select("record_id", F.col("text").alias("essay_text"), F.col("prompt").alias("prompt_id"),
                                  F.concat(F.lit("Task "), F.col("prompt"), F.lit(".")).alias("assignment"), F.col("strong").alias("high_quality"))
    return essay_blocks(e, SEED).groupBy("template", "encoding", "high_quality").agg(F.count(F.lit(1)).alias("blocks"))


CAP = 0.3


@query("r2_hiring_build", f"""WITH d AS (SELECT doc_id, source FROM documents WHERE source IS NOT NULL AND NOT coalesce({' OR '.join(f'({e})' for e in HIRING_SQL.values())}, false)),
c AS (SELECT source, count(*) AS n FROM d GROUP BY 1),
k AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS k, sum(n) OVER () AS total, sum(n) OVER (ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS top,
  lead(n) OVER (ORDER BY n DESC) AS nxt, max(n) OVER () AS biggest FROM c),
m AS (SELECT *, CASE WHEN {CAP}::DOUBLE * k < 1 THEN floor({CAP}::DOUBLE * (total - top) / (1 - {CAP}::DOUBLE * k)) ELSE biggest END AS m FROM k),
l AS (SELECT CASE WHEN max(biggest) > {CAP}::DOUBLE * max(total) THEN arg_min(least(m, n), k) FILTER (nxt IS NULL OR m >= nxt) END AS lim FROM m),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('{SEED}|cap|' || doc_id), doc_id) AS rk FROM d),
h AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('{SEED}|' || doc_id), doc_id) AS rk, count(*) OVER (PARTITION BY source) AS n FROM r, l WHERE lim IS NULL OR rk <= lim),
q AS (SELECT source, rk <= n // 2 OR (n % 2 = 1 AND rk = n // 2 + 1 AND substr(sha256('{SEED}|' || doc_id), 1, 1) < '8') AS qualified FROM h)
SELECT t AS template, source AS profession, qualified, count(*)::BIGINT AS explicit_blocks, true AS proxy_kept, count(*) FILTER (qualified)::BIGINT AS own_role, 0::BIGINT AS near_role
FROM q, (VALUES ('bios_v1'), ('bios_v2')) a(t) GROUP BY ALL""")
def r2(spark, sf):
    """Blocks per template, profession and label: all explicit ones pass the gate, and of a template's proxy ones (names differ in
    length and reading ease) nine in ten at least; qualified candidates keep their own role, the others get neither it nor a near-synonym."""
    bios = table(spark, sf, "documents").filter("source IS NOT NULL").select("doc_id", F.col("source").alias("profession"), F.col("text").alias("bio_text"))
    b = hiring_blocks(bios, SEED, "doc_id", CAP, forbidden=BARRED)
    near = F.concat_ws("|", F.least("profession", "target_role"), F.greatest("profession", "target_role")).isin(["|".join(p) for p in BARRED])
    explicit = F.col("encoding") == "explicit"
    per = b.groupBy("template", "profession", "qualified").agg(
        F.count_if(explicit).alias("explicit_blocks"), F.count_if(~explicit).alias("proxy_blocks"),
        F.count_if(explicit & (F.col("profession") == F.col("target_role"))).alias("own_role"), F.count_if(near).alias("near_role"))
    every = Window.partitionBy("template")                                          # a row per profession and label
    return per.withColumn("proxy_kept", F.sum("proxy_blocks").over(every) >= 0.9 * F.sum("explicit_blocks").over(every)).drop("proxy_blocks")
