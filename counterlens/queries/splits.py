"""Splits, folds, quotas, sampling and matching over the labelled documents and the TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from counterlens.functions.keyed import choice_index, digest, uniform
from counterlens.operators import ranking, splits as S
from counterlens.queries.base import SQL_RECORDS, SEED, literal_rows, r9, records, spread, sql_h15, table
from counterlens.queries.registry import query

HASH = "sha256('42|' || record_id)"


def recs(spark, sf):
    return records(spark, sf, text=False)


@query("w1_probe_split", f"""WITH {SQL_RECORDS}, sz AS (SELECT strong, count(*) AS size FROM records GROUP BY 1),
n AS (SELECT least(150, greatest(sum(size) - least(greatest(sum(size) // 5, 1), 50), 1)) AS n, sum(size) AS total FROM sz),
q AS (SELECT strong, n * size / total AS x, floor(n * size / total) AS f, n FROM sz, n),
qq AS (SELECT strong, (f + CASE WHEN row_number() OVER (ORDER BY x - f DESC, strong::VARCHAR) <= n - sum(f) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM q)
SELECT record_id, strong, row_number() OVER (PARTITION BY strong ORDER BY {HASH}, record_id) <= quota AS probe FROM records JOIN qq USING (strong)""")
def w1(spark, sf):
    return S.probe_split(recs(spark, sf), "record_id", "strong", 150, SEED).select("record_id", "strong", "probe")


@query("w2_interleaved_order", f"""WITH {SQL_RECORDS}, m AS (SELECT record_id, t FROM records, (VALUES ('v1'), ('v2'), ('v3')) x(t)),
p AS (SELECT record_id, row_number() OVER (ORDER BY {HASH}, record_id) - 1 AS record_pos FROM records)
SELECT record_id, t, record_pos, ((((row_number() OVER (PARTITION BY record_id ORDER BY t) - 1 - record_pos) % 3) + 3) % 3)::BIGINT AS turn FROM m JOIN p USING (record_id)""")
def w2(spark, sf):
    m = recs(spark, sf).select("record_id", F.explode(F.array(*[F.lit(x) for x in ("v1", "v2", "v3")])).alias("t"))
    return S.interleaved(m, "record_id", "t", SEED)


@query("w3_capped_groups", """WITH d AS (SELECT doc_id, lang FROM documents), c AS (SELECT lang, count(*) AS n FROM d GROUP BY 1),
k AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS k, sum(n) OVER () AS total, sum(n) OVER (ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS top,
  lead(n) OVER (ORDER BY n DESC) AS nxt, max(n) OVER () AS biggest FROM c),
m AS (SELECT *, CASE WHEN 0.3::DOUBLE * k < 1 THEN floor(0.3::DOUBLE * (total - top) / (1 - 0.3::DOUBLE * k)) ELSE biggest END AS m FROM k),
l AS (SELECT CASE WHEN max(biggest) > 0.3::DOUBLE * max(total) THEN arg_min(least(m, n), k) FILTER (nxt IS NULL OR m >= nxt) END AS lim FROM m),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('7|' || doc_id), doc_id) AS rk FROM d)
SELECT doc_id, lang FROM r, l WHERE lim IS NULL OR rk <= lim""")
def w3(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return S.cap_groups(d, "lang", digest(7, F.col("doc_id")), "doc_id", 0.3)


@query("w4_half_labels", f"""WITH {SQL_RECORDS}, r AS (SELECT record_id, grp, row_number() OVER (PARTITION BY grp ORDER BY {HASH}, record_id) AS rk,
  count(*) OVER (PARTITION BY grp) AS n FROM records)
SELECT record_id, grp, rk <= n // 2 OR (n % 2 = 1 AND rk = n // 2 + 1 AND substr({HASH}, 1, 1) < '8') AS head FROM r""")
def w4(spark, sf):
    return S.half_labels(recs(spark, sf).select("record_id", "grp"), "record_id", "grp", SEED)


BARRED = [("src0", "src1"), ("src2", "src3")]


@query("w5_role_derangement", f"WITH {SQL_RECORDS} SELECT grp, count(*)::BIGINT AS rows, count(*)::BIGINT AS targets, 0::BIGINT AS kept, 0::BIGINT AS barred FROM records GROUP BY grp")
def w5(spark, sf):
    """Per label: its rows, how often it is a target (as often), rows that keep it or get a barred partner's (none)."""
    d = S.derangement(recs(spark, sf).select("record_id", "grp"), "record_id", "grp", SEED, BARRED)
    barred = F.concat_ws("|", F.least("grp", "target"), F.greatest("grp", "target")).isin(["|".join(p) for p in BARRED])
    each = d.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("grp") == F.col("target")).alias("kept"), F.count_if(barred).alias("barred"))
    aims = d.groupBy(F.col("target").alias("grp")).agg(F.count(F.lit(1)).alias("targets"))
    return each.join(aims, "grp", "left").select("grp", "rows", "targets", "kept", "barred")


@query("w6_balanced_couples", f"""WITH {SQL_RECORDS}, p AS (SELECT record_id, prompt, strong, row_number() OVER (ORDER BY {HASH}, record_id) AS pos,
  row_number() OVER (PARTITION BY prompt, strong ORDER BY {HASH}, record_id) AS i FROM records),
c AS (SELECT prompt, i, min(pos) AS couple FROM p GROUP BY ALL HAVING count(*) = 2),
k AS (SELECT *, row_number() OVER (ORDER BY couple) AS rk FROM c)
SELECT record_id, p.prompt, strong, couple FROM p JOIN k ON p.prompt = k.prompt AND p.i = k.i WHERE rk <= 30""")
def w6(spark, sf):
    d = recs(spark, sf).select("record_id", "prompt", "strong")
    return S.balanced_couples(d, "record_id", "prompt", "strong", SEED, 60).select("record_id", "prompt", "strong", "couple")


@query("w8_fold_deal", f"""WITH {SQL_RECORDS} SELECT record_id, strong,
  ((row_number() OVER (PARTITION BY strong ORDER BY sha256('42|folds|' || strong::VARCHAR || '|' || record_id), record_id) - 1) % 5)::INTEGER AS fold FROM records""")
def w8(spark, sf):
    return S.deal_folds(recs(spark, sf).select("record_id", "strong"), "record_id", "strong", 5, SEED)


SQL_POOLS = f"""n AS (SELECT count(*) FILTER (strong) AS s, count(*) FILTER (NOT strong) AS w FROM records),
q AS (SELECT round_even(2.0::DOUBLE * least(s, w) / (3.0::DOUBLE * s) * s, 0)::BIGINT AS os, round_even(2.0::DOUBLE * least(s, w) / (3.0::DOUBLE * w) * w, 0)::BIGINT AS ow, s, w FROM n),
rp AS (SELECT record_id, strong, prompt, row_number() OVER (PARTITION BY strong ORDER BY sha256('42|pool|' || record_id), record_id) AS rk FROM records),
pools AS (SELECT record_id, strong, prompt, CASE WHEN rk <= CASE WHEN strong THEN os ELSE ow END THEN CASE WHEN strong THEN 'strong_strong' ELSE 'weak_weak' END
  WHEN rk <= CASE WHEN strong THEN os ELSE ow END + least(s - os, w - ow) THEN CASE WHEN strong THEN 'strong_weak:strong' ELSE 'strong_weak:weak' END
  ELSE 'unused' END AS pool FROM rp, q)"""


@query("w9_pool_quotas", f"WITH {SQL_RECORDS}, {SQL_POOLS} SELECT record_id, strong, pool FROM pools")
def w9(spark, sf):
    return S.pool_shares(recs(spark, sf), "record_id", "strong", SEED).select("record_id", "strong", "pool")


SQL_DRAWN = """o AS (SELECT record_id, prompt, pool, row_number() OVER (PARTITION BY pool, prompt ORDER BY sha256('42|order|' || record_id), record_id) AS i
  FROM pools WHERE pool <> 'unused'),
b AS (SELECT pool AS pairing, prompt, (i + 1) // 2 AS p, (i + 1) % 2 AS side, record_id FROM o WHERE pool IN ('strong_strong', 'weak_weak')
  UNION ALL SELECT 'strong_weak', prompt, i, (pool = 'strong_weak:weak')::INT, record_id FROM o WHERE pool LIKE 'strong_weak%'),
drawn AS (SELECT pairing, prompt, p, max(record_id) FILTER (side = 0) AS x, max(record_id) FILTER (side = 1) AS y FROM b GROUP BY ALL),
record_pairs AS (SELECT pairing, prompt, x, y, row_number() OVER (PARTITION BY pairing ORDER BY sha256('42|order|' || x), x) - 1 AS idx
  FROM drawn WHERE x IS NOT NULL AND y IS NOT NULL)"""


def record_pairs(spark, sf):
    from counterlens.session import cut_lineage
    pooled = cut_lineage(S.pool_shares(recs(spark, sf), "record_id", "strong", SEED))
    return cut_lineage(S.draw_pairs(pooled, "record_id", "prompt", SEED).withColumnRenamed("index", "idx"))


@query("j6_record_pairs", f"WITH {SQL_RECORDS}, {SQL_POOLS}, {SQL_DRAWN} SELECT pairing, prompt, x, y, idx FROM record_pairs")
def j6(spark, sf):
    return record_pairs(spark, sf)


_LIMITS = f"""{SQL_RECORDS}, {SQL_POOLS}, pg AS (SELECT p.*, r.grp FROM pools p JOIN records r USING (record_id)),
cl AS (SELECT split_part(pool, ':', 1) AS pairing, prompt, grp, count(*) FILTER (strong) AS s, count(*) FILTER (NOT strong) AS w FROM pg WHERE pool <> 'unused' GROUP BY ALL),
gr AS (SELECT pairing, prompt, sum(s) AS s, sum(w) AS w, max(s + w) AS m FROM cl GROUP BY ALL),
lim AS (SELECT pairing, prompt, s + w AS records, CASE WHEN pairing = 'strong_weak' THEN least(s, w, s + w - m) ELSE least((s + w) // 2, s + w - m) END AS pairs FROM gr)"""


@query("j6_pairs_without_clash", f"""WITH {_LIMITS} SELECT pairing, prompt, pairs::BIGINT AS pairs, (2 * pairs)::BIGINT AS distinct_records, 0::BIGINT AS clashes, 0::BIGINT AS wrong_sides FROM lim WHERE pairs > 0""")
def j6_clash(spark, sf):
    """Per pairing and match group: as many pairs as the class counts allow, no record twice, no two of one class, each from its pool."""
    pooled = S.pool_shares(recs(spark, sf), "record_id", "strong", SEED).select("record_id", "prompt", "grp", "strong", "pool")
    p = S.settle_pairs(pooled, "record_id", "prompt", SEED, "grp")
    side = lambda c: pooled.select(F.col("record_id").alias(c), F.col("grp").alias(f"{c}_grp"), F.col("pool").alias(f"{c}_pool"))
    j = p.join(side("x"), "x").join(side("y"), "y")
    right = F.when(F.col("pairing") == "strong_weak", (F.col("x_pool") == "strong_weak:strong") & (F.col("y_pool") == "strong_weak:weak")).otherwise(
        (F.col("x_pool") == F.col("pairing")) & (F.col("y_pool") == F.col("pairing")))
    both = j.withColumn("r", F.explode(F.array("x", "y")))
    return both.groupBy("pairing", "prompt").agg((F.count(F.lit(1)) / 2).cast("long").alias("pairs"), F.count_distinct("r").alias("distinct_records"),
                                                 F.count_if(F.col("x_grp").eqNullSafe(F.col("y_grp"))).alias("clashes"), F.count_if(~right).alias("wrong_sides"))


REQUEST = {"strong_strong": 20, "strong_weak": 25, "weak_weak": 10}


@query("j6_x5_leftovers", f"""WITH {_LIMITS}, rq AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in REQUEST.items())}) t(pairing, want)),
t AS (SELECT pairing, sum(pairs) AS possible, sum(records) AS records FROM lim GROUP BY pairing)
SELECT 'paired' AS reason, (2 * sum(least(possible, want)))::BIGINT AS records FROM t JOIN rq USING (pairing) UNION ALL
SELECT 'beyond the request', (2 * sum(possible - least(possible, want)))::BIGINT FROM t JOIN rq USING (pairing) UNION ALL
SELECT 'outside the pools', count(*)::BIGINT FROM pools WHERE pool = 'unused' UNION ALL SELECT 'no partner', (sum(records) - 2 * sum(possible))::BIGINT FROM t""")
def j6_leftovers(spark, sf):
    """A request smaller than what is possible: every record is paired or has one reason."""
    pooled = S.pool_shares(recs(spark, sf), "record_id", "strong", SEED).select("record_id", "prompt", "grp", "pool")
    every = S.settle_pairs(pooled, "record_id", "prompt", SEED, "grp")
    pairs = every.filter(F.col("index") < F.element_at(F.create_map(*[F.lit(v) for i in REQUEST.items() for v in i]), F.col("pairing")))
    rest = S.unpaired(pooled, pairs, "record_id", "prompt", "grp", every)
    reason = F.when(F.col("reason").isin("same class", "no partner left"), "no partner").otherwise(F.col("reason"))
    zero = literal_rows(spark, [(r, 0) for r in ("beyond the request", "outside the pools", "no partner")], "reason string, n long")
    left = rest.select(reason.alias("reason"), F.lit(1).cast("long").alias("n")).unionByName(zero).groupBy("reason").agg(F.sum("n").alias("records"))
    return pairs.agg(F.lit("paired").alias("reason"), (2 * F.count(F.lit(1))).alias("records")).unionByName(left)


@query("w10_context_rotation", f"""WITH {SQL_RECORDS}, {SQL_POOLS}, {SQL_DRAWN} SELECT pairing, x, y, idx,
  ['30|married', '30|single', '50|married', '50|single'][1 + idx % 4] AS setting FROM record_pairs""")
def w10(spark, sf):
    settings = F.array(*[F.lit(s) for s in ("30|married", "30|single", "50|married", "50|single")])
    return record_pairs(spark, sf).select("pairing", "x", "y", "idx",
                                          F.element_at(settings, (F.pmod("idx", F.lit(4)) + 1).cast("int")).alias("setting"))


@query("w11_keyed_choice", f"""WITH {SQL_RECORDS} SELECT record_id, ({sql_h15("'42|' || record_id || '|responses'")} % 3)::INTEGER AS paraphrase FROM records""")
def w11(spark, sf):
    return recs(spark, sf).select("record_id", choice_index(3, SEED, F.col("record_id"), "responses").alias("paraphrase"))


@query("w12_even_split", """WITH a AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT 600 AS total),
k AS (SELECT lang, n, row_number() OVER (ORDER BY n, lang) AS k, count(*) OVER () AS m, coalesce(sum(n) OVER (ORDER BY n, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM a),
s AS (SELECT *, floor((total - below) / (m - k + 1)) AS share FROM k, t), st AS (SELECT min(k) AS k0, arg_min(share, k) AS lvl FROM s WHERE n > share), f AS (SELECT s.*, lvl, coalesce(k < k0, true) AS filled FROM s, st),
g AS (SELECT lang, n, total, CASE WHEN filled THEN n ELSE lvl END AS alloc FROM f),
h AS (SELECT *, total - sum(alloc) OVER () AS rest, row_number() OVER (ORDER BY (n <= alloc)::INT, lang) AS i FROM g)
SELECT lang, n AS available, (alloc + CASE WHEN n > alloc AND i <= rest THEN 1 ELSE 0 END)::BIGINT AS alloc FROM h""")
def w12(spark, sf):
    a = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("available"))
    return S.even_split(a, "lang", "available", 600)


@query("w13_equal_group_selection", f"""WITH {SQL_RECORDS}, c AS (SELECT prompt, least(count(*) FILTER (strong), count(*) FILTER (NOT strong)) AS n FROM records GROUP BY 1),
size AS (SELECT sum(n) AS n FROM c WHERE prompt IN ('fr', 'es')),
k AS (SELECT prompt, n, CASE WHEN prompt IN ('fr', 'es') THEN n ELSE least(n, (SELECT n FROM size)) END AS quota FROM c WHERE prompt IN ('fr', 'es', 'de')),
r AS (SELECT record_id, prompt, strong, row_number() OVER (PARTITION BY prompt, strong ORDER BY sha256('42|standpoint|' || record_id), record_id) AS rk FROM records)
SELECT record_id, r.prompt, strong FROM r JOIN k ON r.prompt = k.prompt WHERE rk <= quota""")
def w13(spark, sf):
    """Two topic groups of equal size in strong/weak couples: fr and es against de."""
    r = recs(spark, sf)
    couples = r.groupBy("prompt").agg(F.least(F.count_if("strong"), F.count_if(~F.col("strong"))).alias("n"))
    small = couples.filter(F.col("prompt").isin("fr", "es")).agg(F.sum("n").alias("size"))
    quota = couples.filter(F.col("prompt").isin("fr", "es", "de")).crossJoin(F.broadcast(small)).select(
        "prompt", F.when(F.col("prompt") == "de", F.least("n", "size")).otherwise(F.col("n")).alias("quota"))
    ranked = ranking.hash_rank(r.select("record_id", "prompt", "strong"), digest(SEED, "standpoint", F.col("record_id")),
                               ["record_id"], ["prompt", "strong"], "rk")
    return ranked.join(F.broadcast(quota), "prompt").filter("rk <= quota").select("record_id", "prompt", "strong")


@query("w14_average_ranks", """SELECT c_custkey, c_mktsegment, round(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey)
  + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2, 9) AS avg_rank,
  round(1 - (rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2 - 1)
  / (count(*) OVER (PARTITION BY c_mktsegment) - 1), 9) AS low_is_good FROM customer""")
def w14(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("double").alias("v"))
    ranked = ranking.average_rank(c, ["c_mktsegment"], "v")
    n = c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return ranked.join(n, "c_mktsegment").select("c_custkey", "c_mktsegment", r9("avg_rank").alias("avg_rank"),
                                                 r9(1 - (F.col("avg_rank") - 1) / (F.col("n") - 1)).alias("low_is_good"))


@query("w15_first_seen", """WITH e AS (SELECT CASE WHEN event_id % 50 = 0 THEN ' ' ELSE user_id::VARCHAR || '-' || event_type END AS key, event_id, value FROM events)
SELECT key, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM e WHERE trim(key) <> '' GROUP BY key""")
def w15(spark, sf):
    e = table(spark, sf, "events").select(
        F.when(F.col("event_id") % 50 == 0, F.lit(" ")).otherwise(
            F.concat_ws("-", F.col("user_id").cast("string"), "event_type")).alias("key"), "event_id", "value")
    return S.first_seen(e, "key", "event_id")


@query("w16_template_alternation", f"""WITH {SQL_RECORDS} SELECT record_id, ['v1', 'v2'][1 + (row_number() OVER (ORDER BY {HASH}, record_id) - 1) % 2] AS template FROM records""")
def w16(spark, sf):
    r = ranking.hash_rank(recs(spark, sf).select("record_id"), digest(SEED, F.col("record_id")), ["record_id"], [], "rk")
    return r.select("record_id", F.element_at(F.array(F.lit("v1"), F.lit("v2")),
                                              (F.pmod(F.col("rk") - 1, F.lit(2)) + 1).cast("int")).alias("template"))


@query("l1_seeded_shuffle_prefix", f"""WITH {SQL_RECORDS} SELECT record_id, strong FROM records ORDER BY {HASH}, record_id LIMIT 100""")
def l1(spark, sf):
    return S.seeded_order(recs(spark, sf).select("record_id", "strong"), "record_id", SEED, 100)


@query("l2_selection_per_class", f"""WITH {SQL_RECORDS}, fit AS (SELECT * FROM records WHERE n_words <= 400),
r AS (SELECT record_id, strong, n_words, row_number() OVER (PARTITION BY strong ORDER BY {HASH}, record_id) AS rk FROM fit)
SELECT record_id, strong, n_words FROM r WHERE rk <= 40""")
def l2(spark, sf):
    fit = recs(spark, sf).filter("n_words <= 400").select("record_id", "strong", "n_words")
    return S.select_per_class(fit, "record_id", "strong", 40, SEED)


@query("l2_selection_report", f"""WITH {SQL_RECORDS} SELECT strong, count(*)::BIGINT AS available, count(*) FILTER (n_words > 400)::BIGINT AS too_long,
  least(count(*) FILTER (n_words <= 400), 80)::BIGINT AS selected, greatest(80 - count(*) FILTER (n_words <= 400), 0)::BIGINT AS shortfall FROM records GROUP BY strong""")
def l2_report(spark, sf):
    fits = F.count_if(F.col("n_words") <= 400)
    return recs(spark, sf).groupBy("strong").agg(
        F.count(F.lit(1)).alias("available"), F.count_if(F.col("n_words") > 400).alias("too_long"),
        F.least(fits, F.lit(80)).cast("long").alias("selected"), F.greatest(80 - fits, F.lit(0)).cast("long").alias("shortfall"))


@query("l3_strong_without_probe", f"""WITH {SQL_RECORDS}, p AS (SELECT record_id FROM (SELECT record_id, row_number() OVER (ORDER BY {HASH}, record_id) AS rk FROM records WHERE strong) WHERE rk <= 60),
r AS (SELECT record_id, row_number() OVER (ORDER BY sha256('7|' || record_id), record_id) AS rk FROM records WHERE strong AND record_id NOT IN (SELECT record_id FROM p))
SELECT record_id FROM r WHERE rk <= 50""")
def l3(spark, sf):
    strong = recs(spark, sf).filter("strong").select("record_id")
    probe = S.seeded_order(strong, "record_id", SEED, 60)
    return S.seeded_order(strong.join(probe, "record_id", "left_anti"), "record_id", 7, 50)


@query("l4_stratified_sample", """WITH k AS (SELECT ceil(50 / count(DISTINCT source)) AS k FROM documents),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('42|' || doc_id), doc_id) AS rk FROM documents)
SELECT doc_id, source FROM r, k WHERE rk <= k""")
def l4(spark, sf):
    return S.stratified_sample(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", "source", 50, SEED)


@query("l5_first_per_subset", """SELECT o_orderkey, o_orderpriority FROM (SELECT o_orderkey, o_orderpriority,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rk FROM orders) WHERE rk <= 25""")
def l5(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderkey").cast("double").alias("pos"))
    return ranking.ordered_rank(o, ["o_orderpriority"], "pos", [], "rk").filter("rk <= 25").select("o_orderkey", "o_orderpriority")


@query("l7_rank_range_split", f"""WITH {SQL_RECORDS}, r AS (SELECT record_id, row_number() OVER (ORDER BY {HASH}, record_id) AS rk FROM records)
SELECT record_id, CASE WHEN rk <= 200 THEN 'train' ELSE 'eval' END AS side FROM r WHERE rk <= 300""")
def l7(spark, sf):
    r = ranking.hash_rank(recs(spark, sf).select("record_id"), digest(SEED, F.col("record_id")), ["record_id"], [], "rk")
    return r.filter("rk <= 300").select("record_id", F.when(F.col("rk") <= 200, "train").otherwise("eval").alias("side"))


@query("l8_top_contrast", """WITH c AS (SELECT o_orderpriority AS axis, o_orderstatus AS status, stddev_samp(o_totalprice) / avg(o_totalprice) AS r FROM orders GROUP BY ALL)
SELECT status, arg_max(axis, r) AS binding, round(max(r), 9) AS r, arg_min(axis, r) AS loosest FROM c GROUP BY status""")
def l8(spark, sf):
    c = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("axis"), F.col("o_orderstatus").alias("status")).agg(
        (F.stddev_samp("o_totalprice") / F.avg("o_totalprice")).alias("r"))
    return c.groupBy("status").agg(F.max_by("axis", "r").alias("binding"), r9(F.max("r")).alias("r"), F.min_by("axis", "r").alias("loosest"))


# ---- joins -----------------------------------------------------------------------------------------------------------
@query("j3_probe_exclusion", f"""WITH {SQL_RECORDS}, p AS (SELECT record_id FROM (SELECT record_id, row_number() OVER (ORDER BY {HASH}, record_id) AS rk FROM records) WHERE rk <= 150)
SELECT record_id, strong FROM records WHERE record_id NOT IN (SELECT record_id FROM p)""")
def j3(spark, sf):
    r = recs(spark, sf).select("record_id", "strong")
    return r.join(S.seeded_order(r, "record_id", SEED, 150).select("record_id"), "record_id", "left_anti")


@query("j4_pool_equality", """WITH a AS (SELECT doc_id, quality FROM labels WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels WHERE doc_id % 5 <> 0)
SELECT count(*) FILTER (a.doc_id IS NULL)::BIGINT AS only_manifest, count(*) FILTER (b.doc_id IS NULL)::BIGINT AS only_loaded,
  count(*) FILTER (a.quality <> b.quality)::BIGINT AS labels_differ, count(*) FILTER (a.quality = b.quality)::BIGINT AS same FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def j4(spark, sf):
    """Two versions of a pool that differ in ids and labels, compared whole."""
    lab = table(spark, sf, "labels")
    a = lab.filter("doc_id % 7 <> 0").select("doc_id", F.col("quality").alias("qa"))
    b = lab.filter("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 11 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("qb"))
    return a.join(b, "doc_id", "full").agg(F.count_if(F.col("qa").isNull()).alias("only_manifest"), F.count_if(F.col("qb").isNull()).alias("only_loaded"),
                                           F.count_if(F.col("qa") != F.col("qb")).alias("labels_differ"), F.count_if(F.col("qa") == F.col("qb")).alias("same"))


SQL_CUST = "cu AS (SELECT c_custkey, c_mktsegment, c_nationkey, floor(c_acctbal / 1000)::BIGINT AS band FROM customer)"


def _cust(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", F.floor(F.col("c_acctbal") / 1000).cast("long").alias("band"), "c_acctbal")


@query("j5_exact_matching", f"""WITH {SQL_CUST},
t AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, band ORDER BY sha256('42|treated|' || c_custkey), c_custkey) AS i FROM cu WHERE c_mktsegment = 'BUILDING'),
p AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, band ORDER BY sha256('42|pool|' || c_custkey), c_custkey) AS i FROM cu WHERE c_mktsegment <> 'BUILDING')
SELECT t.c_nationkey, t.band, t.c_custkey AS treated, p.c_custkey AS control FROM t LEFT JOIN p ON t.c_nationkey = p.c_nationkey AND t.band = p.band AND t.i = p.i""")
def j5(spark, sf):
    c = _cust(spark, sf)
    return S.match_one_to_one(c.filter("c_mktsegment = 'BUILDING'"), c.filter("c_mktsegment <> 'BUILDING'"), ["c_nationkey", "band"], "c_custkey", SEED)


@query("j14_majority_rule", """WITH tr AS (SELECT c_mktsegment, c_acctbal > 4500 AS label, c_nationkey FROM customer WHERE c_nationkey < 20), ev AS (SELECT c_custkey, c_nationkey, c_acctbal > 4500 AS label FROM customer),
r AS (SELECT c_nationkey, avg(label::INT) >= 0.5 AS rule FROM tr GROUP BY 1), o AS (SELECT avg(label::INT) >= 0.5 AS rule FROM tr)
SELECT count(*)::BIGINT AS n, round(avg((coalesce(r.rule, o.rule) = label)::INT), 9) AS accuracy, count(*) FILTER (r.rule IS NULL)::BIGINT AS unseen FROM ev LEFT JOIN r USING (c_nationkey), o""")
def j14(spark, sf):
    """Field rule fitted on some nations, overall rule for the unseen ones; also A37's accuracy."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") > 4500).alias("label"))
    tr = c.filter("c_nationkey < 20")
    share = F.avg(F.col("label").cast("double")) >= 0.5
    rule, overall = tr.groupBy("c_nationkey").agg(share.alias("rule")), tr.agg(share.alias("overall"))
    ev = c.join(F.broadcast(rule), "c_nationkey", "left").crossJoin(F.broadcast(overall))
    return ev.agg(F.count(F.lit(1)).alias("n"), r9(F.avg((F.coalesce("rule", "overall") == F.col("label")).cast("double"))).alias("accuracy"),
                  F.count_if(F.col("rule").isNull()).alias("unseen"))


@query("a37_field_rule_above_chance", """WITH ev AS (SELECT c_nationkey, c_mktsegment, c_acctbal > 4500 AS label FROM customer),
f AS (SELECT 'c_nationkey' AS field, c_nationkey::VARCHAR AS v, label FROM ev UNION ALL SELECT 'c_mktsegment', c_mktsegment, label FROM ev),
p AS (SELECT field, v, count(*) FILTER (label) AS y, count(*) FILTER (NOT label) AS n FROM f GROUP BY ALL)
SELECT field, round(sum(greatest(y, n)) / sum(y + n), 9) AS accuracy, round(sum(greatest(y, n)) / sum(y + n) - greatest(sum(y), sum(n)) / sum(y + n), 9) AS above_chance FROM p GROUP BY field""")
def a37(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string"), "c_mktsegment", (F.col("c_acctbal") > 4500).alias("label"))
    f = c.unpivot(["label"], ["c_nationkey", "c_mktsegment"], "field", "v")
    p = f.groupBy("field", "v").agg(F.count_if("label").alias("y"), F.count_if(~F.col("label")).alias("n"))
    total, best = F.sum(F.col("y") + F.col("n")), F.sum(F.greatest("y", "n"))
    return p.groupBy("field").agg(r9(best / total).alias("accuracy"), r9(best / total - F.greatest(F.sum("y"), F.sum("n")) / total).alias("above_chance"))


@query("j20_records_on_all_axes", """SELECT l_orderkey, count(DISTINCT l_returnflag)::BIGINT AS axes FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)""")
def j20(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")
    k = li.agg(F.count_distinct("l_returnflag").alias("k"))
    per = li.groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("axes"))
    return per.crossJoin(F.broadcast(k)).filter("axes = k").select("l_orderkey", "axes")


@query("j21_pairing_candidates", f"""WITH {SQL_RECORDS}, b AS (SELECT record_id, strong, prompt, e, t FROM records, (VALUES ('explicit'), ('proxy')) x(e), (VALUES ('v1'), ('v2')) y(t)
  WHERE NOT ({sql_h15("record_id || '|' || e || '|' || t")} % 20 = 0)),
p AS (SELECT record_id FROM (SELECT record_id, row_number() OVER (ORDER BY {HASH}, record_id) AS rk FROM records) WHERE rk <= 40)
SELECT record_id, any_value(strong) AS strong, any_value(prompt) AS prompt FROM b WHERE record_id NOT IN (SELECT record_id FROM p) GROUP BY record_id HAVING count(DISTINCT e || t) = 4""")
def j21(spark, sf):
    """Records whose every (encoding, template) block survived the gate and that trained no probe."""
    from counterlens.functions.keyed import hash15
    r = recs(spark, sf).select("record_id", "strong", "prompt")
    grid = F.explode(F.array(*[F.struct(F.lit(e).alias("e"), F.lit(t).alias("t")) for e in ("explicit", "proxy") for t in ("v1", "v2")]))
    b = r.select("*", grid.alias("g")).filter(F.pmod(hash15(F.col("record_id"), F.col("g.e"), F.col("g.t")), F.lit(20)) != 0)
    whole = b.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.any_value("strong").alias("strong"), F.any_value("prompt").alias("prompt"))
    probe = S.seeded_order(r, "record_id", SEED, 40).select("record_id")
    return whole.filter("n = 4").join(probe, "record_id", "left_anti").select("record_id", "strong", "prompt")


@query("a36_group_balance", """WITH g AS (SELECT c_mktsegment = 'BUILDING' AS treated, c_nationkey::VARCHAR AS nation, floor(c_acctbal / 1000)::VARCHAR AS band, c_acctbal FROM customer),
f AS (SELECT treated, 'nation' AS field, nation AS v FROM g UNION ALL SELECT treated, 'band', band FROM g),
s AS (SELECT field, v, count(*) FILTER (treated) AS a, count(*) FILTER (NOT treated) AS b FROM f GROUP BY ALL),
t AS (SELECT field, v, a / sum(a) OVER (PARTITION BY field) AS pa, b / sum(b) OVER (PARTITION BY field) AS pb FROM s)
SELECT field, round(0.5 * sum(abs(pa - pb)), 9) AS distance FROM t GROUP BY field
UNION ALL SELECT 'c_acctbal', round((avg(c_acctbal) FILTER (treated) - avg(c_acctbal) FILTER (NOT treated)) / sqrt((var_samp(c_acctbal) FILTER (treated) + var_samp(c_acctbal) FILTER (NOT treated)) / 2), 9) FROM g""")
def a36(spark, sf):
    """Total variation per categorical field, standardised mean difference per numeric one."""
    g = table(spark, sf, "customer").select((F.col("c_mktsegment") == "BUILDING").alias("treated"), F.col("c_nationkey").cast("string").alias("nation"),
                                            F.floor(F.col("c_acctbal") / 1000).cast("string").alias("band"), "c_acctbal")
    f = g.unpivot(["treated"], ["nation", "band"], "field", "v")
    s = f.groupBy("field", "v").agg(F.count_if("treated").alias("a"), F.count_if(~F.col("treated")).alias("b"))
    w = Window.partitionBy("field")
    tv = (s.withColumn("d", F.abs(F.col("a") / F.sum("a").over(w) - F.col("b") / F.sum("b").over(w)))
          .groupBy("field").agg(r9(0.5 * F.sum("d")).alias("distance")))
    t, v = F.col("treated"), F.col("c_acctbal")
    smd = g.agg(F.lit("c_acctbal").alias("field"), r9((F.avg(F.when(t, v)) - F.avg(F.when(~t, v))) / F.sqrt(
        (F.var_samp(F.when(t, v)) + F.var_samp(F.when(~t, v))) / 2)).alias("distance"))
    return tv.unionByName(smd)


@query("a36_chance_balance", """WITH g AS (SELECT c_custkey, c_nationkey::VARCHAR AS v FROM customer),
n AS (SELECT least(count(*) FILTER (c_mktsegment = 'BUILDING'), count(*) // 2) AS k FROM customer),
s AS (SELECT draw, v, row_number() OVER (PARTITION BY draw ORDER BY sha256('42|' || draw || '|' || c_custkey), c_custkey) AS rk FROM g, range(200) t(draw)),
c AS (SELECT draw, v, count(*) FILTER (rk <= k) AS ca, count(*) FILTER (rk > k) AS cb FROM s, n WHERE rk <= 2 * k GROUP BY ALL),
d AS (SELECT draw, v, abs(ca / sum(ca) OVER (PARTITION BY draw) - cb / sum(cb) OVER (PARTITION BY draw)) AS d FROM c),
e AS (SELECT draw, 0.5 * sum(d) AS tv FROM d GROUP BY draw) SELECT round(avg(tv), 9) AS chance_floor, count(*)::BIGINT AS draws FROM e""")
def a36_chance(spark, sf):
    """The same distance between two random samples of the treated group's size (or half of all, if that is less), 200 times."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("v"), "c_mktsegment")
    k = c.agg(F.least(F.count_if(F.col("c_mktsegment") == "BUILDING"), F.floor(F.count(F.lit(1)) / 2)).alias("k"))
    grid = spread(c.select("c_custkey", "v"), "c_custkey").crossJoin(F.broadcast(spark.range(200).withColumnRenamed("id", "draw")))
    s = ranking.first_and_next(grid, digest(SEED, F.col("draw"), F.col("c_custkey")), ["c_custkey"], ["draw"], "v", k)
    s = s.select("draw", "v", F.col("first").alias("a"), F.col("next").alias("b"))
    w = Window.partitionBy("draw")
    d = s.withColumn("d", F.abs(F.col("a") / F.sum("a").over(w) - F.col("b") / F.sum("b").over(w))).groupBy("draw").agg((0.5 * F.sum("d")).alias("tv"))
    return d.agg(r9(F.avg("tv")).alias("chance_floor"), F.count(F.lit(1)).alias("draws"))


@query("a6_split_report", f"""WITH {SQL_RECORDS}, m AS (SELECT record_id, strong, row_number() OVER (ORDER BY {HASH}, record_id) <= 150 AS probe FROM records),
r AS (SELECT record_id, strong, probe, t FROM m, (VALUES ('v1'), ('v2')) x(t)) SELECT probe, strong, count(*)::BIGINT AS pairs, count(DISTINCT record_id)::BIGINT AS records FROM r GROUP BY ALL""")
def a6(spark, sf):
    r = ranking.hash_rank(recs(spark, sf).select("record_id", "strong"), digest(SEED, F.col("record_id")), ["record_id"], [], "rk")
    r = r.select("record_id", "strong", (F.col("rk") <= 150).alias("probe"), F.explode(F.array(F.lit("v1"), F.lit("v2"))).alias("t"))
    out = S.split_report(r, "record_id", "strong", "probe")
    return out


@query("j6_pairing_capacity", f"""WITH {SQL_RECORDS}, {SQL_POOLS}, {SQL_DRAWN} SELECT pairing, count(*)::BIGINT AS capacity, count(DISTINCT prompt)::BIGINT AS groups FROM record_pairs GROUP BY pairing""")
def j6_capacity(spark, sf):
    return record_pairs(spark, sf).groupBy("pairing").agg(F.count(F.lit(1)).alias("capacity"), F.count_distinct("prompt").alias("groups"))
