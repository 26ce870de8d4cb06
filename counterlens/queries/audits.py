"""Two-record, placement, guardrail, planning, erasure-summary and contract queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from counterlens.functions import vectors as X
from counterlens.functions.keyed import hash15
from counterlens.operators import comparative as C, contracts as Q, guardrail as G
from counterlens.operators.ranking import exact_percentiles
from counterlens.queries.base import (SQL_RECORDS, SQL_REWARDS, literal_rows, r9, records, rewards, sql_draws, sql_h15, sql_index, table)
from counterlens.queries.pairs import SQL_PAIRS, pair_rewards
from counterlens.queries.registry import query
from counterlens.queries.splits import SQL_DRAWN, SQL_POOLS, record_pairs

# ---- two-record rewards -------------------------------------------------------------------------------------------------
GRID = [(a, k, t, p, o, c) for a in ("sex", "age") for k in ("merit", "coded") for t in ("v1", "v2") for p in ("X", "Y") for o in ("XY", "YX") for c in ("X", "Y")]
GRID += [("unmarked", k, t, None, o, c) for k in ("merit", "coded") for t in ("v1", "v2") for o in ("XY", "YX") for c in ("X", "Y")]
SQL_GRID = "tg AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{k}', '{t}', {'NULL' if p is None else chr(39) + p + chr(39)}, '{o}', '{c}')" for a, k, t, p, o, c in GRID) + ") t(axis, kind, template, protected, ord, chosen))"
TKEY = "pair_id || '|' || axis || '|' || kind || '|' || template || '|' || coalesce(protected, '-') || '|' || ord || '|' || chosen"
SQL_TWO = f"""{SQL_RECORDS}, {SQL_POOLS}, {SQL_DRAWN}, {SQL_GRID},
tw AS (SELECT pairing, pairing || ':' || x || '|' || y AS pair_id, axis, kind, template, protected, ord, chosen FROM record_pairs, tg),
tr AS (SELECT *, ({sql_h15(TKEY)} % 50 + CASE WHEN pairing = 'strong_weak' AND chosen = 'X' THEN 12 ELSE 0 END - CASE WHEN axis = 'sex' AND protected = chosen THEN 5 ELSE 0 END) / 100 AS reward FROM tw),
pm AS (SELECT pairing, pair_id, axis, kind, template, protected, ord, max(reward) FILTER (chosen = 'X') AS rx, max(reward) FILTER (chosen = 'Y') AS ry FROM tr GROUP BY ALL)"""


def _w(x, y):
    return f"CASE WHEN {x} > {y} THEN 1.0::DOUBLE WHEN {x} = {y} THEN 0.5::DOUBLE WHEN {x} < {y} THEN 0.0::DOUBLE END"


OWN, OTHER = "CASE protected WHEN 'X' THEN rx WHEN 'Y' THEN ry END", "CASE protected WHEN 'X' THEN ry WHEN 'Y' THEN rx END"
SQL_PV = f"""pv AS (SELECT pairing, pair_id, axis, kind, avg({OWN} - {OTHER}) AS marker_effect, avg({_w(OWN, OTHER)}) AS pref_protected_rate,
  avg(CASE WHEN ord = 'XY' THEN rx - ry ELSE ry - rx END) AS position_effect, avg({_w('rx', 'ry')}) FILTER (protected = 'X') AS accuracy_strong_protected,
  avg({_w('rx', 'ry')}) FILTER (protected = 'Y') AS accuracy_weak_protected, avg(rx - ry) FILTER (protected IS NULL) AS choice_margin, avg({_w('rx', 'ry')}) FILTER (protected IS NULL) AS accuracy FROM pm GROUP BY ALL)"""


def two_record_rewards(spark, sf):
    grid = literal_rows(spark, GRID, "axis string, kind string, template string, protected string, `order` string, chosen string")
    p = record_pairs(spark, sf).select("pairing", F.concat(F.col("pairing"), F.lit(":"), F.col("x"), F.lit("|"), F.col("y")).alias("pair_id"))
    j = p.crossJoin(F.broadcast(grid))
    noise = F.pmod(hash15(F.col("pair_id"), F.col("axis"), F.col("kind"), F.col("template"), F.coalesce("protected", F.lit("-")), F.col("order"), F.col("chosen")), F.lit(50))
    hundredths = noise + F.when((F.col("pairing") == "strong_weak") & (F.col("chosen") == "X"), 12).otherwise(0) - F.when((F.col("axis") == "sex") & (F.col("protected") == F.col("chosen")), 5).otherwise(0)
    return j.withColumn("reward", hundredths / F.lit(100.0)).withColumn("encoding", F.lit("explicit"))


def _values(spark, sf):
    return C.pair_values(two_record_rewards(spark, sf), ["pairing", "pair_id"])


def _round(df, cols):
    return df.select(*[r9(f"`{c}`").alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


@query("a23_two_record_values", f"WITH {SQL_TWO}, {SQL_PV} SELECT pair_id, axis, kind, round(marker_effect, 9) AS marker_effect, round(pref_protected_rate, 9) AS pref_protected_rate, round(position_effect, 9) AS position_effect FROM pv")
def a23(spark, sf):
    return _round(_values(spark, sf).select("pair_id", "axis", "kind", *C.MARKED), C.MARKED)


@query("a23_pooled_summaries", f"""WITH {SQL_TWO}, {SQL_PV}, al AS (SELECT * FROM pv UNION ALL SELECT * REPLACE ('all' AS pairing) FROM pv)
SELECT pairing, axis, kind, count(*)::BIGINT AS n, round(avg(marker_effect), 9) AS mean, round(stddev_samp(marker_effect), 9) AS sd, round(avg(pref_protected_rate), 9) AS pref, round(avg(position_effect), 9) AS position_effect FROM al GROUP BY ALL""")
def a23_pooled(spark, sf):
    return C.with_pooled(_values(spark, sf)).groupBy("pairing", "axis", "kind").agg(
        F.count(F.lit(1)).alias("n"), r9(F.avg("marker_effect")).alias("mean"), r9(F.stddev_samp("marker_effect")).alias("sd"), r9(F.avg("pref_protected_rate")).alias("pref"),
        r9(F.avg("position_effect")).alias("position_effect"))


SQL_MERIT = """mv AS (SELECT m.pair_id, m.axis, m.kind, m.marker_effect, u.choice_margin AS quality_margin, u.accuracy - m.accuracy_strong_protected AS overturn, m.accuracy_weak_protected - u.accuracy AS rescue,
  m.accuracy_weak_protected - m.accuracy_strong_protected AS accuracy_contrast FROM pv m JOIN pv u ON m.pair_id = u.pair_id AND m.kind = u.kind AND u.axis = 'unmarked' AND m.axis <> 'unmarked' WHERE m.pairing = 'strong_weak')"""


def _merit(spark, sf):
    return C.merit_values(_values(spark, sf).filter("pairing = 'strong_weak'"), ["pairing", "pair_id"])


@query("a24_strong_weak_merit", f"""WITH {SQL_TWO}, {SQL_PV}, {SQL_MERIT} SELECT axis, kind, count(*)::BIGINT AS n, round(avg(quality_margin), 9) AS quality_margin, round(avg(overturn), 9) AS overturn, round(avg(rescue), 9) AS rescue,
  round(avg(accuracy_contrast), 9) AS accuracy_contrast FROM mv GROUP BY ALL""")
def a24(spark, sf):
    return _merit(spark, sf).groupBy("axis", "kind").agg(F.count(F.lit(1)).alias("n"), *[r9(F.avg(c)).alias(c) for c in ("quality_margin", "overturn", "rescue", "accuracy_contrast")])


@query("a24_coded_minus_merit", f"""WITH {SQL_TWO}, {SQL_PV}, c AS (SELECT pairing, pair_id, axis, max(marker_effect) FILTER (kind = 'coded') - max(marker_effect) FILTER (kind = 'merit') AS d FROM pv WHERE axis <> 'unmarked' GROUP BY ALL)
SELECT pairing, axis, round(avg(d), 9) AS coded_minus_merit, count(*)::BIGINT AS n FROM c GROUP BY ALL""")
def a24_coded(spark, sf):
    return C.coded_minus_merit(_values(spark, sf), ["pairing", "pair_id"]).groupBy("pairing", "axis").agg(r9(F.avg("coded_minus_merit")).alias("coded_minus_merit"), F.count(F.lit(1)).alias("n"))


@query("a25_b6_exchange_rate", f"""WITH {SQL_TWO}, {SQL_PV}, {SQL_MERIT}, ix AS (SELECT *, {sql_index('mv', 'pair_id', ['axis', 'kind'])} AS idx FROM mv), sz AS (SELECT axis, kind, count(*) AS n FROM ix GROUP BY ALL),
{sql_draws('dr', 'sz', ['axis', 'kind'], 2000, 0)}, bt AS (SELECT axis, kind, b, sum(marker_effect) AS x, sum(quality_margin) AS y FROM dr JOIN ix USING (axis, kind, idx) GROUP BY ALL),
ci AS (SELECT axis, kind, quantile_cont(CASE WHEN round(y, 9) > 0 THEN x / y END, 0.025) AS lo, quantile_cont(CASE WHEN round(y, 9) > 0 THEN x / y END, 0.975) AS hi, bool_and(round(y, 9) > 0) AS bounded, count(*) FILTER (round(y, 9) > 0) AS n_boot_valid FROM bt GROUP BY ALL),
pt AS (SELECT axis, kind, count(*)::BIGINT AS n, avg(marker_effect) AS x, avg(quality_margin) AS y FROM mv GROUP BY ALL)
SELECT axis, kind, n, round(CASE WHEN round(y, 9) > 0 THEN x / y END, 9) AS exchange_rate, round(CASE WHEN bounded AND round(y, 9) > 0 THEN lo END, 9) AS ci_low, round(CASE WHEN bounded AND round(y, 9) > 0 THEN hi END, 9) AS ci_high, n_boot_valid FROM pt JOIN ci USING (axis, kind)""")
def a25(spark, sf):
    return _round(C.exchange_rates(_merit(spark, sf), ["axis", "kind"], "pair_id", 2000, 0), ["exchange_rate", "ci_low", "ci_high"])


# ---- placement cells -----------------------------------------------------------------------------------------------------
@query("a26_a27_b8_placement_cells", f"""WITH {SQL_PAIRS}, it AS (SELECT encoding, axis, 'own' AS dir, record_id, a - b AS base, a2 - b2 AS nul FROM pr UNION ALL SELECT encoding, axis, 'other', record_id, a - b, ((a - b) + (a2 - b2)) / 2 FROM pr),
s AS (SELECT encoding, axis, dir, record_id, sum(base) AS b0, sum(nul) AS v0, count(*)::DOUBLE AS n0 FROM it GROUP BY ALL),
j2 AS (SELECT encoding, axis, dir, record_id, idx, n0, b0, v0, c0, g0 FROM (SELECT s.encoding, s.axis, s.dir, s.record_id, s.n0, s.b0, s.v0, s.v0 - s.b0 AS c0, (o.v0 - o.b0) - (s.v0 - s.b0) AS g0,
   {sql_index('s', 's.record_id', ['s.encoding', 's.axis', 's.dir'])} AS idx FROM s JOIN s o ON o.encoding = s.encoding AND o.axis = s.axis AND o.record_id = s.record_id AND o.dir = 'own')),
sz AS (SELECT encoding, axis, dir, count(*) AS n FROM j2 GROUP BY ALL), {sql_draws('dr', 'sz', ['encoding', 'axis', 'dir'], 2000, 0)},
bt AS (SELECT encoding, axis, dir, b, sum(b0) / sum(n0) AS baseline, sum(v0) / sum(n0) AS nulled, sum(c0) / sum(n0) AS change, sum(g0) / sum(n0) AS gap FROM dr JOIN j2 USING (encoding, axis, dir, idx) GROUP BY ALL),
bl AS (UNPIVOT bt ON baseline, nulled, change, gap INTO NAME stat VALUE x), ci AS (SELECT encoding, axis, dir, stat, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi FROM bl GROUP BY ALL),
pt AS (SELECT encoding, axis, dir, count(*)::BIGINT AS n_units, sum(b0) / sum(n0) AS baseline, sum(v0) / sum(n0) AS nulled, sum(c0) / sum(n0) AS change, sum(g0) / sum(n0) AS gap FROM j2 GROUP BY ALL),
pl AS (UNPIVOT pt ON baseline, nulled, change, gap INTO NAME stat VALUE mean), a AS (SELECT encoding, axis, dir AS "row", stat, n_units, mean, lo, hi FROM pl JOIN ci USING (encoding, axis, dir, stat)),
sg AS (SELECT encoding, axis, "row", sign(mean) AS sg FROM a WHERE stat = 'baseline'),
fin AS (SELECT * FROM a UNION ALL SELECT encoding, axis, "row", 'shortfall', n_units, CASE WHEN sg <> 0 THEN -sg * mean END, CASE WHEN sg < 0 THEN lo WHEN sg > 0 THEN -hi END, CASE WHEN sg < 0 THEN hi WHEN sg > 0 THEN -lo END FROM a JOIN sg USING (encoding, axis, "row") WHERE stat = 'gap')
SELECT encoding, axis, "row", stat, n_units, round(mean, 9) + 0.0 AS mean, round(lo, 9) + 0.0 AS ci_low, round(hi, 9) + 0.0 AS ci_high FROM fin""")
def a27(spark, sf):
    p = pair_rewards(spark, sf)
    base, nul = F.col("a") - F.col("b"), F.col("a2") - F.col("b2")
    rows = F.explode(F.array(F.struct(F.lit("own").alias("row"), nul.alias("nulled")), F.struct(F.lit("other").alias("row"), ((base + nul) / 2).alias("nulled"))))
    items = p.select("encoding", "axis", "record_id", base.alias("baseline"), rows.alias("x")).select("encoding", "axis", "record_id", "baseline", "x.*")
    out = C.placement_cells(items, ["encoding", "axis"], "record_id", "own", 2000, 0)
    return out.select("encoding", "axis", "row", "stat", "n_units", *[(r9(c) + 0.0).alias(c) for c in ("mean", "ci_low", "ci_high")])


# ---- guardrail --------------------------------------------------------------------------------------------------------------
SQL_ITEMS = """li AS (SELECT l_orderkey, o_orderpriority AS subset, l_linenumber, floor(l_extendedprice / 2000) AS s0, floor(l_extendedprice * (1 - l_discount) / 2000) AS s1,
  min(l_linenumber) OVER (PARTITION BY l_orderkey) AS first FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
b0 AS (SELECT subset, l_orderkey, CASE WHEN max(s0) FILTER (l_linenumber = first) = max(s0) THEN 1 / count(*) FILTER (s0 = m0) ELSE 0 END AS base,
  CASE WHEN max(s1) FILTER (l_linenumber = first) = max(s1) THEN 1 / count(*) FILTER (s1 = m1) ELSE 0 END AS edit
  FROM (SELECT *, max(s0) OVER (PARTITION BY l_orderkey) AS m0, max(s1) OVER (PARTITION BY l_orderkey) AS m1 FROM li) GROUP BY subset, l_orderkey)"""


def _completions(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("subset"))
    first = li.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first"))
    j = li.join(first, "l_orderkey").join(o, "l_orderkey")
    return j.select("l_orderkey", "subset", (F.col("l_linenumber") == F.col("first")).alias("correct"),
                    F.floor(F.col("l_extendedprice") / 2000).cast("double").alias("s0"), F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) / 2000).cast("double").alias("s1"))


@query("a31_best_of_n", f"WITH {SQL_ITEMS} SELECT l_orderkey, subset, round(base, 9) AS value FROM b0")
def a31(spark, sf):
    return G.best_of_n(_completions(spark, sf), ["l_orderkey", "subset"], "s0", "correct").withColumn("value", r9("value"))


@query("a33_subset_scores", f"WITH {SQL_ITEMS}, s AS (SELECT subset, avg(base) AS score, count(*)::BIGINT AS items FROM b0 GROUP BY 1) SELECT subset, round(score, 9) AS score, items FROM s UNION ALL SELECT 'overall', round(avg(score), 9), sum(items)::BIGINT FROM s")
def a33(spark, sf):
    return G.subset_scores(G.best_of_n(_completions(spark, sf), ["l_orderkey", "subset"], "s0", "correct"), "subset").withColumn("score", r9("score"))


@query("a34_b7_paired_edit_change", f"""WITH {SQL_ITEMS}, ix AS (SELECT subset, l_orderkey, edit - base AS d, edit, {sql_index('b0', 'l_orderkey', ['subset'])} AS idx FROM b0), sz AS (SELECT subset, count(*) AS n FROM ix GROUP BY 1),
{sql_draws('dr', 'sz', ['subset'], 2000, 0)}, bt AS (SELECT subset, b, avg(d) AS x FROM dr JOIN ix USING (subset, idx) GROUP BY ALL), ba AS (SELECT * FROM bt UNION ALL SELECT 'overall', b, avg(x) FROM bt GROUP BY b),
ci AS (SELECT subset, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi, quantile_cont(x, 0.05) AS lb FROM ba GROUP BY 1),
p0 AS (SELECT subset, avg(edit) AS score, avg(d) AS change FROM ix GROUP BY 1), pt AS (SELECT * FROM p0 UNION ALL SELECT 'overall', avg(score), avg(change) FROM p0)
SELECT subset, round(score, 9) AS score, round(change, 9) AS change, round(lo, 9) AS ci_low, round(hi, 9) AS ci_high, round(lb, 9) AS lower_bound, lb > -0.02 AS non_inferior FROM pt JOIN ci USING (subset)""")
def a34(spark, sf):
    c, by = _completions(spark, sf), ["l_orderkey", "subset"]
    v = G.best_of_n(c, by, "s0", "correct").withColumnRenamed("value", "base").join(G.best_of_n(c, by, "s1", "correct").withColumnRenamed("value", "edit"), by)
    out = G.edit_changes(v, "subset", "l_orderkey", 2000, 0)
    return out.select("subset", *[r9(x).alias(x) for x in ("score", "change", "ci_low", "ci_high", "lower_bound")], G.non_inferior(out, 0.02).alias("non_inferior"))


SQL_TIES = """t0 AS (SELECT l_orderkey // 2 AS question, CASE WHEN l_orderkey % 2 = 0 THEN 'tied' ELSE 'ref' END AS kind, floor(l_extendedprice / 2000) AS s, l_linenumber <= 3 AS ok FROM lineitem),
ts AS (SELECT question, kind, (min(s) FILTER (ok) - max(s) FILTER (NOT ok)) AS gap, CASE WHEN count(*) FILTER (ok) > 1 THEN max(s) FILTER (ok) - min(s) FILTER (ok) END AS spread FROM t0 GROUP BY ALL),
tq AS (SELECT question, max((gap > 0)::INT) FILTER (kind = 'tied') AS ta, max((gap > 0)::INT) FILTER (kind = 'ref') AS ra, max(gap) FILTER (kind = 'tied') AS tg, max(gap) FILTER (kind = 'ref') AS rg, max(spread) FILTER (kind = 'tied') AS sp FROM ts GROUP BY 1),
qv AS (SELECT question, 0.3::DOUBLE * ta + 0.3::DOUBLE * ra + 0.2::DOUBLE * coalesce(tg > sp, false)::INT + 0.2::DOUBLE * coalesce(least(tg, rg) > sp, false)::INT
  + 0.01::DOUBLE * CASE WHEN sp IS NULL THEN 0 WHEN sp = 0 THEN sign(least(tg, rg)) ELSE tanh(least(tg, rg) / sp - 1) END AS value FROM tq WHERE tg IS NOT NULL AND rg IS NOT NULL)"""


@query("a32_j17_ties_score", f"WITH {SQL_TIES} SELECT round(avg(value), 9) AS ties_score, count(*)::BIGINT AS questions FROM qv")
def a32(spark, sf):
    t = table(spark, sf, "lineitem").select(F.expr("l_orderkey div 2").alias("question"), F.when(F.col("l_orderkey") % 2 == 0, "tied").otherwise("ref").alias("kind"),
                                            F.floor(F.col("l_extendedprice") / 2000).cast("double").alias("s"), (F.col("l_linenumber") <= 3).alias("ok"))
    q = G.question_values(G.tie_stats(t, ["question", "kind"], "s", "ok"), "question", "kind")
    return q.agg(r9(F.avg("value")).alias("ties_score"), F.count(F.lit(1)).alias("questions"))


@query("a35_j15_agreement", """WITH o AS (SELECT o_orderkey, o_totalprice AS ours FROM orders), t AS (SELECT l_orderkey AS o_orderkey, sum(l_extendedprice) AS theirs FROM lineitem GROUP BY 1)
SELECT round(corr(ours, theirs), 9) AS r, count(theirs)::BIGINT AS matched, count(*) FILTER (theirs IS NULL)::BIGINT AS unmatched FROM o LEFT JOIN t USING (o_orderkey)""")
def a35(spark, sf):
    t = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("theirs"))
    j = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("ours")).join(t, "o_orderkey", "left")
    return j.agg(r9(F.corr(F.when(F.col("theirs").isNotNull(), F.col("ours")), "theirs")).alias("r"), F.count("theirs").alias("matched"), F.count_if(F.col("theirs").isNull()).alias("unmatched"))


@query("a34_fixed_sequence", """WITH d AS (SELECT o_orderpriority AS model, CASE o_orderstatus WHEN 'F' THEN 0.25::DOUBLE WHEN 'O' THEN 0.5 ELSE 1.0 END AS alpha, avg(o_totalprice) > 250000 AS ok FROM orders GROUP BY ALL),
w AS (SELECT model, alpha, min(ok::INT) OVER (PARTITION BY model ORDER BY alpha ROWS UNBOUNDED PRECEDING) AS ok FROM d) SELECT model, max(alpha) FILTER (ok = 1) AS claimed FROM w GROUP BY model""")
def a34_sequence(spark, sf):
    alpha = F.when(F.col("o_orderstatus") == "F", 0.25).when(F.col("o_orderstatus") == "O", 0.5).otherwise(1.0)
    d = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model"), alpha.alias("alpha")).agg((F.avg("o_totalprice") > 250000).alias("ok"))
    return G.fixed_sequence(d, ["model"], "alpha", "ok")


# ---- planning ------------------------------------------------------------------------------------------------------------------
Z = 1.959963984540054 + 0.8416212335729143
SQL_CON = """con AS (SELECT n_regionkey AS model, 'nation-' || n_nationkey AS contrast, stddev_samp(s_acctbal) AS sd, CASE WHEN n_nationkey % 9 = 0 THEN 0 ELSE avg(abs(s_acctbal)) / 10 END AS scale_sd, count(*) AS available FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey)"""


@query("a39_r22_sample_sizes", f"""WITH {SQL_CON}, r AS (SELECT *, sd / CASE WHEN scale_sd > 0 THEN scale_sd END AS r FROM con),
p AS (SELECT model, arg_max(contrast, r) AS binding, max(r) AS r, count(*) FILTER (r IS NULL)::BIGINT AS unsized, max(available)::BIGINT AS available FROM r GROUP BY model),
g AS (SELECT *, ceil(pow({Z!r}::DOUBLE * r / delta, 2) - 1e-9::DOUBLE)::BIGINT AS n FROM p, (VALUES (0.2::DOUBLE), (0.5::DOUBLE)) d(delta)) SELECT model, delta, binding, round(r, 9) AS r, unsized, n, n > available AS exceeds_available FROM g""")
def a39(spark, sf):
    s = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    con = s.groupBy("n_regionkey", "n_nationkey").agg(F.stddev_samp("s_acctbal").alias("sd"), F.avg(F.abs("s_acctbal")).alias("m"), F.count(F.lit(1)).alias("available"))
    con = con.select(F.col("n_regionkey").alias("model"), F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("contrast"), "sd",
                     F.when(F.col("n_nationkey") % 9 == 0, 0.0).otherwise(F.col("m") / 10).alias("scale_sd"), "available")
    out = G.size_contrasts(con, ["model"], [0.2, 0.5])
    return out.select("model", "delta", "binding", r9("r").alias("r"), "unsized", "n", "exceeds_available")


@query("a39_max_over_models", """WITH n AS (SELECT o_orderstatus AS d, o_orderpriority AS model, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL ELSE count(*) END AS n FROM orders GROUP BY o_orderstatus, o_orderpriority)
SELECT d, CASE WHEN count(n) = count(*) THEN max(n) END::BIGINT AS n FROM n GROUP BY d""")
def a39_max(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("d"), F.col("o_orderpriority").alias("model")).agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("n", F.when(~((F.col("d") == "P") & (F.col("model") == "5-LOW")), F.col("n")))
    return G.max_or_null(n, ["d"], "n")


@query("a38_r18_probe_size_rule", f"""WITH {SQL_PAIRS}, rk AS (SELECT record_id, row_number() OVER (ORDER BY sha256('42|' || record_id), record_id) AS k FROM records), m AS (SELECT encoding, record_id, avg(a - b) AS g FROM pr GROUP BY ALL),
g AS (SELECT encoding, n, avg(m.g) AS gap FROM m JOIN rk USING (record_id), (SELECT ceil(count(*) * share)::INTEGER AS n FROM records, (VALUES (0.0625), (0.125), (0.25), (0.5), (1.0)) sh(share) GROUP BY share) t WHERE k <= n GROUP BY ALL),
f AS (SELECT encoding, gap AS full_gap FROM g WHERE n = (SELECT max(n) FROM g)), p AS (SELECT encoding, n, gap, abs(gap - full_gap) <= 0.01::DOUBLE AS ok FROM g JOIN f USING (encoding)),
s AS (SELECT *, min(ok::INT) OVER (PARTITION BY encoding ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS pass FROM p) SELECT encoding, min(n) FILTER (pass = 1)::INTEGER AS smallest FROM s GROUP BY encoding""")
def a38(spark, sf):
    """Gap on the first N records for N from a sixteenth to all of them; the smallest N from which every larger one stays
    near the largest."""
    from counterlens.functions.keyed import digest
    from counterlens.operators.ranking import hash_rank
    m = pair_rewards(spark, sf).groupBy("encoding", "record_id").agg(F.avg(F.col("a") - F.col("b")).alias("g"))
    r = hash_rank(records(spark, sf, text=False).select("record_id"), digest(42, F.col("record_id")), ["record_id"], [], "k")
    shares = F.array(*[F.ceil(F.count(F.lit(1)) * x).cast("int") for x in (0.0625, 0.125, 0.25, 0.5, 1.0)])
    sizes = records(spark, sf, text=False).agg(F.explode(F.array_distinct(shares)).alias("n"))
    grid = m.join(r, "record_id").crossJoin(F.broadcast(sizes)).filter("k <= n")             # five sizes
    g = grid.groupBy("encoding", "n").agg(F.avg("g").alias("gap"))
    full = g.groupBy("encoding").agg(F.max_by("gap", "n").alias("full_gap"))
    p = g.join(full, "encoding").withColumn("ok", F.abs(F.col("gap") - F.col("full_gap")) <= 0.01)
    return G.smallest_passing(p, ["encoding"], "n", "ok")


# ---- erasure summaries ------------------------------------------------------------------------------------------------------
SQL_REC = """it AS (SELECT vec_id, label % 3 AS fit, (label < 5) AS y, (embedding[1] > 0) = (label < 5) AS lin, (embedding[2] > 0) = (label < 5) AS mlp FROM embeddings)"""


def recoverability_items(spark, sf):
    y = F.col("label") < 5
    return table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 3).alias("fit"), y.alias("y"), ((F.col("embedding")[0] > 0) == y).alias("lin"), ((F.col("embedding")[1] > 0) == y).alias("mlp"))


@query("a44_recoverability", f"""WITH {SQL_REC}, f AS (SELECT fit, greatest(count(*) FILTER (y), count(*) FILTER (NOT y)) AS top, count(*) AS n, count(*) FILTER (lin) AS l, count(*) FILTER (mlp) AS m FROM it GROUP BY fit)
SELECT round(sum(l) / sum(n), 9) AS linear_acc, round(sum(m) / sum(n), 9) AS mlp_acc, round(sum(top) / sum(n), 9) AS chance, round(sum(l) / sum(n) - sum(top) / sum(n), 9) AS linear_above_chance, round(sum(m) / sum(n) - sum(top) / sum(n), 9) AS mlp_above_chance FROM f""")
def a44(spark, sf):
    from counterlens.operators.erasure import recoverability
    return _round(recoverability(recoverability_items(spark, sf), [], "fit", "y", "lin", "mlp"), ["linear_acc", "mlp_acc", "chance", "linear_above_chance", "mlp_above_chance"])


@query("a45_verdicts", """WITH c AS (SELECT o_orderpriority AS concept, o_orderstatus AS method, (avg(o_totalprice) - 250000) / 10000 AS low FROM orders GROUP BY ALL)
SELECT concept, CASE WHEN NOT max(low) FILTER (method = 'F') > 0 THEN 'not decodable without erasure: says nothing' WHEN max(low) FILTER (method = 'O') > 0 THEN 'non-linearly recoverable after erasure (entangled)' ELSE 'not recoverable after erasure (low-complexity)' END AS verdict FROM c GROUP BY concept""")
def a45(spark, sf):
    from counterlens.operators.erasure import verdict
    c = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("concept")).pivot("o_orderstatus", ["F", "O"]).agg(((F.avg("o_totalprice") - 250000) / 10000).alias("low"))
    return c.select("concept", verdict(F.col("F"), F.col("O")).alias("verdict"))


@query("a43_accuracy_by_name", """SELECT label AS name, count(*)::BIGINT AS n, round(avg(((embedding[1] > 0) = (label < 5))::INT), 9) AS accuracy FROM embeddings GROUP BY label""")
def a43(spark, sf):
    ok = (F.col("embedding")[0] > 0) == (F.col("label") < 5)
    return table(spark, sf, "embeddings").groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"), r9(F.avg(ok.cast("double"))).alias("accuracy"))


@query("a46_fit_sizes", f"""WITH {SQL_RECORDS}, u AS (SELECT record_id, t, ({sql_h15("'nf|' || record_id")} % 4)::INT AS f FROM records, (VALUES ('v1'), ('v2'), ('v3')) x(t)),
k AS (SELECT f, t, (SELECT count(*) FROM u u2 WHERE u2.f <> k0.f AND u2.t <> k0.t) AS n FROM (SELECT DISTINCT f, t FROM u) k0) SELECT t, min(n)::BIGINT AS min_fit, max(n)::BIGINT AS max_fit FROM k GROUP BY t""")
def a46(spark, sf):
    """Fit sizes per held-out (fold, template) from counts: all - fold - template + both."""
    u = records(spark, sf, text=False).select("record_id", F.explode(F.array(*[F.lit(t) for t in ("v1", "v2", "v3")])).alias("t"), F.pmod(hash15("nf", F.col("record_id")), F.lit(4)).cast("int").alias("f"))
    sizes = u.groupBy("f", "t").agg(F.count(F.lit(1)).alias("both"))
    total = lambda *keys: F.sum("both").over(Window.partitionBy(*(keys or [F.lit(0)])))  # one row per fold and template
    fit = sizes.select("t", (total() - total("f") - total("t") + F.col("both")).alias("n"))
    return fit.groupBy("t").agg(F.min("n").alias("min_fit"), F.max("n").alias("max_fit"))


@query("v20_erased_concept", """WITH e AS (SELECT label < 5 AS y, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
m AS (SELECT pos, avg(x) FILTER (y) - avg(x) FILTER (NOT y) AS d FROM e GROUP BY pos) SELECT round(sqrt(sum(d * d)), 9) AS before, 0.0::DOUBLE AS after FROM m""")
def v20(spark, sf):
    """Affine erasure of label < 5: class means before and after, per component."""
    from counterlens.operators.erasure import apply_affine, fit_eraser
    e = table(spark, sf, "embeddings").withColumn("z", F.array((F.col("label") < 5).cast("double")))
    eraser = fit_eraser(e, "embedding", "z")
    done = apply_affine(e, "embedding", eraser, "erased")
    from counterlens.operators.vectors import difference_of_means
    y = done.withColumn("y", F.col("label") < 5)
    before = difference_of_means(y, [], "y", "embedding").select(r9(X.norm("raw")).alias("before"))
    after = difference_of_means(y, [], "y", "erased").select(F.round(X.norm("raw"), 6).alias("after"))
    return before.crossJoin(after)


@query("v21_v24_probe_recoverability", f"""WITH e AS (SELECT label < 5 AS y, {sql_h15("'fold|' || vec_id")} % 4 AS f FROM embeddings),
c AS (SELECT sum(greatest(p, n - p)) / sum(n) AS chance FROM (SELECT f, count(*) FILTER (y) AS p, count(*) AS n FROM e GROUP BY f))
SELECT m AS method, round(chance, 9) AS chance, true AS linear_in_band, true AS mlp_in_band FROM c, (VALUES ('none'), ('affine')) t(m)""")
def v21(spark, sf):
    """Linear and non-linear probes of label < 5, unerased and after affine erasure, every fold of four held out once. The labels
    are independent of the vectors, so both probes stay within 0.1 of chance."""
    from counterlens.operators.erasure import fold_recoverability
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("state"), (F.col("label") < 5).cast("int").alias("y"))
    e = e.withColumn("fold", F.pmod(hash15("fold", F.col("vec_id")), F.lit(4)))
    found = fold_recoverability(e, "state", "y", "fold", 4, ["none", "affine"])
    band = lambda c: F.abs(c) < 0.1
    return found.select("method", r9("chance").alias("chance"), band("linear_above_chance").alias("linear_in_band"), band("mlp_above_chance").alias("mlp_in_band"))


@query("v22_bag_of_words", """WITH w AS (SELECT doc_id, lang, unnest(list_distinct(regexp_extract_all(lower(text), '[A-Za-z'']+'))) AS word FROM documents),
v AS (SELECT word FROM w WHERE lang = 'en' GROUP BY word HAVING count(*) >= 5), k AS (SELECT doc_id, count(*) AS n FROM w JOIN v USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS known_words FROM documents LEFT JOIN k USING (doc_id)""")
def v22(spark, sf):
    """Binary bag of words with the training side's vocabulary, per document its distinct known words."""
    from counterlens.operators.erasure import bag_of_words
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    bags = bag_of_words(d.filter("lang = 'en'"), d, "doc_id", "text", min_texts=5)
    return bags.groupBy("doc_id").agg(F.count("word").alias("known_words"))


# ---- contracts -----------------------------------------------------------------------------------------------------------------
@query("q1_cube_completeness", f"""WITH {SQL_REWARDS}, k AS (SELECT * FROM rewards WHERE NOT (({sql_h15("record_id || '|' || cell || '|' || response")}) % 500 = 0)),
b AS (SELECT record_id, template, encoding, count(*) AS "rows", count(DISTINCT cell || response) AS entries FROM k GROUP BY ALL) SELECT record_id, template, encoding, "rows", entries FROM b WHERE "rows" <> 45 OR entries <> 45""")
def q1(spark, sf):
    r = rewards(spark, sf).filter(F.pmod(hash15(F.col("record_id"), F.col("cell"), F.col("response")), F.lit(500)) != 0)
    return Q.cube_holes(r, 9, 5)


@query("q2_two_record_completeness", f"""WITH {SQL_TWO}, k AS (SELECT * FROM tr WHERE NOT ({sql_h15("'drop|' || " + TKEY)} % 300 = 0)),
hb AS (SELECT pair_id, template, axis, kind, count(*) AS "rows", count(DISTINCT coalesce(protected, '-') || ord || chosen) AS entries FROM k GROUP BY ALL)
SELECT pair_id, template, axis, kind, "rows", entries FROM hb WHERE "rows" <> CASE WHEN axis = 'unmarked' THEN 4 ELSE 8 END OR entries <> CASE WHEN axis = 'unmarked' THEN 4 ELSE 8 END""")
def q2(spark, sf):
    key = [F.col(c) for c in ("pair_id", "axis", "kind", "template")] + [F.coalesce("protected", F.lit("-")), F.col("order"), F.col("chosen")]
    r = two_record_rewards(spark, sf).filter(F.pmod(hash15("drop", *key), F.lit(300)) != 0)
    return Q.two_record_holes(r).drop("encoding")


@query("q4_swapped_rows", f"""WITH {SQL_TWO}, k AS (SELECT * FROM tr WHERE axis <> 'unmarked' AND NOT ({sql_h15("'drop|' || " + TKEY)} % 300 = 0)),
hb AS (SELECT pair_id, template, ord, kind, chosen, count(*) FILTER (protected = 'X') AS x, count(*) FILTER (protected = 'Y') AS y FROM k WHERE axis = 'sex' GROUP BY ALL) SELECT pair_id, template, ord AS "order", kind, chosen, x, y FROM hb WHERE x <> 1 OR y <> 1""")
def q4(spark, sf):
    key = [F.col(c) for c in ("pair_id", "axis", "kind", "template")] + [F.coalesce("protected", F.lit("-")), F.col("order"), F.col("chosen")]
    r = two_record_rewards(spark, sf).filter((F.col("axis") == "sex") & (F.pmod(hash15("drop", *key), F.lit(300)) != 0))
    return Q.unpaired_swaps(r)


@query("q5_non_finite_scores", """SELECT event_id, event_type FROM events WHERE event_id % 97 = 0""")
def q5(spark, sf):
    e = table(spark, sf, "events").withColumn("score", F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return Q.non_finite(e, "score").select("event_id", "event_type")


@query("q6_question_rows", """WITH q AS (SELECT l_orderkey // 2 AS question, count(DISTINCT l_orderkey % 2) AS kinds FROM lineitem GROUP BY 1) SELECT question, kinds FROM q WHERE kinds <> 2""")
def q6(spark, sf):
    q = table(spark, sf, "lineitem").groupBy(F.expr("l_orderkey div 2").alias("question")).agg(F.count_distinct(F.col("l_orderkey") % 2).alias("kinds"))
    return q.filter("kinds <> 2")


@query("q7_mixed_labels", """SELECT l_linestatus, count(DISTINCT l_returnflag || l_linestatus)::BIGINT AS labels FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag || l_linestatus) > 1""")
def q7(spark, sf):
    p = table(spark, sf, "lineitem").select("l_linestatus", F.col("l_returnflag").alias("label_a"), F.col("l_linestatus").alias("label_b"))
    return Q.mixed_labels(p, ["l_linestatus"])


@query("q9_unknown_levels", """SELECT event_type, count(*)::BIGINT AS "rows" FROM events WHERE event_type NOT IN ('click', 'view', 'signup') GROUP BY 1""")
def q9(spark, sf):
    return Q.unknown_levels(table(spark, sf, "events"), "event_type", ["click", "view", "signup"])


@query("q10_missing_fields", """WITH d AS (SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), f AS (SELECT 'quality' AS field, count(*) FILTER (quality IS NULL)::BIGINT AS missing FROM d UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL)::BIGINT FROM d) SELECT * FROM f WHERE missing > 0""")
def q10(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return Q.missing_fields(d, ["quality", "toxic", "doc_id"])


@query("q11_score_agreement", """WITH j AS (SELECT o_orderkey, o_totalprice AS a, sum(l_extendedprice * (1 - l_discount)) AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) SELECT o_orderkey FROM j WHERE abs(a - b) > 0.02::DOUBLE + 0.02::DOUBLE * abs(b)""")
def q11(spark, sf):
    t = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("b"))
    j = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("a")).join(t, "o_orderkey")
    return Q.score_disagreement(j, F.col("a"), F.col("b")).select("o_orderkey")


@query("u7_duplicate_template_ids", """WITH t AS (SELECT lang || '-' || source AS template, doc_id FROM documents) SELECT template, count(*)::BIGINT AS n FROM t GROUP BY 1 HAVING count(*) > 1""")
def u7(spark, sf):
    t = table(spark, sf, "documents").select(F.concat_ws("-", "lang", "source").alias("template"))
    return t.groupBy("template").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("s14_manifest_cells", "SELECT DISTINCT o_orderpriority AS varied_axis, o_orderstatus AS encoding FROM orders WHERE o_orderstatus IN ('F', 'O')")
def s14(spark, sf):
    from counterlens.sources.corpora import manifest_cells
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("varied_axis"), F.col("o_orderstatus").alias("encoding"))
    return manifest_cells(o, encodings=["F", "O"])


@query("s16_duplicate_inputs", """SELECT source AS model, count(*)::BIGINT AS files, min(doc_id) AS first_file FROM documents GROUP BY 1 HAVING count(*) > 1""")
def s16(spark, sf):
    from counterlens.sources.corpora import duplicate_inputs
    return duplicate_inputs(table(spark, sf, "documents").select(F.col("source").alias("model"), F.col("doc_id").alias("file")), "model")


@query("k9_named_numbers", """WITH m AS (SELECT o_orderpriority AS name, avg(o_totalprice) AS v, quantile_cont(o_totalprice, 0.025) AS lo, quantile_cont(o_totalprice, 0.975) AS hi FROM orders GROUP BY 1)
SELECT name, round(v, 6) AS value, 'orders' AS source FROM m UNION ALL SELECT name || 'Lo', round(lo, 6), 'orders' FROM m UNION ALL SELECT name || 'Hi', round(hi, 6), 'orders' FROM m""")
def k9(spark, sf):
    from counterlens.sources.sinks import named_numbers
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_totalprice").cast("double").alias("x"))
    m = o.groupBy("name").agg(F.avg("x").alias("value")).join(exact_percentiles(o, ["name"], "x", {"lo": 0.025, "hi": 0.975}), "name")
    n = named_numbers(m, "orders")
    return n.select("name", F.round("value", 6).alias("value"), "source")
