"""Decision-table queries: margins, factorial effects, summaries, accuracy, AUC, length tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterlens.operators import decision as D
from counterlens.operators.design import CREDIT
from counterlens.operators.ranking import auc
from counterlens.operators.resampling import intervals, replicate_sums
from counterlens.queries.base import SQL_REWARDS, r9, rewards, sql_draws, sql_index
from counterlens.queries.registry import query

AXES = CREDIT.axes
KEYS = ["record_id", "encoding", "strong"]

# per (record, encoding): D per cell averaged over templates, then every linear effect
SQL_CELL_D = """cell_d AS (
  SELECT record_id, encoding, strong, template, cell, s1, s2, s3, n_words, prompt, grp,
         max(CASE WHEN response = 'approve' THEN reward END) - max(CASE WHEN response = 'decline' THEN reward END) AS D,
         max(CASE WHEN response = 'approve' THEN reward END) - max(CASE WHEN response = 'coded' THEN reward END) AS D_coded,
         max(CASE WHEN response = 'coded' THEN reward END) - max(CASE WHEN response = 'decline' THEN reward END) AS E,
         max(CASE WHEN response = 'approve' THEN reward END) - max(CASE WHEN response = 'overt' THEN reward END) AS D_overt,
         max(CASE WHEN response = 'overt' THEN reward END) - max(CASE WHEN response = 'decline' THEN reward END) AS O,
         max(CASE WHEN response = 'evasive' THEN reward END) - max(CASE WHEN response = 'approve' THEN reward END) AS V
  FROM rewards GROUP BY ALL)"""

MARGIN_NAMES = list(D.MARGINS)

SQL_EFFECT_LIST = {
    "main:sex": "sum(s1 * m) / 4", "main:age": "sum(s2 * m) / 4", "main:marital_status": "sum(s3 * m) / 4",
    "interaction:sex_x_age": "sum(s1 * s2 * m) / 2", "interaction:sex_x_marital_status": "sum(s1 * s3 * m) / 2",
    "interaction:age_x_marital_status": "sum(s2 * s3 * m) / 2", "three_way": "sum(s1 * s2 * s3 * m)",
    "corner": "sum(CASE WHEN s1 + s2 + s3 = 3 THEN m WHEN s1 + s2 + s3 = -3 THEN -m ELSE 0 END)",
    "level_marked": "sum(CASE WHEN s1 <> 0 THEN m ELSE 0 END) / 8",
    "unmarked": "sum(CASE WHEN s1 = 0 THEN m ELSE 0 END)",
}
SQL_EFFECT_LIST["additivity_gap"] = (f"{SQL_EFFECT_LIST['corner']} - ({SQL_EFFECT_LIST['main:sex']} + "
                                     f"{SQL_EFFECT_LIST['main:age']} + {SQL_EFFECT_LIST['main:marital_status']})")


def sql_effects(margin: str = "D") -> str:
    """CTE ``effects``: one row per (record, encoding) with one column per effect of a margin."""
    cols = ", ".join(f'{e} AS "{margin}:{k}"' for k, e in SQL_EFFECT_LIST.items())
    return f"""rec_cell AS (SELECT record_id, encoding, strong, cell, s1, s2, s3, avg({margin}) AS m
  FROM cell_d GROUP BY ALL),
effects AS (SELECT record_id, encoding, strong, {cols} FROM rec_cell GROUP BY record_id, encoding, strong)"""


# ---- A13 / A14 -------------------------------------------------------------------------------------------------
@query("a13_margins_per_cell", f"""WITH {SQL_REWARDS}, {SQL_CELL_D}
SELECT encoding, template, cell, strong, count(*)::BIGINT AS n,
  {', '.join(f'round(avg({m}), 9) AS {m}' for m in MARGIN_NAMES)}
FROM cell_d GROUP BY encoding, template, cell, strong""")
def a13(spark, sf):
    m = D.cell_margins(rewards(spark, sf), ["record_id", "template", "encoding", "strong"])
    return m.groupBy("encoding", "template", "cell", "strong").agg(
        F.count(F.lit(1)).alias("n"), *[r9(F.avg(k)).alias(k) for k in MARGIN_NAMES])


@query("a14_template_means", f"""WITH {SQL_REWARDS}
SELECT record_id, encoding, cell, response, round(avg(reward), 9) AS reward, count(*)::BIGINT AS n_templates
FROM rewards GROUP BY ALL""")
def a14(spark, sf):
    return rewards(spark, sf).groupBy("record_id", "encoding", "cell", "response").agg(
        r9(F.avg("reward")).alias("reward"), F.count(F.lit(1)).alias("n_templates"))


# ---- A15 ---------------------------------------------------------------------------------------------------------
@query("a15_factorial_effects", f"""WITH {SQL_REWARDS}, {SQL_CELL_D}, {sql_effects()}
SELECT record_id, encoding, strong, {', '.join(f'round("D:{k}", 9) AS "{k}"' for k in SQL_EFFECT_LIST)} FROM effects""")
def a15(spark, sf):
    wide = D.record_effects(rewards(spark, sf), CREDIT, KEYS, {"D": D.MARGINS["D"]})
    return wide.select(*KEYS, *[r9(f"`D:{k}`").alias(k) for k in SQL_EFFECT_LIST])


# ---- A16 ---------------------------------------------------------------------------------------------------------
SQL_PAIRS = "pairs AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{e}', '{p.axis}', '{p.a.key}', '{p.b.key}', '{p.suffix}')"
    for e in ("explicit", "proxy") for p in CREDIT.all_pairs(e)) + ") t(encoding, axis, cell_a, cell_b, suffix))"


@query("a16_stratum_contrasts", f"""WITH {SQL_REWARDS}, {SQL_CELL_D}, {SQL_PAIRS},
rec_cell AS (SELECT record_id, encoding, strong, cell, avg(D) AS m FROM cell_d GROUP BY ALL)
SELECT a.encoding, a.strong, p.axis, p.suffix, round(avg(a.m - b.m), 9) AS mean_difference
FROM pairs p JOIN rec_cell a ON a.encoding = p.encoding AND a.cell = p.cell_a
JOIN rec_cell b ON b.encoding = p.encoding AND b.cell = p.cell_b AND a.record_id = b.record_id
GROUP BY ALL""")
def a16(spark, sf):
    m = D.cell_margins(rewards(spark, sf), ["record_id", "template", "encoding", "strong"], {"D": D.MARGINS["D"]})
    out = D.stratum_means(m, CREDIT.pairs_frame(spark), ["encoding", "strong"], "D")
    return out.withColumn("mean_difference", r9("mean_difference"))


# ---- A17 with B3: summary with scale and shared-draw intervals ----------------------------------------------------
def _summary_sql(margin: str, replicates: int, seed: int = 0) -> str:
    names = [k for k in SQL_EFFECT_LIST if k != "unmarked"]
    unions = " UNION ALL ".join(
        f"""SELECT record_id, encoding, strong, '{margin}:{k}' AS stat, "{margin}:{k}" AS v, u FROM scaled""" for k in names)
    return f"""WITH {SQL_REWARDS}, {SQL_CELL_D}, {sql_effects(margin)},
du AS (SELECT record_id, encoding, avg(D) AS u FROM cell_d WHERE cell = 'unmarked' GROUP BY ALL),
scaled AS (SELECT e.*, du.u FROM effects e JOIN du USING (record_id, encoding)),
long AS ({unions}),
idx AS (SELECT record_id, encoding, strong, {sql_index('scaled', 'record_id', ['encoding', 'strong'])} AS idx FROM scaled),
sizes AS (SELECT encoding, strong, count(*) AS n FROM idx GROUP BY ALL),
{sql_draws('draws', 'sizes', ['encoding', 'strong'], replicates, seed)},
w AS (SELECT encoding, strong, b, idx, count(*) AS w FROM draws GROUP BY ALL),
boot AS (SELECT l.encoding, l.strong, l.stat, w.b, sum(w.w * l.v) / sum(w.w) AS m,
   sqrt((sum(w.w * l.u * l.u) - sum(w.w * l.u) * sum(w.w * l.u) / sum(w.w)) / (sum(w.w) - 1)) AS sd
   FROM w JOIN idx USING (encoding, strong, idx) JOIN long l USING (encoding, strong, record_id) GROUP BY ALL),
ci AS (SELECT encoding, strong, stat, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high,
   quantile_cont(m / sd, 0.025) AS scaled_ci_low, quantile_cont(m / sd, 0.975) AS scaled_ci_high FROM boot GROUP BY ALL),
pt AS (SELECT encoding, strong, stat, count(*)::BIGINT AS n, avg(v) AS mean, stddev_samp(v) AS sd,
   avg(v) / nullif(stddev_samp(v), 0) AS d_z, avg(CASE WHEN round(v, 9) < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share_negative,
   stddev_samp(u) AS scale_sd, avg(v) / nullif(stddev_samp(u), 0) AS scaled_mean FROM long GROUP BY ALL)
SELECT encoding, strong, stat, n, round(mean, 9) AS mean, round(sd, 9) AS sd, round(d_z, 9) AS d_z,
  round(share_negative, 9) AS share_negative, round(scale_sd, 9) AS scale_sd, round(scaled_mean, 9) AS scaled_mean,
  round(ci_low, 10) AS ci_low, round(ci_high, 10) AS ci_high, round(scaled_ci_low, 10) AS scaled_ci_low,
  round(scaled_ci_high, 10) AS scaled_ci_high FROM pt JOIN ci USING (encoding, strong, stat)"""


SUMMARY_COLUMNS = ["mean", "sd", "d_z", "share_negative", "scale_sd", "scaled_mean", "ci_low", "ci_high",
                   "scaled_ci_low", "scaled_ci_high"]


def _summary(spark, sf, margin: str, replicates: int):
    margins = {margin: D.MARGINS[margin], "D": D.MARGINS["D"]}
    wide = D.record_effects(rewards(spark, sf), CREDIT, KEYS, margins)
    names = [f"{margin}:{k}" for k in SQL_EFFECT_LIST if k != "unmarked"]
    out = D.summaries(wide, ["encoding", "strong"], "record_id", names, "D:unmarked", replicates, 0)
    # Scores are whole thousandths: interpolated bounds can end in a 5 at the tenth decimal, so they are cut after it.
    return out.select("encoding", "strong", "stat", "n", *[F.round(c, 10 if "ci_" in c else 9).alias(c) for c in SUMMARY_COLUMNS])


@query("r6_decision_audit", _summary_sql("D", 2000))
def r6(spark, sf):
    return _summary(spark, sf, "D", 2000)


@query("b3_coded_margin_intervals", _summary_sql("D_coded", 2000))
def b3(spark, sf):
    return _summary(spark, sf, "D_coded", 2000)


@query("a17_summaries_all_margins", f"""WITH {SQL_REWARDS}, {SQL_CELL_D}, long AS (
  {' UNION ALL '.join(f"SELECT record_id, encoding, strong, '{m}' AS margin, s1, cell, {m} AS v FROM cell_d" for m in MARGIN_NAMES)}),
rec AS (SELECT record_id, encoding, strong, margin, avg(v) FILTER (s1 <> 0) AS level_marked,
  avg(v) FILTER (s1 = 0) AS level_unmarked FROM long GROUP BY ALL)
SELECT encoding, strong, margin, count(*)::BIGINT AS n, round(avg(level_marked), 9) AS mean_marked,
  round(stddev_samp(level_marked), 9) AS sd_marked, round(avg(level_marked) / stddev_samp(level_marked), 9) AS d_z_marked,
  round(avg(level_unmarked), 9) AS mean_unmarked, round(stddev_samp(level_unmarked), 9) AS sd_unmarked
FROM rec GROUP BY ALL""")
def a17(spark, sf):
    wide = D.record_effects(rewards(spark, sf), CREDIT, KEYS)
    rows = wide.select("encoding", "strong", F.explode(F.array(*[F.struct(
        F.lit(m).alias("margin"), F.col(f"`{m}:level_marked`").alias("a"), F.col(f"`{m}:unmarked`").alias("b"))
        for m in MARGIN_NAMES])).alias("e")).select("encoding", "strong", "e.*")
    return rows.groupBy("encoding", "strong", "margin").agg(
        F.count(F.lit(1)).alias("n"), r9(F.avg("a")).alias("mean_marked"), r9(F.stddev_samp("a")).alias("sd_marked"),
        r9(F.avg("a") / F.stddev_samp("a")).alias("d_z_marked"), r9(F.avg("b")).alias("mean_unmarked"),
        r9(F.stddev_samp("b")).alias("sd_unmarked"))


# ---- A18 / A19 / B4: accuracy, cross-influence, balanced means -----------------------------------------------------
ACC = ["acc_marked", "acc_unmarked", "generic_marking", "cross_influence:sex", "cross_influence:age",
       "cross_influence:marital_status", "cross_influence:intersection"]

SQL_ACC = f"""ok AS (SELECT *, CASE WHEN D = 0 THEN 0.5::DOUBLE WHEN strong THEN (D > 0)::INT::DOUBLE ELSE (D < 0)::INT::DOUBLE END AS ok FROM cell_d),
acc AS (SELECT record_id, encoding, strong, avg(ok) FILTER (s1 <> 0) AS acc_marked, avg(ok) FILTER (s1 = 0) AS acc_unmarked,
  avg(ok) FILTER (s1 = 0) - avg(ok) FILTER (s1 <> 0) AS generic_marking,
  avg(ok) FILTER (s1 = -1) - avg(ok) FILTER (s1 = 1) AS "cross_influence:sex",
  avg(ok) FILTER (s2 = -1) - avg(ok) FILTER (s2 = 1) AS "cross_influence:age",
  avg(ok) FILTER (s3 = -1) - avg(ok) FILTER (s3 = 1) AS "cross_influence:marital_status",
  avg(ok) FILTER (s1 + s2 + s3 = -3) - avg(ok) FILTER (s1 + s2 + s3 = 3) AS "cross_influence:intersection"
  FROM ok GROUP BY ALL)"""


def _margin(spark, sf):
    return D.cell_margins(rewards(spark, sf), ["record_id", "template", "encoding", "strong"], {"D": D.MARGINS["D"]})


@query("a19_decision_accuracy", f"""WITH {SQL_REWARDS}, {SQL_CELL_D}, {SQL_ACC}
SELECT record_id, encoding, strong, {', '.join(f'round("{k}", 9) AS "{k}"' for k in ACC)} FROM acc""")
def a19(spark, sf):
    acc = D.accuracy_values(_margin(spark, sf), CREDIT, ["record_id", "encoding", "strong"])
    return acc.select("record_id", "encoding", "strong", *[r9(f"`{k}`").alias(k) for k in ACC])


@query("a19_accuracy_by_cell", f"""WITH {SQL_REWARDS}, {SQL_CELL_D}, {SQL_ACC},
per AS (SELECT record_id, encoding, strong, cell, avg(ok) AS ok FROM ok WHERE s1 <> 0 GROUP BY ALL)
SELECT encoding, strong, cell, round(avg(ok), 9) AS accuracy FROM per GROUP BY ALL""")
def a19_by_cell(spark, sf):
    from counterlens.functions.scores import decision_correct
    per = (_margin(spark, sf).filter("s1 <> 0").groupBy("record_id", "encoding", "strong", "cell")
           .agg(F.avg(decision_correct(F.col("D"), F.col("strong"))).alias("ok")))
    return per.groupBy("encoding", "strong", "cell").agg(r9(F.avg("ok")).alias("accuracy"))


def _balanced_sql(replicates: int) -> str:
    longs = " UNION ALL ".join(f"""SELECT record_id, encoding, strong, '{k}' AS stat, "{k}" AS v FROM acc""" for k in ACC)
    return f"""WITH {SQL_REWARDS}, {SQL_CELL_D}, {SQL_ACC}, long AS ({longs}),
idx AS (SELECT record_id, encoding, strong, {sql_index('acc', 'record_id', ['encoding', 'strong'])} AS idx FROM acc),
sz1 AS (SELECT encoding, strong, count(*) AS n FROM idx WHERE strong GROUP BY ALL),
sz2 AS (SELECT encoding, strong, count(*) AS n FROM idx WHERE NOT strong GROUP BY ALL),
{sql_draws('d1', 'sz1', ['encoding', 'strong'], replicates, 0, 1)}, {sql_draws('d2', 'sz2', ['encoding', 'strong'], replicates, 0, 2)},
w AS (SELECT encoding, strong, b, idx, count(*) AS w FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2) GROUP BY ALL),
half AS (SELECT l.encoding, l.stat, w.b, l.strong, sum(w.w * l.v) / sum(w.w) AS m
  FROM w JOIN idx USING (encoding, strong, idx) JOIN long l USING (encoding, strong, record_id) GROUP BY ALL),
boot AS (SELECT encoding, stat, b, avg(m) AS m FROM half GROUP BY ALL),
ci AS (SELECT encoding, stat, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM boot GROUP BY ALL),
pt AS (SELECT encoding, stat, (avg(v) FILTER (strong) + avg(v) FILTER (NOT strong)) / 2 AS mean,
  count(*) FILTER (strong) AS n_strong, count(*) FILTER (NOT strong) AS n_weak FROM long GROUP BY ALL)
SELECT encoding, stat, n_strong, n_weak, round(mean, 9) AS mean, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high
FROM pt JOIN ci USING (encoding, stat)"""


@query("a18_b4_balanced_accuracy", _balanced_sql(2000))
def a18(spark, sf):
    acc = D.accuracy_values(_margin(spark, sf), CREDIT, ["record_id", "encoding", "strong"])
    out = D.balanced_summaries(acc, ["encoding"], "record_id", "strong", ACC, 2000, 0)
    return out.select("encoding", "stat", "n_strong", "n_weak", *[r9(c).alias(c) for c in ("mean", "ci_low", "ci_high")])


# ---- A20 / B5: AUC ---------------------------------------------------------------------------------------------------
def sql_auc(source: str, by: str, score: str, name: str) -> str:
    """CTE ``name(by, auc, n_pos, n_neg)`` from average ranks."""
    return f"""{name} AS (SELECT {by}, (sum(CASE WHEN strong THEN rk ELSE 0 END) - max(n_pos) * (max(n_pos) + 1) / 2) / nullif(max(n_pos) * max(n_neg), 0) AS auc,
    max(n_pos) AS n_pos, max(n_neg) AS n_neg FROM (SELECT {by}, strong,
      rank() OVER (PARTITION BY {by} ORDER BY {score}) + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2 AS rk,
      sum(strong::INT) OVER (PARTITION BY {by})::DOUBLE AS n_pos, sum((NOT strong)::INT) OVER (PARTITION BY {by})::DOUBLE AS n_neg
      FROM {source}) GROUP BY {by})"""


@query("a20_auc_by_cell", f"""WITH {SQL_REWARDS}, {SQL_CELL_D}, {sql_auc('cell_d', 'encoding, template, cell', 'D', 'aucs')}
SELECT encoding, template, cell, round(auc, 9) AS auc, n_pos::BIGINT AS n_strong, n_neg::BIGINT AS n_weak FROM aucs""")
def a20(spark, sf):
    out = D.auc_by_cell(_margin(spark, sf), ["encoding", "template"])
    return out.select("encoding", "template", "cell", r9("auc").alias("auc"), F.col("n_pos").cast("long").alias("n_strong"),
                      F.col("n_neg").cast("long").alias("n_weak"))


@query("a20_auc_marked_mean", f"""WITH {SQL_REWARDS}, {SQL_CELL_D}, {sql_auc('cell_d', 'encoding, template, cell', 'D', 'aucs')},
t AS (SELECT encoding, template, avg(auc) FILTER (cell <> 'unmarked') AS m, avg(auc) FILTER (cell = 'unmarked') AS u FROM aucs GROUP BY ALL)
SELECT encoding, round(avg(m), 9) AS auc_marked, round(avg(u), 9) AS auc_unmarked FROM t GROUP BY ALL""")
def a20_mean(spark, sf):
    a = D.auc_by_cell(_margin(spark, sf), ["encoding", "template"])
    t = a.groupBy("encoding", "template").agg(F.avg(F.when(F.col("cell") != "unmarked", F.col("auc"))).alias("m"),
                                              F.avg(F.when(F.col("cell") == "unmarked", F.col("auc"))).alias("u"))
    return t.groupBy("encoding").agg(r9(F.avg("m")).alias("auc_marked"), r9(F.avg("u")).alias("auc_unmarked"))


SQL_SIGNS = "grid AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{e}', '{a}', '{c}', {s}::DOUBLE, {h}::DOUBLE)" for e, a, c, s, h in D.pair_signs(CREDIT)) + ") t(encoding, axis, cell, sign, half))"


def _auc_ci_sql(replicates: int) -> str:
    return f"""WITH {SQL_REWARDS}, {SQL_CELL_D}, {SQL_SIGNS},
m AS (SELECT * FROM cell_d WHERE s1 <> 0), {sql_auc('m', 'encoding, template, cell', 'D', 'aucs')},
est AS (SELECT encoding, cell, avg(auc) AS auc, max(n_pos)::BIGINT AS n_strong, max(n_neg)::BIGINT AS n_weak FROM aucs GROUP BY ALL),
pt AS (SELECT encoding, axis, sum(-sign * auc * half) AS mean, sum(auc * half) FILTER (sign > 0) AS auc_protected,
  sum(auc * half) FILTER (sign < 0) AS auc_reference, max(n_strong) AS n_strong, max(n_weak) AS n_weak
  FROM est JOIN grid USING (encoding, cell) GROUP BY ALL),
people AS (SELECT DISTINCT record_id, strong FROM m),
idx AS (SELECT record_id, strong, {sql_index('people', 'record_id', ['strong'])} AS idx FROM people),
sz1 AS (SELECT strong, count(*) AS n FROM idx WHERE strong GROUP BY ALL),
sz2 AS (SELECT strong, count(*) AS n FROM idx WHERE NOT strong GROUP BY ALL),
{sql_draws('d1', 'sz1', ['strong'], replicates, 0, 1)}, {sql_draws('d2', 'sz2', ['strong'], replicates, 0, 2)},
w AS (SELECT record_id, b, count(*)::DOUBLE AS w FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2) JOIN idx USING (strong, idx) GROUP BY ALL),
h AS (SELECT encoding, template, cell, b, D, sum(CASE WHEN strong THEN w ELSE 0 END) AS p, sum(CASE WHEN strong THEN 0 ELSE w END) AS q
  FROM w JOIN m USING (record_id) GROUP BY ALL),
below AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY encoding, template, cell, b ORDER BY D ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS qb FROM h),
ba AS (SELECT encoding, template, cell, b, sum(p * (qb + q / 2)) / (sum(p) * sum(q)) AS auc FROM below GROUP BY ALL),
bc AS (SELECT encoding, cell, b, avg(auc) AS auc FROM ba GROUP BY ALL),
bd AS (SELECT encoding, axis, b, sum(-sign * auc * half) AS d FROM bc JOIN grid USING (encoding, cell) GROUP BY ALL),
ci AS (SELECT encoding, axis, quantile_cont(d, 0.025) AS ci_low, quantile_cont(d, 0.975) AS ci_high FROM bd GROUP BY ALL)
SELECT encoding, axis, n_strong, n_weak, round(mean, 9) AS mean, round(auc_protected, 9) AS auc_protected,
  round(auc_reference, 9) AS auc_reference, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high FROM pt JOIN ci USING (encoding, axis)"""


@query("b5_auc_cross_influence", _auc_ci_sql(2000))
def b5(spark, sf):
    out = D.auc_cross_influence(_margin(spark, sf), CREDIT, 2000, 0)
    return out.select("encoding", "axis", "n_strong", "n_weak",
                      *[r9(c).alias(c) for c in ("mean", "auc_protected", "auc_reference", "ci_low", "ci_high")])


# ---- A21 / W7: quality tracking against length -------------------------------------------------------------------------
SQL_UNMARKED = "um AS (SELECT record_id, encoding, template, strong, D, n_words::DOUBLE AS len FROM cell_d WHERE cell = 'unmarked')"
SQL_BINS = """edges AS (SELECT encoding, template, quantile_cont(len, 0.2) AS e1, quantile_cont(len, 0.4) AS e2,
  quantile_cont(len, 0.6) AS e3, quantile_cont(len, 0.8) AS e4 FROM um GROUP BY ALL),
binned AS (SELECT um.*, (len >= e1)::INT + (len >= e2)::INT + (len >= e3)::INT + (len >= e4)::INT AS bin
  FROM um JOIN edges USING (encoding, template))"""


def _unmarked(spark, sf):
    w = rewards(spark, sf).filter("cell = 'unmarked'")
    return (D.cell_margins(w, ["record_id", "template", "encoding", "strong", "n_words"], {"D": D.MARGINS["D"]})
            .withColumn("len", F.col("n_words").cast("double")))


@query("w7_length_bins", f"""WITH {SQL_REWARDS}, {SQL_CELL_D}, {SQL_UNMARKED}, {SQL_BINS}
SELECT encoding, template, bin, count(*)::BIGINT AS n, min(len) AS min_len, max(len) AS max_len FROM binned GROUP BY ALL""")
def w7(spark, sf):
    return D.length_bins(_unmarked(spark, sf), ["encoding", "template"], "len").groupBy("encoding", "template", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("len").alias("min_len"), F.max("len").alias("max_len"))


@query("a21_quality_tracking", f"""WITH {SQL_REWARDS}, {SQL_CELL_D}, {SQL_UNMARKED}, {SQL_BINS},
{sql_auc('um', 'encoding, template', 'D', 'a1')}, {sql_auc('um', 'encoding, template', 'len', 'a2')},
{sql_auc('binned', 'encoding, template, bin', 'D', 'a3')},
w AS (SELECT encoding, template, sum(auc * n_pos * n_neg) / sum(n_pos * n_neg) AS auc, sum(n_pos * n_neg) AS same FROM a3 GROUP BY ALL),
fit AS (SELECT encoding, template, avg(D) AS my, avg(len) AS mx, covar_pop(D, len) AS c, var_pop(len) AS v FROM um GROUP BY ALL),
res AS (SELECT um.encoding, um.template, um.strong, round((D - my) - CASE WHEN v > 0 THEN c / v ELSE 0 END * (len - mx), 12) AS r FROM um JOIN fit USING (encoding, template)),
{sql_auc('res', 'encoding, template', 'r', 'a4')}
SELECT encoding, template, a1.n_pos::BIGINT AS n_strong, a1.n_neg::BIGINT AS n_weak, round(a1.auc, 9) AS auc_d, round(a2.auc, 9) AS auc_length,
  round(a1.auc - a2.auc, 9) AS auc_d_minus_length, round(w.auc, 9) AS auc_d_within_length_strata,
  round(same / (a1.n_pos * a1.n_neg), 9) AS coverage, round(a4.auc, 9) AS auc_d_length_residualised
FROM a1 JOIN a2 USING (encoding, template) JOIN w USING (encoding, template) JOIN a4 USING (encoding, template)""")
def a21(spark, sf):
    out = D.quality_tracking(_unmarked(spark, sf), ["encoding", "template"], "D", "len")
    return out.select("encoding", "template", F.col("n_pos").cast("long").alias("n_strong"), F.col("n_neg").cast("long").alias("n_weak"),
                      *[r9(c).alias(c) for c in ("auc_d", "auc_length", "auc_d_minus_length", "auc_d_within_length_strata",
                                                 "coverage", "auc_d_length_residualised")])


# ---- A22 / J9: placement check -------------------------------------------------------------------------------------------
KEEP = [f"main:{a}" for a in AXES] + ["corner"]
SQL_DIRECT = f"""direct AS (SELECT record_id, encoding, template, cell, s1, s2, s3, strong,
  (('0x' || substr(sha256('direct|' || record_id || '|' || template || '|' || encoding || '|' || cell), 1, 15))::BIGINT % 1000 - 80 * s1) / 1000 AS reward
  FROM records CROSS JOIN templates CROSS JOIN encodings CROSS JOIN (SELECT * FROM cells WHERE cell <> 'unmarked'))"""


def direct_rewards(spark, sf):
    """One score per (record, template, encoding, cell) with the marker in the response."""
    from counterlens.functions.keyed import hash15
    from counterlens.queries.base import records, reward_grid, spread
    grid = reward_grid(spark, unmarked=False).drop("response").distinct()
    base = spread(records(spark, sf, text=False), "record_id").crossJoin(F.broadcast(grid))
    noise = F.pmod(hash15("direct", F.col("record_id"), F.col("template"), F.col("encoding"), F.col("cell")), F.lit(1000))
    return base.select("record_id", "strong", "template", "encoding", "cell", "s1", "s2", "s3",
                       ((noise - 80 * F.col("s1")) / F.lit(1000.0)).alias("reward"))


def _placement_sql() -> str:
    parts = []
    for k in KEEP:
        w = {"main:sex": "s1 / 4", "main:age": "s2 / 4", "main:marital_status": "s3 / 4"}.get(
            k, "CASE WHEN s1 + s2 + s3 = 3 THEN 1 WHEN s1 + s2 + s3 = -3 THEN -1 ELSE 0 END")
        parts.append(f"SELECT record_id, encoding, strong, 'direct_gap' AS source, '{k}' AS effect, sum(({w}) * reward) / 2 AS v FROM direct GROUP BY ALL")
        parts.append(f"SELECT record_id, encoding, strong, 'prompt_effect:' || response AS source, '{k}' AS effect, sum(({w}) * reward) / 2 AS v FROM rewards GROUP BY ALL")
        parts.append(f"SELECT record_id, encoding, strong, 'did' AS source, '{k}' AS effect, sum(({w}) * CASE response WHEN 'approve' THEN reward WHEN 'decline' THEN -reward ELSE 0 END) / 2 AS v FROM rewards GROUP BY ALL")
    return f"""WITH {SQL_REWARDS}, {SQL_DIRECT}, long AS ({' UNION ALL '.join(parts)})
SELECT encoding, strong, source, effect, count(*)::BIGINT AS n, round(avg(v), 9) AS mean, round(avg(v) / stddev_samp(v), 9) AS d_z FROM long GROUP BY ALL"""


@query("a22_placement_check", _placement_sql())
def a22(spark, sf):
    by = ["record_id", "encoding", "strong"]
    wide = D.placement_effects(direct_rewards(spark, sf), rewards(spark, sf), CREDIT, by)
    names = [c for c in wide.columns if "|" in c]
    rows = D.to_long(wide, ["encoding", "strong"], names)
    parts = F.split("stat", r"\|")
    return (rows.select("encoding", "strong", parts[0].alias("source"), parts[1].alias("effect"), "value")
            .groupBy("encoding", "strong", "source", "effect")
            .agg(F.count(F.lit(1)).alias("n"), r9(F.avg("value")).alias("mean"),
                 r9(F.avg("value") / F.stddev_samp("value")).alias("d_z")))


# ---- A47: axis-only effects --------------------------------------------------------------------------------------------------
@query("a47_axis_effects", f"""WITH {SQL_REWARDS}, {SQL_CELL_D}, {sql_effects('D_overt')}
SELECT record_id, encoding, round("D_overt:main:sex", 9) AS sex, round("D_overt:main:age", 9) AS age,
  round("D_overt:main:marital_status", 9) AS marital_status, round("D_overt:corner", 9) AS intersection FROM effects""")
def a47(spark, sf):
    wide = D.record_effects(rewards(spark, sf), CREDIT, ["record_id", "encoding"], {"D_overt": D.MARGINS["D_overt"]})
    return wide.select("record_id", "encoding", *[r9(f"`D_overt:main:{a}`").alias(a) for a in AXES],
                       r9("`D_overt:corner`").alias("intersection"))
