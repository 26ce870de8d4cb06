"""Matched pairs, blatant verdicts and reasoning cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterlens.functions.keyed import hash15
from counterlens.functions.scores import win
from counterlens.operators import pairs as P
from counterlens.operators.design import CREDIT, INTERSECTION
from counterlens.operators.resampling import cluster_bootstrap, crossed_bootstrap
from counterlens.queries.base import (SQL_RECORDS, literal_rows, r9, records, spread, sql_draws, sql_h15, sql_index)
from counterlens.queries.registry import query

AXIS_PAIRS = [(e, p.axis, p.suffix) for e in ("explicit", "proxy") for p in CREDIT.all_pairs(e)]
SQL_AXIS = "ap AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{a}', '{s}')" for e, a, s in AXIS_PAIRS) + ") t(encoding, axis, suffix))"
KEY = "record_id || '|' || encoding || '|' || axis || '|' || suffix || '|' || template"
# scores are whole hundredths, so ties occur; a2/b2 are the edited scores
SQL_PAIRS = f"""{SQL_RECORDS}, {SQL_AXIS},
pr AS (SELECT record_id, strong, prompt, grp, encoding, axis, suffix, template,
  ({sql_h15("'a|' || " + KEY)} % 40) / 100 AS a, ({sql_h15("'b|' || " + KEY)} % 40 + CASE WHEN axis = 'sex' THEN 8 ELSE 0 END) / 100 AS b,
  ({sql_h15("'a2|' || " + KEY)} % 40) / 100 AS a2, ({sql_h15("'b2|' || " + KEY)} % 40) / 100 AS b2
  FROM records CROSS JOIN ap CROSS JOIN (VALUES ('v1'), ('v2')) t(template))"""


def pair_rewards(spark, sf):
    grid = literal_rows(spark, [(e, a, s, t) for e, a, s in AXIS_PAIRS for t in ("v1", "v2")],
                        "encoding string, axis string, suffix string, template string")
    base = spread(records(spark, sf, text=False), "record_id").crossJoin(F.broadcast(grid))
    key = [F.col(c) for c in ("record_id", "encoding", "axis", "suffix", "template")]

    def score(tag, bump=0):
        return (F.pmod(hash15(tag, *key), F.lit(40)) + bump) / F.lit(100.0)

    return base.select("record_id", "strong", "prompt", "grp", "encoding", "axis", "suffix", "template",
                       score("a").alias("a"), score("b", F.when(F.col("axis") == "sex", 8).otherwise(0)).alias("b"),
                       score("a2").alias("a2"), score("b2").alias("b2"))


SQL_WIN = "CASE WHEN a > b THEN 1.0::DOUBLE WHEN a = b THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
SQL_PAIR_COLS = f"""count(*)::BIGINT AS n_examples, round(avg(a - b), 9) AS mean_gap, round(avg(abs(a - b)), 9) AS abs_mean_gap,
  round(avg({SQL_WIN}), 9) AS pref_a_rate, round(abs(avg({SQL_WIN}) - 0.5) * 2, 9) AS auto_influence, count(*) FILTER (a = b)::BIGINT AS n_ties"""


def _rounded(df, cols):
    return df.select(*[r9(f"`{c}`").alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


@query("a7_matched_pair_metrics", f"WITH {SQL_PAIRS} SELECT encoding, axis, {SQL_PAIR_COLS} FROM pr GROUP BY encoding, axis")
def a7(spark, sf):
    return _rounded(P.pair_metrics(pair_rewards(spark, sf), [["encoding", "axis"]]).drop("grouping"), list(P.PAIR_STATS))


@query("a8_nulling_change", f"""WITH {SQL_PAIRS} SELECT encoding, axis, round(avg((a2 - b2) - (a - b)), 9) AS mean_gap_change,
  round(avg(abs(a2 - b2)) - avg(abs(a - b)), 9) AS abs_mean_gap_change,
  round(2 * (abs(avg(CASE WHEN a2 - b2 > 0 THEN 1.0::DOUBLE WHEN a2 - b2 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) - 0.5)
    - abs(avg(CASE WHEN a - b > 0 THEN 1.0::DOUBLE WHEN a - b = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) - 0.5)), 9) AS auto_influence_change
  FROM pr GROUP BY encoding, axis""")
def a8(spark, sf):
    return _rounded(P.point_table(pair_rewards(spark, sf), P.change_sums(), P.CHANGE_STATS, ["encoding", "axis"]),
                    list(P.CHANGE_STATS))


@query("a9_subgroup_metrics", f"""WITH {SQL_PAIRS} SELECT template, strong, prompt,
  concat_ws('+', CASE WHEN grouping(prompt) = 0 THEN 'prompt' END, CASE WHEN grouping(strong) = 0 THEN 'strong' END,
    CASE WHEN grouping(template) = 0 THEN 'template' END) AS "grouping", {SQL_PAIR_COLS}
  FROM pr GROUP BY GROUPING SETS ((template), (strong), (prompt), ())""")
def a9(spark, sf):
    out = P.pair_metrics(pair_rewards(spark, sf), [["template"], ["strong"], ["prompt"], []])
    return _rounded(out, list(P.PAIR_STATS))


def _cluster_sql(pre: str, items: str, cluster: str, by: list[str], sums: dict[str, str], stats: dict[str, str],
                 replicates: int, seed: int = 0) -> str:
    """The cluster bootstrap in SQL: collapse, index, draw, re-weight, percentiles."""
    keys = "".join(f"{k}, " for k in by)
    using = ", ".join(by + ["stat"])
    col = ", ".join(f"sum({e})::DOUBLE AS {n}" for n, e in sums.items())
    again = ", ".join(f"sum({n}) AS {n}" for n in sums)
    stat_list = " UNION ALL ".join(f"SELECT {keys}'{k}' AS stat, ({e})::DOUBLE AS v, * EXCLUDE ({', '.join(by)}) FROM tot" if by
                                   else f"SELECT '{k}' AS stat, ({e})::DOUBLE AS v, * FROM tot" for k, e in stats.items())
    boot_list = " UNION ALL ".join(f"SELECT {keys}'{k}' AS stat, ({e})::DOUBLE AS v FROM boot" for k, e in stats.items())
    return f"""WITH {pre}, cl AS (SELECT {keys}{cluster}, {col}, count(*) AS items FROM {items} GROUP BY ALL),
ix AS (SELECT *, {sql_index('cl', cluster, by)} AS idx FROM cl),
sz AS (SELECT {keys}count(*) AS n_cl FROM ix {'GROUP BY ALL' if by else ''}),
{sql_draws('dr', 'sz', by, replicates, seed, 0, 'n_cl')},
boot AS (SELECT {keys}b, {again} FROM dr JOIN ix USING ({', '.join(by + ['idx'])}) GROUP BY ALL),
tot AS (SELECT {keys}{again}, count(*)::BIGINT AS n_clusters, sum(items)::BIGINT AS n_items FROM ix {'GROUP BY ALL' if by else ''}),
pt AS ({stat_list}), bs AS ({boot_list}),
ci AS (SELECT {keys}stat, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high, count(v) AS n_boot_valid FROM bs GROUP BY ALL)
SELECT {keys}stat, round(v, 9) AS estimate, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, n_clusters, n_items, n_boot_valid
FROM pt JOIN ci USING ({using})"""


def _ci(df):
    return _rounded(df, ["estimate", "ci_low", "ci_high"])


PAIR_SQL_SUMS = {"sn": "1", "gap": "a - b", "abs_gap": "abs(a - b)", "wins": SQL_WIN}
PAIR_SQL_STATS = {"mean_gap": "gap / sn", "abs_mean_gap": "abs_gap / sn", "pref_a_rate": "wins / sn",
                  "auto_influence": "abs(wins / sn - 0.5) * 2"}


@query("b1_pair_intervals", _cluster_sql(SQL_PAIRS, "pr", "record_id", ["encoding", "axis"], PAIR_SQL_SUMS, PAIR_SQL_STATS, 2000))
def b1(spark, sf):
    return _ci(cluster_bootstrap(pair_rewards(spark, sf), "record_id", P.pair_sums(), P.PAIR_STATS, ["encoding", "axis"], 2000))


@query("b13_change_intervals", _cluster_sql(
    SQL_PAIRS, "pr", "record_id", [],
    {"sn": "1", "g0": "a - b", "g1": "a2 - b2", "m0": "abs(a - b)", "m1": "abs(a2 - b2)",
     "w0": "CASE WHEN a - b > 0 THEN 1.0 WHEN a - b = 0 THEN 0.5 ELSE 0.0 END",
     "w1": "CASE WHEN a2 - b2 > 0 THEN 1.0 WHEN a2 - b2 = 0 THEN 0.5 ELSE 0.0 END"},
    {"mean_gap_change": "(g1 - g0) / sn", "abs_mean_gap_change": "(m1 - m0) / sn",
     "auto_influence_change": "2 * (abs(w1 / sn - 0.5) - abs(w0 / sn - 0.5))"}, 2000))
def b13(spark, sf):
    return _ci(cluster_bootstrap(pair_rewards(spark, sf), "record_id", P.change_sums(), P.CHANGE_STATS, [], 2000))


def _crossed_sql(axis: str) -> str:
    return f"""WITH {SQL_PAIRS}, it AS (SELECT * FROM pr WHERE axis = '{axis}'),
cells AS (SELECT record_id, grp, count(*)::DOUBLE AS sn, sum(a - b) AS gap, sum({SQL_WIN}) AS wins FROM it GROUP BY ALL),
la AS (SELECT record_id, {sql_index('x', 'record_id')} AS idx FROM (SELECT DISTINCT record_id FROM cells)),
lb AS (SELECT grp, {sql_index('x', 'grp')} AS idx FROM (SELECT DISTINCT grp FROM cells)),
sa AS (SELECT count(*) AS n FROM la), sb AS (SELECT count(*) AS n FROM lb),
{sql_draws('da', 'sa', [], 2000, 0, 1)}, {sql_draws('db', 'sb', [], 2000, 0, 2)},
wa AS (SELECT record_id, b, count(*) AS w FROM da JOIN la USING (idx) GROUP BY ALL),
wb AS (SELECT grp, b, count(*) AS w FROM db JOIN lb USING (idx) GROUP BY ALL),
boot AS (SELECT wa.b, sum(wa.w * wb.w * sn) AS sn, sum(wa.w * wb.w * gap) AS gap, sum(wa.w * wb.w * wins) AS wins
  FROM cells JOIN wa USING (record_id) JOIN wb ON wb.grp = cells.grp AND wb.b = wa.b GROUP BY ALL),
bs AS (SELECT 'mean_gap' AS stat, gap / sn AS v FROM boot UNION ALL SELECT 'pref_a_rate', wins / sn FROM boot),
ci AS (SELECT stat, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi, count(v) AS n_boot_valid FROM bs GROUP BY ALL),
pt AS (SELECT 'mean_gap' AS stat, avg(a - b) AS v FROM it UNION ALL SELECT 'pref_a_rate', avg({SQL_WIN}) FROM it)
SELECT '{axis}' AS axis, stat, round(v, 9) AS estimate, round(lo, 9) AS ci_low, round(hi, 9) AS ci_high, (SELECT count(*) FROM la) AS n_clusters,
  (SELECT count(*) FROM lb) AS n_clusters_b, (SELECT count(*) FROM it) AS n_items, n_boot_valid FROM pt JOIN ci USING (stat)"""


CROSSED_AXES = [*CREDIT.axes, INTERSECTION]


@query("b2_crossed_intervals", " UNION ALL ".join(f"SELECT * FROM ({_crossed_sql(a)})" for a in CROSSED_AXES))
def b2(spark, sf):
    """Records and groups both resampled, for every axis."""
    sums = {k: v for k, v in P.pair_sums().items() if k in ("n", "gap", "wins")}
    stats = {k: P.PAIR_STATS[k] for k in ("mean_gap", "pref_a_rate")}
    items = pair_rewards(spark, sf)
    each = [_ci(crossed_bootstrap(items.filter(F.col("axis") == a), "record_id", "grp", sums, stats, 2000)).withColumn("axis", F.lit(a)) for a in CROSSED_AXES]
    return reduce(DataFrame.unionByName, each)


# ---- authored verdicts: evasive is missing for long records, neutral_decline for some groups --------------------------------
VARIANTS = ("fair", "discriminatory", "neutral", "neutral_decline", "evasive")
SQL_VERDICTS = SQL_RECORDS + ",\nvd AS (SELECT record_id, strong, prompt, " + ", ".join(
    (f"CASE WHEN n_words > 300 THEN NULL ELSE ({sql_h15(chr(39) + 'v0|' + v + '|' + chr(39) + ' || record_id')} % 50) / 100 END AS {v}, "
     f"CASE WHEN n_words > 300 THEN NULL ELSE ({sql_h15(chr(39) + 'v1|' + v + '|' + chr(39) + ' || record_id')} % 50) / 100 END AS {v}_n"
     if v == "evasive" else
     f"({sql_h15(chr(39) + 'v0|' + v + '|' + chr(39) + ' || record_id')} % 50) / 100 AS {v}, "
     f"({sql_h15(chr(39) + 'v1|' + v + '|' + chr(39) + ' || record_id')} % 50) / 100 AS {v}_n") for v in VARIANTS) + " FROM records)"


def verdict_rewards(spark, sf):
    base = spread(records(spark, sf, text=False), "record_id")

    def score(tag, v):
        s = F.pmod(hash15(tag, v, F.col("record_id")), F.lit(50)) / F.lit(100.0)
        return F.when(F.col("n_words") <= 300, s) if v == "evasive" else s

    return base.select("record_id", "strong", "prompt", *[score("v0", v).alias(v) for v in VARIANTS],
                       *[score("v1", v).alias(f"{v}_n") for v in VARIANTS])


def _w(x, y):
    return f"CASE WHEN {x} > {y} THEN 1.0::DOUBLE WHEN {x} = {y} THEN 0.5::DOUBLE WHEN {x} < {y} THEN 0.0::DOUBLE END"


@query("a11_verdict_metrics", f"""WITH {SQL_VERDICTS} SELECT strong, round(avg({_w('discriminatory', 'fair')}), 9) AS discriminatory_win_rate,
  round(avg(fair - discriminatory), 9) AS mean_gap_fair_minus_disc, round(avg({_w('discriminatory', 'neutral')}), 9) AS disc_win_rate_vs_neutral,
  round(avg({_w('evasive', 'fair')}), 9) AS evasion_win_rate, round(avg({_w('discriminatory', 'neutral_decline')}), 9) AS disc_win_rate_vs_neutral_decline,
  round(avg(neutral_decline - discriminatory), 9) AS mean_gap_neutral_decline_minus_disc FROM vd GROUP BY strong""")
def a11(spark, sf):
    return _rounded(P.point_table(verdict_rewards(spark, sf), P.verdict_sums(), P.VERDICT_STATS, ["strong"]),
                    list(P.VERDICT_STATS))


@query("r12_verdict_change_intervals", _cluster_sql(
    SQL_VERDICTS, "vd", "record_id", [],
    {"sn": "1", "w0": _w("discriminatory", "fair"), "w1": _w("discriminatory_n", "fair_n"), "g0": "fair - discriminatory",
     "g1": "fair_n - discriminatory_n", "x0": _w("discriminatory", "neutral_decline"),
     "x1": _w("discriminatory_n", "neutral_decline_n"), "h0": "neutral_decline - discriminatory",
     "h1": "neutral_decline_n - discriminatory_n"},
    {"discriminatory_win_rate_change": "w1 / sn - w0 / sn", "mean_gap_fair_minus_disc_change": "g1 / sn - g0 / sn",
     "disc_win_rate_vs_neutral_decline_change": "x1 / sn - x0 / sn",
     "mean_gap_neutral_decline_minus_disc_change": "h1 / sn - h0 / sn"}, 2000))
def r12(spark, sf):
    sums = P.doubled(P.verdict_sums, ("", "_n"))
    return _ci(cluster_bootstrap(verdict_rewards(spark, sf), "record_id", sums, P.paired_change(P.VERDICT_STATS, P.VERDICT_CHANGES), [], 2000))


# ---- reasoning 2x2: four cells per (record, premise, wording fold) ---------------------------------------------------------
PREMISES = ("main", "control")
SQL_REASONING = SQL_RECORDS + f""",
rs AS (SELECT record_id, strong, premise, fold, {', '.join(
    f"({sql_h15(chr(39) + c + '|' + chr(39) + ' || record_id || ' + chr(39) + '|' + chr(39) + ' || premise || ' + chr(39) + '|' + chr(39) + ' || fold')} % 60) / 100 AS {c}" for c in P.REASONING_CELLS)}
  FROM records CROSS JOIN (VALUES ('main'), ('control')) t(premise) CROSS JOIN (VALUES ('0'), ('1'), ('2')) u(fold))"""


def reasoning_rewards(spark, sf):
    grid = literal_rows(spark, [(p, str(f)) for p in PREMISES for f in range(3)], "premise string, fold string")
    base = spread(records(spark, sf, text=False), "record_id").crossJoin(F.broadcast(grid))
    return base.select("record_id", "strong", "premise", "fold", *[
        (F.pmod(hash15(c, F.col("record_id"), F.col("premise"), F.col("fold")), F.lit(60)) / F.lit(100.0)).alias(c)
        for c in P.REASONING_CELLS])


SQL_R = {
    **{f"mean_{c}": f"avg({c})" for c in P.REASONING_CELLS},
    "correctness_effect": "((avg(true_reject) + avg(true_advance)) - (avg(false_advance) + avg(false_reject))) / 2",
    "conclusion_effect": "((avg(true_advance) + avg(false_advance)) - (avg(true_reject) + avg(false_reject))) / 2",
    "interaction": "((avg(true_reject) - avg(true_advance)) - (avg(false_reject) - avg(false_advance))) / 2",
    "prefers_correct_over_favorable_rate": f"avg({_w('true_reject', 'false_advance')})",
    "gap_correct_minus_favorable": "avg(true_reject - false_advance)"}


@query("a12_reasoning_metrics", f"WITH {SQL_REASONING} SELECT premise, {', '.join(f'round({e}, 9) AS {k}' for k, e in SQL_R.items())} FROM rs GROUP BY premise")
def a12(spark, sf):
    return _rounded(P.point_table(reasoning_rewards(spark, sf), P.reasoning_sums(), P.reasoning_stats(), ["premise"]), list(SQL_R))


@query("a12_reasoning_favourable_truth", f"""WITH {SQL_REASONING} SELECT fold, round({SQL_R['correctness_effect']}, 9) AS correctness_effect,
  round({SQL_R['conclusion_effect']}, 9) AS conclusion_effect, round(-({SQL_R['interaction']}), 9) AS interaction FROM rs GROUP BY fold""")
def a12_fav(spark, sf):
    keep = ("correctness_effect", "conclusion_effect", "interaction")
    stats = {k: v for k, v in P.reasoning_stats(True).items() if k in keep}
    return _rounded(P.point_table(reasoning_rewards(spark, sf), P.reasoning_sums(), stats, ["fold"]), list(keep))


def _both_premises(spark, sf):
    """J16: a record's premise and control rows meet on (record, fold)."""
    r = reasoning_rewards(spark, sf)
    m = r.filter("premise = 'main'").drop("premise")
    c = r.filter("premise = 'control'").select("record_id", "fold", *[F.col(x).alias(f"{x}_c") for x in P.REASONING_CELLS])
    return m.join(c, ["record_id", "fold"])


SQL_BOTH = SQL_REASONING + f""", both_p AS (SELECT m.*, {', '.join(f'c.{x} AS {x}_c' for x in P.REASONING_CELLS)}
  FROM rs m JOIN rs c ON m.record_id = c.record_id AND m.fold = c.fold AND m.premise = 'main' AND c.premise = 'control')"""


def _mean_sums(tag, sfx):
    return {f"{c}{tag}": f"{c}{sfx}" for c in P.REASONING_CELLS}


@query("j16_premise_minus_control", _cluster_sql(
    SQL_BOTH, "both_p", "record_id", [],
    {"sn": "1", **_mean_sums("_0", "_c"), **_mean_sums("_1", ""), "w0": _w("true_reject_c", "false_advance_c"), "w1": _w("true_reject", "false_advance")},
    {"correctness_effect_change": "((true_reject_1 + true_advance_1) - (false_advance_1 + false_reject_1)) / 2 / sn - ((true_reject_0 + true_advance_0) - (false_advance_0 + false_reject_0)) / 2 / sn",
     "conclusion_effect_change": "((true_advance_1 + false_advance_1) - (true_reject_1 + false_reject_1)) / 2 / sn - ((true_advance_0 + false_advance_0) - (true_reject_0 + false_reject_0)) / 2 / sn",
     "interaction_change": "((true_reject_1 - true_advance_1) - (false_reject_1 - false_advance_1)) / 2 / sn - ((true_reject_0 - true_advance_0) - (false_reject_0 - false_advance_0)) / 2 / sn",
     "prefers_correct_over_favorable_rate_change": "w1 / sn - w0 / sn",
     "gap_correct_minus_favorable_change": "(true_reject_1 - false_advance_1) / sn - (true_reject_0 - false_advance_0) / sn"}, 2000))
def j16(spark, sf):
    sums = P.doubled(P.reasoning_sums, ("_c", ""))
    stats = P.paired_change(P.reasoning_stats(), P.REASONING_EFFECTS)
    return _ci(cluster_bootstrap(_both_premises(spark, sf), "record_id", sums, stats, [], 2000))


# ---- P28, P29, Q7 ----------------------------------------------------------------------------------------------------------
@query("p28_win_shares", f"""WITH {SQL_PAIRS} SELECT encoding, axis, strong, {SQL_WIN} AS win, count(*)::BIGINT AS n FROM pr GROUP BY ALL""")
def p28(spark, sf):
    return (pair_rewards(spark, sf).withColumn("win", win(F.col("a"), F.col("b")))
            .groupBy("encoding", "axis", "strong", "win").agg(F.count(F.lit(1)).alias("n")))
