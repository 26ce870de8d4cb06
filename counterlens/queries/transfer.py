"""Positioned effects, transfer relations, probe examples, erasure reward gaps and reasoning labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterlens.functions.keyed import digest, hash15
from counterlens.operators import blocks as B
from counterlens.operators import pairs as P
from counterlens.operators import positioned as PO
from counterlens.operators import relations as R
from counterlens.operators.design import DESIGNS, EDUCATION
from counterlens.operators.ranking import hash_rank
from counterlens.operators.resampling import cluster_bootstrap
from counterlens.queries.base import SEED, SQL_RECORDS, literal_rows, r9, records, spread, sql_h15
from counterlens.queries.directions import SQL_SOURCES
from counterlens.queries.design import SQL_EPAIRS, _essay_sql, essay_blocks
from counterlens.queries.pairs import SQL_PAIRS, SQL_REASONING, SQL_WIN, _ci, _cluster_sql, pair_rewards, reasoning_rewards
from counterlens.queries.registry import query

# ---- positioned sentences: a, b per setting, one neutral score per (record, position) -----------------------------------
POSITION_ROWS = [(p, s) for p in PO.POSITIONS for s in ("all", "x", "y")]
_K = "record_id || '|' || position"
SQL_POSITIONED = f"""{SQL_RECORDS}, po AS (SELECT * FROM (VALUES {', '.join(f"('{p}', '{s}')" for p, s in POSITION_ROWS)}) t(position, setting)),
ps AS (SELECT record_id, position, setting, ({sql_h15("'neutral|' || " + _K)} % 50) / 100 AS neutral,
  ({sql_h15("'pa|' || " + _K + " || '|' || setting")} % 50 + CASE WHEN position = 'opening' THEN 6 ELSE 0 END) / 100 AS a,
  ({sql_h15("'pb|' || " + _K + " || '|' || setting")} % 50) / 100 AS b FROM records CROSS JOIN po)"""


def positioned_rewards(spark, sf):
    grid = literal_rows(spark, POSITION_ROWS, "position string, setting string")
    base = spread(records(spark, sf, text=False), "record_id").crossJoin(F.broadcast(grid))
    key = [F.col("record_id"), F.col("position")]

    def score(tag, *more, bump=0):
        return (F.pmod(hash15(tag, *key, *more), F.lit(50)) + bump) / F.lit(100.0)

    return base.select("record_id", "position", "setting", score("neutral").alias("neutral"),
                       score("pa", F.col("setting"), bump=F.when(F.col("position") == "opening", 6).otherwise(0)).alias("a"),
                       score("pb", F.col("setting")).alias("b"))


_W = "CASE WHEN {x} > {y} THEN 1.0::DOUBLE WHEN {x} = {y} THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"


@query("a30_positioned_effect", _cluster_sql(
    SQL_POSITIONED, "ps", "record_id", ["position"],
    {"k": "1", "sn": "neutral", "sa": "a", "sb": "b", "w": SQL_WIN, "au": _W.format(x="a", y="neutral"), "bu": _W.format(x="b", y="neutral")},
    {"delta_a": "(sa - sn) / k", "delta_b": "(sb - sn) / k", "main_effect": "((sa + sb) / 2 - sn) / k", "identity_gap": "(sa - sb) / k",
     "pref_a_rate": "w / k", "auto_influence": "abs(w / k - 0.5) * 2", "frac_a_above_neutral": "au / k", "frac_b_above_neutral": "bu / k"}, 2000))
def a30(spark, sf):
    return _ci(cluster_bootstrap(positioned_rewards(spark, sf), "record_id", PO.positioned_sums(), PO.POSITIONED_STATS, ["position"], 2000))


@query("a30_identity_gap_by_setting", f"WITH {SQL_POSITIONED} SELECT position, setting, round(avg(a - b), 9) AS gap FROM ps GROUP BY ALL")
def a30_setting(spark, sf):
    return positioned_rewards(spark, sf).groupBy("position", "setting").agg(r9(F.avg(F.col("a") - F.col("b"))).alias("gap"))


@query("p16_ends", f"""WITH {SQL_RECORDS} SELECT record_id, md5('A first line.' || chr(10) || chr(10) || text) AS opening,
  md5(rtrim(text, ' ') || chr(10) || chr(10) || 'A last line.') AS conclusion FROM records""")
def p16_ends(spark, sf):
    r = records(spark, sf).withColumn("text", F.rtrim("text"))
    whole = records(spark, sf).select("record_id", F.md5(PO.positioned("text", F.lit("A first line.\n\n"), "opening")).alias("opening"))
    return r.select("record_id", F.md5(PO.positioned("text", F.lit("\n\nA last line."), "conclusion")).alias("conclusion")).join(whole, "record_id")


# ---- transfer: every source against every target's pair rows -------------------------------------------------------------
def _credit_targets(spark, sf):
    sources = R.source_table(spark, DESIGNS)
    credit = sources.filter("domain = 'credit'").select("encoding", "axis", F.struct("*").alias("t"))
    return pair_rewards(spark, sf).join(F.broadcast(credit), ["encoding", "axis"]), sources


@query("p35_relations", f"""WITH {SQL_PAIRS}, {SQL_SOURCES} SELECT source, pr.encoding, pr.axis, relation, count(*)::BIGINT AS rows
FROM pr JOIN rel ON td = 'credit' AND te = pr.encoding AND ta = pr.axis GROUP BY ALL""")
def p35(spark, sf):
    """Relation of every source direction to the rows it would be projected out of."""
    rows, sources = _credit_targets(spark, sf)
    per = rows.groupBy("encoding", "axis", "t").agg(F.count(F.lit(1)).alias("rows"))
    g = R.transfer_grid(per, sources)
    return g.select(F.concat_ws("/", "s.domain", "s.encoding", "s.axis").alias("source"), "encoding", "axis", "relation", "rows")


# ---- probe pairs and evaluation examples ---------------------------------------------------------------------------------
def _essay_pairs(spark, sf):
    blk = essay_blocks(spark, sf, ("strong", "prompt"))
    parts = [B.pair_rows(blk, EDUCATION, e, ["record_id", "template", "encoding", "strong", "prompt"], "edu") for e in ("explicit", "proxy")]
    return parts[0].unionByName(parts[1])


_PAIR_JOIN = """ep p JOIN ec a ON a.encoding = p.encoding AND a.cell = p.cell_a JOIN ec b ON b.encoding = p.encoding AND b.cell = p.cell_b
  AND b.record_id = a.record_id AND b.template = a.template"""
_PAIR_ID = "'edu-' || p.axis || '-' || a.encoding || '-' || a.template || '-' || a.record_id || '-' || p.suffix"


@query("p42_probe_pairs", f"""WITH {_essay_sql()}, {SQL_EPAIRS} SELECT {_PAIR_ID} AS id, p.axis, a.encoding, a.record_id, p.label_a, p.label_b,
  md5(a.text) AS positive, md5(b.text) AS negative FROM {_PAIR_JOIN} WHERE a.strong""")
def p42_probe(spark, sf):
    p = R.probe_pairs(_essay_pairs(spark, sf).filter("strong"))
    return p.withColumns({c: F.md5(c) for c in ("positive", "negative")})


@query("p42_evaluation_examples", f"""WITH {_essay_sql()}, {SQL_EPAIRS} SELECT {_PAIR_ID} AS id, p.axis, a.encoding, a.record_id, a.template,
  p.label_a, p.label_b, a.strong, md5(a.text) AS a, md5(b.text) AS b FROM {_PAIR_JOIN} WHERE NOT a.strong""")
def p42_eval(spark, sf):
    p = R.evaluation_examples(_essay_pairs(spark, sf).filter("not strong"), "strong")
    return p.withColumns({c: F.md5(c) for c in ("a", "b")})


# ---- erasure reward gaps --------------------------------------------------------------------------------------------------
METHODS = (("none", 10), ("diffmean", 5), ("affine", 2), ("affine_cells", 1))
SQL_GAPS = f"""{SQL_RECORDS}, em AS (SELECT * FROM (VALUES {', '.join(f"('{m}', {k})" for m, k in METHODS)}) t(method, k)),
er AS (SELECT record_id, method, y, ({sql_h15("'erase|' || record_id || '|' || method || '|' || y || '|' || v")} % 30 + k * y) / 100 AS reward
  FROM records, em, (VALUES (0), (1)) ys(y), (VALUES (0), (1), (2)) vs(v)),
gp AS (SELECT method, record_id, avg(reward) FILTER (y = 1) - avg(reward) FILTER (y = 0) AS gap FROM er GROUP BY ALL),
wide AS (SELECT record_id, {', '.join(f"max(gap) FILTER (method = '{m}') AS {m}" for m, _ in METHODS)} FROM gp GROUP BY record_id)"""


@query("a42_reward_gap", _cluster_sql(
    SQL_GAPS, "wide", "record_id", [], {"sn": "1", **{f"s_{m}": m for m, _ in METHODS}},
    {**{m: f"s_{m} / sn" for m, _ in METHODS}, **{f"{m}_minus_none": f"(s_{m} - s_none) / sn" for m, _ in METHODS[1:]}}, 2000))
def a42(spark, sf):
    """Gap between label-1 and label-0 rewards per record under each erasure, and its paired change from none."""
    grid = literal_rows(spark, [(m, k, y, v) for m, k in METHODS for y in (0, 1) for v in range(3)], "method string, k int, y int, v int")
    rows = spread(records(spark, sf, text=False).select("record_id"), "record_id").crossJoin(F.broadcast(grid))
    noise = F.pmod(hash15("erase", F.col("record_id"), F.col("method"), F.col("y"), F.col("v")), F.lit(30))
    gaps = R.reward_gaps(rows.withColumn("reward", (noise + F.col("k") * F.col("y")) / F.lit(100.0)), "record_id", ["method"], "y", "reward")
    wide = gaps.groupBy("record_id").agg(*[F.max(F.when(F.col("method") == m, F.col("gap"))).alias(m) for m, _ in METHODS])
    sums = {"n": F.lit(1.0), **{f"s_{m}": F.col(m) for m, _ in METHODS}}
    stats = {**{m: lambda s, m=m: s[f"s_{m}"] / s["n"] for m, _ in METHODS},
             **{f"{m}_minus_none": lambda s, m=m: (s[f"s_{m}"] - s["s_none"]) / s["n"] for m, _ in METHODS[1:]}}
    return _ci(cluster_bootstrap(wide, "record_id", sums, stats, [], 2000))


# ---- reasoning labels, nested prefixes -------------------------------------------------------------------------------------
@query("p27_reasoning_labels", f"""WITH {SQL_REASONING}, c AS (UNPIVOT (SELECT record_id, premise, fold, {', '.join(P.REASONING_CELLS)} FROM rs)
  ON {', '.join(P.REASONING_CELLS)} INTO NAME cell VALUE reward), l AS (SELECT *, starts_with(cell, 'true_') AS t, ends_with(cell, '_advance') AS adv FROM c)
SELECT premise, cell, t::INT AS correctness, adv::INT AS conclusion, (t = (premise = 'main'))::INT AS valence, round(avg(reward), 9) AS reward, count(*)::BIGINT AS n
FROM l GROUP BY ALL""")
def p27(spark, sf):
    """Cells with their three labels; the main premise makes its favourable claim true."""
    r = reasoning_rewards(spark, sf).unpivot(["premise"], list(P.REASONING_CELLS), "cell", "reward")
    per = r.groupBy("premise", "cell").agg(r9(F.avg("reward")).alias("reward"), F.count(F.lit(1)).alias("n"))
    labels = R.reasoning_labels("cell", F.col("premise") == "main")
    return per.select("premise", "cell", *[c.alias(k) for k, c in labels.items()], "reward", "n")


@query("p27_concept_gaps", f"""WITH {SQL_REASONING} SELECT premise, round(avg((true_reject - false_reject + true_advance - false_advance) / 2), 9) AS correctness,
  round(avg((true_advance - true_reject + false_advance - false_reject) / 2), 9) AS conclusion,
  round(avg(CASE WHEN premise = 'main' THEN 1 ELSE -1 END * (true_reject - false_reject + true_advance - false_advance) / 2), 9) AS valence FROM rs GROUP BY premise""")
def p27_gaps(spark, sf):
    """Mean reward of a concept's positive cells minus its matched negative ones."""
    def gap(concept, favourable):
        return sum((F.col(p) - F.col(n) for p, n in R.concept_pairs(concept, favourable)), F.lit(0.0)) / 2

    valence = F.when(F.col("premise") == "main", gap("valence", True)).otherwise(gap("valence", False))
    return reasoning_rewards(spark, sf).groupBy("premise").agg(
        r9(F.avg(gap("correctness", True))).alias("correctness"), r9(F.avg(gap("conclusion", True))).alias("conclusion"), r9(F.avg(valence)).alias("valence"))


@query("u6_nested_prefix", f"""WITH {SQL_RECORDS}, k AS (SELECT record_id, row_number() OVER (ORDER BY sha256('42|' || record_id), record_id) AS rk, count(*) OVER () AS n FROM records),
s AS (SELECT rk, n, d FROM k, (VALUES (2), (4), (8)) t(d) WHERE rk <= ceil(n / d)) SELECT d AS part, count(*)::BIGINT AS size, count(*) FILTER (rk > ceil(n / 2))::BIGINT AS outside FROM s GROUP BY d""")
def u6(spark, sf):
    """Prefixes of one seeded order at a half, a quarter and an eighth: each lies inside the largest."""
    r = hash_rank(records(spark, sf, text=False).select("record_id"), digest(SEED, F.col("record_id")), ["record_id"], [], "rk")
    n = records(spark, sf, text=False).agg(F.count(F.lit(1)).alias("n"))
    r = r.crossJoin(F.broadcast(n))
    largest, out = r.filter(F.col("rk") <= F.ceil(F.col("n") / 2)), None
    for d in (2, 4, 8):
        prefix = r.filter(F.col("rk") <= F.ceil(F.col("n") / d))
        row = prefix.agg(F.lit(d).alias("part"), F.count(F.lit(1)).alias("size")).crossJoin(
            F.broadcast(R.nested(prefix, largest, "record_id").agg(F.count(F.lit(1)).alias("outside"))))
        out = row if out is None else out.unionByName(row)
    return out
