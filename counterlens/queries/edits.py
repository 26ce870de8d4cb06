"""Erasures with names held out, for every fold at once, and an edit set scored in one pass."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from counterlens.functions import vectors as X
from counterlens.operators import edits as E
from counterlens.operators import vectors as V
from counterlens.queries.base import SEED, r9, sql_h15, table
from counterlens.queries.directions import _CELLS, _DOT, FOLDS, SQL_ROWS, _unit, _values, _without, domain_states
from counterlens.queries.registry import query
from counterlens.queries.vectors import head
from counterlens.session import cut_lineage

# every product of the three factors' signs; one- and two-factor ones are concepts, all seven are what a cell is
SUBSETS = [s for k in (1, 2, 3) for s in itertools.combinations((1, 2, 3), k)]
CONCEPTS = {"x".join(f"s{i}" for i in s): at for at, s in enumerate(SUBSETS) if len(s) < 3}


def _label(signs, subset) -> int:
    product = 1
    for i in subset:
        product *= signs[i - 1]
    return int(product > 0)


_LABELS = [(code, *[_label(signs, s) for s in SUBSETS]) for code, *signs in _CELLS]
_COLUMNS = [f"y{i}" for i in range(len(SUBSETS))]


def named_states(spark, sf):
    """The education domain's proxy states with their seven labels and the fold of their name."""
    st = domain_states(spark, sf).filter("domain = 'education' AND encoding = 'proxy'")
    labels = spark.createDataFrame([(c, [float(y) for y in ys]) for c, *ys in _LABELS], "cell string, z array<double>")
    return st.join(F.broadcast(labels), "cell").select("record_id", "template", "cell", "fit", F.col("nf").alias("fold"), "state", "z")


def fold_erasers(spark, sf):
    st = named_states(spark, sf)
    moments = cut_lineage(E.fold_moments(st.filter("fit"), "fold", "state", "z", FOLDS))
    return st, cut_lineage(E.fold_erasers(E.left_out(moments, "fold"), "fold", CONCEPTS, len(SUBSETS), list(range(len(SUBSETS)))))


SQL_NAMED = f"""{SQL_ROWS}, {_values('lb', 'cell, ' + ', '.join(_COLUMNS), _LABELS)},
ns AS (SELECT record_id, fit, nf AS fold, x, lb.* FROM st JOIN lb USING (cell) WHERE domain = 'education' AND encoding = 'proxy'),
lg AS (UNPIVOT (SELECT record_id, fit, fold, x, {', '.join(f"{_COLUMNS[at]} AS {name}" for name, at in CONCEPTS.items())} FROM ns) ON {', '.join(CONCEPTS)} INTO NAME concept VALUE y),
ff AS (SELECT DISTINCT fold AS f FROM ns WHERE fit),
sm AS (SELECT f, concept, y, pos, avg(v) AS m, count(*) AS n FROM (SELECT f, concept, y, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM lg JOIN ff ON f <> fold WHERE fit) GROUP BY ALL),
dm AS (SELECT f, concept, list(a.m - b.m ORDER BY pos) AS d, list((a.m + b.m) / 2 ORDER BY pos) AS mid, any_value(a.n + b.n) AS n FROM sm a JOIN sm b USING (f, concept, pos) WHERE a.y = 1 AND b.y = 0 GROUP BY f, concept),
du AS (SELECT *, {_unit('d')} AS u FROM dm),
ev AS (SELECT f, concept, n, y, {_DOT}(x, u) > {_DOT}(mid, u) AS up, {_DOT}(x, hd.w) AS r, {_DOT}(x, hd.w) - {_DOT}(x, u) * {_DOT}(hd.w, u) AS r2 FROM lg JOIN du USING (concept) CROSS JOIN hd WHERE NOT fit AND fold = f)"""


@query("v24_erasure_folds", f"""WITH {SQL_NAMED.replace('ev AS (SELECT f', 'evs AS (SELECT f')}, b AS (SELECT f AS fold, concept, n::BIGINT AS n_train, count(*)::BIGINT AS n_eval, round(avg((up = (y = 1))::INT), 9) AS accuracy,
  round(avg(r) FILTER (y = 1) - avg(r) FILTER (y = 0), 9) AS g0, round(avg(r2) FILTER (y = 1) - avg(r2) FILTER (y = 0), 9) AS g1 FROM evs GROUP BY ALL),
l AS (SELECT f AS fold, concept, round(sqrt({_DOT}(d, d)), 6) AS len FROM dm)
SELECT fold::INTEGER AS fold, concept, 'none' AS method, n_train, n_eval, len AS residual, accuracy, g0 AS reward_gap FROM b JOIN l USING (fold, concept)
UNION ALL SELECT fold::INTEGER, concept, 'diffmean', n_train, n_eval, 0.0::DOUBLE, NULL, g1 FROM b
UNION ALL SELECT fold::INTEGER, concept, m, n_train, n_eval, 0.0::DOUBLE, NULL, NULL FROM b, (VALUES ('affine'), ('affine_cells')) t(m)""")
def v24(spark, sf):
    """Every erasure fitted without a fold's names and read on the states that bear them: what is left between the class means of
    the states it was fitted on, how well the midpoint between them tells the held-out states apart (nothing is left to tell
    where they coincide), and the reward gap of the two labels (of projections; the affine ones are in `v24_affine_gaps`)."""
    st, erasers = fold_erasers(spark, sf)
    h = head(spark, sf).first()["weight"]
    place = F.create_map(*[F.lit(v) for name, at in CONCEPTS.items() for v in (name, at)])
    y = lambda: F.element_at("z", F.element_at(place, F.col("concept")) + 1) == 1
    sums = cut_lineage(V.vector_sums(st.filter("fit"), ["fold", "z"], "state"))             # a few cells and folds
    rest = sums.withColumnRenamed("fold", "own").join(F.broadcast(erasers.select("fold", "concept").distinct()), F.col("fold") != F.col("own"))
    whole = V.vector_sums(rest.withColumn("y", y()).select("fold", "concept", "y", "sum_vec", F.col("n").alias("k")), ["fold", "concept", "y"], "sum_vec", out="s").drop("n")
    n = rest.withColumn("y", y()).groupBy("fold", "concept", "y").agg(F.sum("n").alias("k"))
    centres = whole.join(n, ["fold", "concept", "y"]).select("fold", F.col("concept").alias("own"), "y", "k", X.scale("s", 1.0 / F.col("k")).alias("m"))
    erased = E.erased_states(centres, "fold", "m", erasers, ["fold", "own", "y", "k"]).filter("own = concept")
    side = lambda up, tag: erased.filter(F.col("y") == up).select("fold", "concept", "method", F.col("erased").alias(f"m{tag}"), F.col("k").alias(f"k{tag}"))
    both = cut_lineage(side(True, 1).join(side(False, 0), ["fold", "concept", "method"]).withColumn("raw", X.minus("m1", "m0")))
    left = X.norm("raw")
    rules = both.select("fold", "concept", "method", F.round(left, 6).alias("residual"), (F.col("k1") + F.col("k0")).alias("n_train"),
                        F.when(left > 1e-6, X.unit("raw")).alias("u"), X.scale(X.plus("m1", "m0"), 0.5).alias("mid"))
    held = st.filter("not fit").select("fold", "z", "state")
    told = held.join(F.broadcast(rules), "fold").withColumn("y", y())
    right = F.when(F.col("u").isNotNull(), ((X.dot("state", "u") > X.dot("mid", "u")) == F.col("y")).cast("int"))
    told = told.groupBy("fold", "concept", "method", "n_train", "residual").agg(F.count(F.lit(1)).alias("n_eval"), r9(F.avg(right)).alias("accuracy"))
    gaps = E.score_edits(held.withColumn("f", F.col("fold")), ["fold", "z"], "state", E.eraser_edits(erasers.filter("method in ('none', 'diffmean')"), h), h, "f")
    gaps = gaps.select("fold", F.split("edit", r"\|")[0].alias("concept"), F.split("edit", r"\|")[1].alias("method"), "z", "edited").withColumn("y", y())
    gaps = gaps.groupBy("fold", "concept", "method").agg(r9(F.avg(F.when(F.col("y"), F.col("edited"))) - F.avg(F.when(~F.col("y"), F.col("edited")))).alias("reward_gap"))
    return told.join(gaps, ["fold", "concept", "method"], "left").select("fold", "concept", "method", "n_train", "n_eval", "residual", "accuracy", "reward_gap")


@query("v24_affine_gaps", f"""WITH {SQL_NAMED.replace('ev AS (SELECT f', 'evs AS (SELECT f')} SELECT DISTINCT f::INTEGER AS fold, concept, m AS method, true AS unlike_none, true AS finite
  FROM evs, (VALUES ('affine'), ('affine_cells')) t(m)""")
def v24_gaps(spark, sf):
    """The reward gaps under the affine erasures are finite and another number than without one; their values are held against a
    plain refit in the tests."""
    st, erasers = fold_erasers(spark, sf)
    h = head(spark, sf).first()["weight"]
    held = st.filter("not fit").select("fold", F.col("fold").alias("f"), "z", "state")
    s = E.score_edits(held, ["fold", "z"], "state", E.eraser_edits(erasers, h), h, "f")
    place = F.create_map(*[F.lit(v) for name, at in CONCEPTS.items() for v in (name, at)])
    s = s.select("fold", F.split("edit", r"\|")[0].alias("concept"), F.split("edit", r"\|")[1].alias("method"), "z", "edited")
    y = F.element_at("z", F.element_at(place, F.col("concept")) + 1) == 1
    g = s.groupBy("fold", "concept", "method").agg((F.avg(F.when(y, F.col("edited"))) - F.avg(F.when(~y, F.col("edited")))).alias("gap"))
    plain = g.filter("method = 'none'").select("fold", "concept", F.col("gap").alias("plain"))
    g = g.filter("method like 'affine%'").join(plain, ["fold", "concept"])
    return g.select("fold", "concept", "method", (F.abs(F.col("gap") - F.col("plain")) > 1e-9).alias("unlike_none"), (F.abs("gap") < 1e9).alias("finite"))


# ---- an edit set on best-of-four items -----------------------------------------------------------------------------------
DRAWS = 2
SQL_EDITS = f"""e AS (SELECT vec_id, label, [y::DOUBLE for y in embedding] AS x FROM embeddings),
lm AS (SELECT 'low' AS c, label < 5 AS y, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM e UNION ALL SELECT 'even', label % 2 = 0, unnest(x), generate_subscripts(x, 1) FROM e
  UNION ALL SELECT 'head', label = 0, unnest(x), generate_subscripts(x, 1) FROM e WHERE label IN (0, 1)),
dd AS (SELECT c, list(p - q ORDER BY pos) AS d FROM (SELECT c, pos, avg(v) FILTER (y) AS p, avg(v) FILTER (NOT y) AS q FROM lm GROUP BY c, pos) GROUP BY c),
w AS (SELECT d AS w FROM dd WHERE c = 'head'), ud AS (SELECT c, {_unit('d')} AS u FROM dd WHERE c <> 'head'),
rp AS (SELECT d.draw, p.pos FROM range({2 * DRAWS}) d(draw), (SELECT unnest(range(len(w))) AS pos FROM w) p(pos)),
rz AS (SELECT draw, list(sqrt(-2.0::DOUBLE * ln(({sql_h15(f"'{SEED}|u|' || draw || '|' || pos")} % 1000000000 + 1) / 1000000001)) * cos(2 * pi() * (({sql_h15(f"'{SEED}|v|' || draw || '|' || pos")} % 1000000000) / 1000000000)) ORDER BY pos) AS z FROM rp GROUP BY draw),
two AS (SELECT 'joint' AS c, a.u AS u, b.u AS v FROM ud a, ud b WHERE a.c = 'even' AND b.c = 'low' UNION ALL
  SELECT 'random2/' || (a.draw // 2), {_unit('a.z')}, b.z FROM rz a JOIN rz b ON b.draw = a.draw + 1 WHERE a.draw % 2 = 0),
tw AS (SELECT c, u, {_without('v', 'u')} AS r FROM two), tv AS (SELECT c, u, {_unit('r')} AS v FROM tw),
ed AS (SELECT 'none' AS edit, u AS b1, u AS b2, 0.0::DOUBLE AS k1, 0.0::DOUBLE AS k2 FROM ud WHERE c = 'low' UNION ALL SELECT c || '/diffmean', u, u, 1.0::DOUBLE, 0.0::DOUBLE FROM ud
  UNION ALL SELECT 'joint@0.5', u, v, 0.5::DOUBLE, 0.5::DOUBLE FROM tv WHERE c = 'joint' UNION ALL SELECT 'joint@1', u, v, 1.0::DOUBLE, 1.0::DOUBLE FROM tv WHERE c = 'joint'
  UNION ALL SELECT c, u, v, 1.0::DOUBLE, 1.0::DOUBLE FROM tv WHERE c <> 'joint'),
sc AS (SELECT edit, vec_id // 4 AS item, vec_id % 4 AS k, {_DOT}(x, w) AS r, {_DOT}(x, w) - k1 * {_DOT}(x, b1) * {_DOT}(w, b1) - k2 * {_DOT}(x, b2) * {_DOT}(w, b2) AS s FROM e CROSS JOIN w CROSS JOIN ed),
it AS (SELECT edit, item, max(round(s, 9)) FILTER (k = 0) > max(round(s, 9)) FILTER (k > 0) AS won, max(round(r, 9)) FILTER (k = 0) > max(round(r, 9)) FILTER (k > 0) AS was, avg(s - r) AS moved FROM sc GROUP BY ALL HAVING count(*) = 4)"""


@query("v25_edit_set", f"""WITH {SQL_EDITS} SELECT edit, count(*)::BIGINT AS n_items, count(*) FILTER (won)::BIGINT AS n_right, count(*) FILTER (won <> was)::BIGINT AS n_flipped, round(avg(moved), 9) AS moved FROM it GROUP BY edit""")
def v25(spark, sf):
    """Directions, joint subspaces at two strengths and random planes, all scored in one pass; right where the first of four
    completions scores above the others."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", V.doubles("embedding").alias("x"))
    h = head(spark, sf).first()["weight"]
    sides = e.select("x", F.explode(F.array(F.struct(F.lit("low").alias("c"), (F.col("label") < 5).alias("y")),
                                            F.struct(F.lit("even").alias("c"), (F.col("label") % 2 == 0).alias("y")))).alias("s")).select("x", "s.*")
    found = {r["c"]: r["direction"] for r in V.difference_of_means(sides, ["c"], "y", "x").select("c", "direction").collect()}
    edits = [E.projection("none", [], h), *[E.projection(f"{c}/diffmean", [u], h) for c, u in sorted(found.items())],
             *[E.projection(f"joint@{a:g}", list(found.values()), h, a) for a in (0.5, 1.0)],
             *[E.projection(f"random2/{i}", b, h) for i, b in enumerate(E.random_spans(e, 2, DRAWS, len(h), SEED))]]
    rows = e.select(F.floor(F.col("vec_id") / 4).alias("item"), (F.col("vec_id") % 4).alias("k"), "x")
    s = E.score_edits(rows, ["item", "k"], "x", edits, h)
    first = F.col("k") == 0
    best = lambda c, own: F.max(F.when(first if own else ~first, r9(c)))
    it = s.groupBy("edit", "item").agg((best("edited", True) > best("edited", False)).alias("won"), (best("reward", True) > best("reward", False)).alias("was"),
                                       F.avg(F.col("edited") - F.col("reward")).alias("moved"), F.count(F.lit(1)).alias("n")).filter("n = 4")
    return it.groupBy("edit").agg(F.count(F.lit(1)).alias("n_items"), F.count_if("won").alias("n_right"), F.count_if(F.col("won") != F.col("was")).alias("n_flipped"),
                                  r9(F.avg("moved")).alias("moved"))
