"""Directions applied to rows they were not fitted on: every source against every target, held out per row.

A direction belongs to a *source* (domain, encoding, axis) and is the mean of its contrast units. A target row is read
with directions fitted without the name folds of its pair and, for one kind of reading, without its template. What a
reading takes out of a row may rest on several directions; all of it is arithmetic on the row's dot products with them,
so a state is read once per target it serves, whatever the number of readings:

    reward after = h.w - sum_i c_i (h.u_i),   c = pinv(U U^T) (U w)

for the span of the unit rows U, and ``c_i = (m.w) / |sum u|`` for the unit mean m. The coefficients are worked out once per
(target, hold-out key), in tables whose size the design fixes: sources x fold sets x templates, never the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterlens.functions import vectors as X
from counterlens.operators import vectors as V
from counterlens.operators.design import INTERSECTION
from counterlens.operators.relations import relation

EACH, MEAN, SPAN = "each", "mean", "span"
KEY = ["target", "key_folds", "key_template"]
PLAN = ["target", "reading", "relation", "mode", "source", "hold_folds", "hold_template"]


def source_name(s: str = "s") -> Column:
    return F.concat_ws("/", f"{s}.domain", f"{s}.encoding", f"{s}.axis")


def unit_sums(units: DataFrame, vec: str = "diff") -> DataFrame:
    """Contrast units (source, name_folds, template, vector) as group sums: a fit without folds or a template adds up the
    groups that are left."""
    return V.vector_sums(units, ["source", "name_folds", "template"], vec)


def reading_plan(sources: DataFrame, sums: DataFrame, draws: int = 0) -> DataFrame:
    """Which fits each target is read with: PLAN columns, one row per fit of a reading.

    A reading is one source; ``own_seen`` (its own direction with its names seen); ``template`` (its template left out too);
    ``others`` (the mean of the same contrast in other domains, where there are two or more); ``singles_joint`` (for a corner:
    the single axes of its domain together, in its encoding or else the explicit one); or a random draw."""
    named = F.max((F.size("name_folds") > 0).cast("int")) == 1
    have = sums.groupBy("source").agg(named.alias("named"), (F.countDistinct("template") > 1).alias("many"))
    s = sources.select(F.struct("*").alias("s")).withColumn("source", source_name()).join(have, "source")
    t = s.select(F.col("s").alias("t"), F.col("source").alias("target"), F.col("named").alias("t_named"), F.col("many").alias("t_many"))
    grid = t.crossJoin(F.broadcast(s.select("s", "source")))

    def rows(df, reading, rel, mode, folds=True, template=False):
        return df.select("target", reading.alias("reading"), rel.alias("relation"), F.lit(mode).alias("mode"), "source",
                         F.lit(folds).alias("hold_folds"), F.lit(template).alias("hold_template"))

    def special(df, name, mode, folds=True, template=False):
        return rows(df, F.lit(name), F.lit(name), mode, folds, template)

    own = grid.filter("source = target")
    same = (F.size(F.array_except("s.flips", "t.flips")) == 0) & (F.size(F.array_except("t.flips", "s.flips")) == 0)
    others = grid.filter((F.col("s.domain") != F.col("t.domain")) & (F.col("s.encoding") == F.col("t.encoding")) & same)
    several = others.groupBy("target").count().filter("count > 1").select("target")
    singles = grid.filter((F.col("t.axis") == INTERSECTION) & (F.col("s.domain") == F.col("t.domain")) & (F.col("s.axis") != INTERSECTION)
                          & ((F.col("s.encoding") == F.col("t.encoding")) | (F.col("s.encoding") == "explicit")))
    best = singles.groupBy("target", F.col("s.axis").alias("axis")).agg(
        F.max(F.struct((F.col("s.encoding") == F.col("t.encoding")).alias("near"), "source")).alias("b")).select("target", "b.source")
    plan = rows(grid, F.col("source"), relation(), EACH)
    plan = plan.unionByName(special(own.filter("t_named"), "own_seen", EACH, folds=False))
    plan = plan.unionByName(special(own.filter("t_many"), "template", EACH, template=True))
    plan = plan.unionByName(special(others.join(several, "target", "left_semi"), "others", MEAN))
    plan = plan.unionByName(special(best, "singles_joint", SPAN))
    if draws:
        name = F.concat(F.lit("random"), F.col("id").cast("string"))
        drawn = t.select("target").crossJoin(F.broadcast(sources.sparkSession.range(draws))).withColumn("source", name)
        plan = plan.unionByName(rows(drawn, F.col("source"), F.lit("random"), EACH, folds=False))
    return plan


def hold_out_keys(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY).distinct()


def fitted(plan: DataFrame, keys: DataFrame, sums: DataFrame, randoms: DataFrame | None = None) -> DataFrame:
    """PLAN and KEY columns with each fit's ``direction`` (null: no separation) and ``n_fit``. A fit that is left without any unit is an
    error. ``randoms``: (source, direction) of the draws."""
    wanted = plan.join(keys, "target").withColumns({
        "ex_folds": F.when(F.col("hold_folds"), F.col("key_folds")).otherwise(F.array().cast("array<int>")),
        "ex_template": F.when(F.col("hold_template"), F.col("key_template"))})
    wanted = wanted.withColumn("ask", F.to_json(F.struct("source", "ex_folds", "ex_template")))
    drawn = wanted.filter("relation = 'random'")
    fits = wanted.filter("relation <> 'random'")
    asked = fits.select("ask", "source", "ex_folds", "ex_template").distinct()
    left = asked.join(sums, "source").filter(
        ~F.arrays_overlap("name_folds", "ex_folds") & (F.col("ex_template").isNull() | (F.col("template") != F.col("ex_template"))))
    found = left.groupBy("ask").agg(Summarizer.sum(array_to_vector("sum_vec")).alias("whole"), F.sum("n").alias("n_fit"))
    found = found.select("ask", X.unit(X.scale(vector_to_array("whole"), 1.0 / F.col("n_fit"))).alias("direction"), "n_fit")
    joined = fits.join(found, "ask", "left")
    nothing = F.raise_error(F.concat(F.lit("no unit left to fit "), F.col("source"))).cast("long")
    out = joined.select(*PLAN, *KEY[1:], "direction", F.coalesce("n_fit", nothing).alias("n_fit"))
    if randoms is not None:
        out = out.unionByName(drawn.join(F.broadcast(randoms), "source").select(*PLAN, *KEY[1:], "direction", F.lit(None).cast("long").alias("n_fit")))
    return out


def _solve(members: list, head: np.ndarray, mode: str) -> list[float]:
    """What each member's dot product with a state takes from its reward; a member without a direction takes nothing."""
    live = [i for i, m in enumerate(members) if m is not None]
    out = np.zeros(len(members))
    if live:
        u = np.array([members[i] for i in live], float)
        if mode == MEAN:
            whole = u.sum(axis=0)
            size = np.linalg.norm(whole)
            if size / len(live) >= X.TINY:
                out[live] = (whole / size) @ head / size
        else:
            out[live] = np.linalg.pinv(u @ u.T, rcond=V.GS_RTOL ** 2, hermitian=True) @ (u @ head)
    return out.tolist()


def _coefficients(head: np.ndarray):
    def run(frames):
        import pandas as pd

        for pdf in frames:
            yield pd.DataFrame({**{c: pdf[c] for c in ("hold", *KEY, "reading", "relation", "n_fit_min")},
                                "at": pdf["at"], "c": [_solve(list(d), head, m) for d, m in zip(pdf["members"], pdf["mode"])]})

    return run


def key_tables(fits: DataFrame, head: list[float]) -> DataFrame:
    """One row per KEY: ``directions`` (array of the distinct ones that its readings rest on) and ``readings`` (array of
    reading, relation, n_fit, the places ``at`` of its directions and their coefficients ``c``)."""
    member = F.struct("source", "hold_folds", "hold_template")
    held = fits.withColumn("hold", F.to_json(F.struct(*KEY))).withColumn("m", member)
    distinct = held.groupBy("hold", "m").agg(F.first("direction").alias("direction"))
    packed = distinct.groupBy("hold").agg(F.array_sort(F.collect_list(F.struct("m", "direction"))).alias("d"))
    packed = packed.select("hold", F.col("d.m").alias("members"), F.col("d.direction").alias("directions"))
    each = held.join(packed.select("hold", "members"), "hold").withColumn("place", (F.array_position("members", F.col("m")) - 1).cast("int"))
    per = each.groupBy("hold", *KEY, "reading", "relation", "mode").agg(
        F.array_sort(F.collect_list(F.struct("place", "direction"))).alias("p"), F.min("n_fit").alias("n_fit_min"))
    per = per.select("hold", *KEY, "reading", "relation", "mode", "n_fit_min", F.col("p.place").alias("at"), F.col("p.direction").alias("members"))
    solved = per.mapInPandas(_coefficients(np.array(head, float)),
                             "hold string, target string, key_folds array<int>, key_template string, reading string, relation string, n_fit_min long, "
                             "at array<int>, c array<double>")
    read = solved.groupBy("hold", *KEY).agg(F.collect_list(F.struct("reading", "relation", F.col("n_fit_min").alias("n_fit"), "at", "c")).alias("readings"))
    return packed.select("hold", "directions").join(read, "hold").drop("hold")


def read_rows(rows: DataFrame, tables: DataFrame, head: list[float], keep: list[str], vec: str = "state") -> DataFrame:
    """``keep`` columns of every target row once per reading: reading, relation, n_fit, ``reward`` and ``after`` (its reward
    without what the reading takes out). ``tables`` is fixed by the design and broadcast."""
    weight = F.array(*[F.lit(float(x)) for x in head])
    small = F.broadcast(tables.select(F.col("target").alias("t_"), F.col("key_folds").alias("f_"), F.col("key_template").alias("k_"), "directions", "readings"))
    j = rows.join(small, (F.col("target") == F.col("t_")) & (F.col("key_folds") == F.col("f_")) & F.col("key_template").eqNullSafe(F.col("k_")))
    along = F.transform("directions", lambda u: F.coalesce(X.dot(vec, u), F.lit(0.0)))
    scored = j.select(*keep, "readings", X.dot(vec, weight).alias("reward"), along.alias("along"))
    removed = X.total(F.zip_with(F.col("r.at"), F.col("r.c"), lambda i, c: F.element_at("along", i + 1) * c))
    return scored.withColumn("r", F.explode("readings")).select(
        *keep, "r.reading", "r.relation", "r.n_fit", "reward", (F.col("reward") - removed).alias("after"))


def along(rows: DataFrame, vec: str, head: list[float], directions: DataFrame) -> DataFrame:
    """``rows`` without their vectors: ``reward`` and, for each of a few unit ``directions`` (draw, direction; in their order) alone, what
    taking it out takes ``off``."""
    weight = F.array(*[F.lit(float(x)) for x in head])
    few = directions.select("draw", "direction", X.dot(weight, "direction").alias("carried"))
    few = few.agg(F.array_sort(F.collect_list(F.struct("draw", "direction", "carried"))).alias("__u"))
    off = F.transform("__u", lambda u: F.coalesce(X.dot(vec, u["direction"]) * u["carried"], F.lit(0.0)))
    return rows.crossJoin(F.broadcast(few)).withColumn("reward", X.dot(vec, weight)).withColumn("off", off).drop(vec, "__u")


def transfer_effects(read: DataFrame, weight: str) -> DataFrame:
    """Per record, target and reading: the effect (``weight`` sums rewards to a mean pair difference) before and after."""
    w = F.col(weight)
    return read.groupBy("target", "reading", "relation", "record_id").agg(
        F.sum(w * F.col("reward")).alias("effect"), F.sum(w * F.col("after")).alias("after"), F.min("n_fit").alias("n_fit_min"), F.max("n_fit").alias("n_fit_max"))


def _reading_arrays(tables: DataFrame, head: np.ndarray):
    """`key_tables` as arrays: (its number per KEY, the readings (reading, relation) per target, ``weights`` and ``n_fit`` per number). A key's weights
    have the head in the first column and for each reading what is left of the head, so that a reward after is one dot product with the state."""
    rows = tables.collect()
    named = {r["target"]: sorted((x["reading"], x["relation"]) for x in r["readings"]) for r in rows}
    most = max(map(len, named.values()), default=0)
    weights, n_fit = np.zeros((len(rows), len(head), most + 1)), np.zeros((len(rows), most), np.int64)
    for k, r in enumerate(rows):
        u = np.array([np.zeros(len(head)) if d is None else d for d in r["directions"]], float)
        weights[k, :, 0] = head
        for x in r["readings"]:
            i = named[r["target"]].index((x["reading"], x["relation"]))
            weights[k, :, i + 1] = head - np.array(x["c"], float) @ u[x["at"]]
            n_fit[k, i] = -1 if x["n_fit"] is None else x["n_fit"]
    return {(r["target"], tuple(r["key_folds"]), r["key_template"]): k for k, r in enumerate(rows)}, named, weights, n_fit


def _whole_records(batches):
    """Batches sorted by ``record`` as tables that hold all rows of their records."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        column = rows.column("record")
        new = np.flatnonzero(pc.not_equal(column[1:], column[:-1]).to_numpy())
        end = int(new[-1]) + 1 if len(new) else 0
        if end:
            yield rows.slice(0, end)
        rest = rows.slice(end)
    if rest is not None:
        yield rest


def effect_sums(rows: DataFrame, record: str, code: str, vec: str, shifts: np.ndarray, pairs: list[tuple], folds, fold_sets: list[list[int]],
                tables: DataFrame, head: list[float]) -> DataFrame:
    """`transfer_effects` summed over records: rows (target, reading, relation, n, n_fit_min, n_fit_max) with the sums of ``effect``, ``after``, their
    sizes ``abs_effect`` and ``abs_after`` and the ``change`` of size.

    ``rows``: a text each, those of a record in one partition; ``code`` has its place in the lowest seven bits, and ``shifts`` by place what is added to
    its vector. ``pairs``: (target, template, place of pole A, of pole B, weight), a target's side by side; a pair of several texts at a place counts
    once for each two of them, without a text at one of its places not at all. ``folds(codes)`` numbers the ``fold_sets`` of all pairs, from
    codes at their pole A (records x pairs). Tasks hold a few records at once and hand on one row per target and reading."""
    number, named, weights, n_fit = _reading_arrays(tables, np.array(head, float))
    a, b = (np.array([p[k] for p in pairs]) for k in (2, 3))
    w, each = np.array([p[4] for p in pairs]), np.arange(len(pairs))
    keys = np.array([[number.get((p[0], tuple(f), p[1]), -1) for f in fold_sets] for p in pairs])
    first = np.array([i for i, p in enumerate(pairs) if not i or p[0] != pairs[i - 1][0]])
    targets, places, dim = [pairs[i][0] for i in first], len(shifts), len(head)
    step = max(1, V.CELLS // (len(pairs) * dim))

    def effects(at, codes, x):
        """Of a few records: (records x targets x reading, whether a target has pairs, the keys in use); ``at``: record and place as one number."""
        size = (int(at[-1]) // places + 1) * places
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(at[order])))
        states, held = np.zeros((size, dim)), np.zeros(size, np.int64)
        states[at[order][starts]] = np.add.reduceat(x[order], starts, axis=0)
        held[at] = codes
        states, held, many = states.reshape(-1, places, dim), held.reshape(-1, places), np.bincount(at, minlength=size).reshape(-1, places).astype(float)
        diff = states[:, a] * (many[:, b] * w)[:, :, None]
        diff -= states[:, b] * (many[:, a] * w)[:, :, None]
        key = np.where(many[:, a] * many[:, b] > 0, keys[each, folds(held[:, a])], -1)
        diff, flat = diff.reshape(-1, dim), key.reshape(-1)
        order = np.argsort(flat, kind="stable")
        starts = np.append(np.searchsorted(flat[order], np.arange(len(weights))), len(flat))
        out = np.zeros((len(flat), weights.shape[2]))
        for k in np.flatnonzero(np.diff(starts)):
            own = order[starts[k]:starts[k + 1]]
            out[own] = diff[own] @ weights[k]
        return np.add.reduceat(out.reshape(*key.shape, -1), first, axis=1), np.logical_or.reduceat(key >= 0, first, axis=1), np.flatnonzero(np.diff(starts))

    def partial(batches):
        sums, n, used = np.zeros((5, len(targets), weights.shape[2] - 1)), np.zeros(len(targets), np.int64), np.zeros(len(weights), bool)
        for table in _whole_records(batches):
            table = table.combine_chunks()
            column, codes, vectors = table.column("record"), table.column("code").to_numpy(), table.column("v").combine_chunks()
            one = np.append(0, np.cumsum(pc.not_equal(column[1:], column[:-1]).to_numpy()))
            some = pc.is_valid(vectors).to_numpy(zero_copy_only=False)
            x = np.zeros((len(codes), dim))
            x[some] = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) + shifts[codes[some] & 127]
            ends = np.searchsorted(one, np.arange(0, one[-1] + 1 + step, step))
            for lo, hi in zip(ends, ends[1:]):
                found, has, now = effects((one[lo:hi] - one[lo]) * places + (codes[lo:hi] & 127), codes[lo:hi], x[lo:hi])
                effect, after = found[:, :, :1], found[:, :, 1:]
                gap, left = np.abs(effect), np.abs(after)
                for total, part in zip(sums, (effect, after, gap, left, left - gap)):
                    total += part.sum(axis=0)
                n += has.sum(axis=0)
                used[now] = True
        out = []
        for t, name in enumerate(targets):
            if n[t]:
                of = n_fit[[k for (target, _, _), k in number.items() if target == name and used[k]]]
                fits = zip(*(np.where(x < 0, None, x) for x in (of.min(axis=0), of.max(axis=0))))
                out += [(name, *names, int(n[t]), *fit, *sums[:, t, i].tolist()) for i, (names, fit) in enumerate(zip(named[name], fits))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, of) for c, of in zip(zip(*out), [pa.string()] * 3 + [pa.int64()] * 3 + [pa.float64()] * 5)], names=columns)

    totals = ["effect", "after", "abs_effect", "abs_after", "change"]
    columns = ["target", "reading", "relation", "n", "n_fit_min", "n_fit_max", *totals]
    lain = rows.select(F.col(record).alias("record"), F.col(code).cast("long").alias("code"), F.col(vec).alias("v")).sortWithinPartitions("record")
    parts = lain.mapInArrow(partial, "target string, reading string, relation string, n long, n_fit_min long, n_fit_max long, " + ", ".join(f"{c} double" for c in totals))
    return parts.groupBy("target", "reading", "relation").agg(
        F.sum("n").alias("n"), F.min("n_fit_min").alias("n_fit_min"), F.max("n_fit_max").alias("n_fit_max"), *[F.sum(c).alias(c) for c in totals])
