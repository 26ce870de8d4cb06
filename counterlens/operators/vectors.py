"""Directions, projections and head scores on state vectors.

State vectors are by far the widest column, so they are read in as few passes as possible: a contrast is one
weighted vector sum per record whose weights come from a keys-only plan, directions excluding a fold are differences
of group sums, and every nulled score follows from the dot products of one pass (`dots`), for any strength.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterlens.functions import vectors as V
from counterlens.functions.keyed import hash15
from counterlens.operators.design import Design
from counterlens.operators.ranking import null_safe_join
from counterlens.operators.resampling import AT_ONCE, BLOCK, MODULUS, ROUND_KEYS, drawn_places, index_clusters

GS_RTOL = 1e-5
CELLS = 1 << 20                            # numbers of vectors that `coded_sums` adds up at once


def doubles(v) -> Column:
    return F.transform(V.col(v), lambda x: x.cast("double"))


def vector_sums(df: DataFrame, by: list[str], vec: str, weight: str | None = None, out: str = "sum_vec") -> DataFrame:
    """Element-wise sum of (weighted) vectors per group and the row count ``n``. The aggregation buffer is one vector
    per group and task, so a hot group is combined map-side."""
    v = F.transform(F.col(vec), lambda x: x.cast("double") * F.col(weight)) if weight else doubles(vec)
    g = df.groupBy(*by).agg(Summarizer.sum(array_to_vector(v)).alias("__s"), F.count(F.lit(1)).alias("n"))
    return g.select(*by, vector_to_array("__s").alias(out), "n")


def coded_sums(rows: DataFrame, code: str, vec: str, places, groups: int) -> DataFrame:
    """Sums of vectors over ``groups`` numbered groups, in several of which a row may be: rows (grp, sum_vec, n).

    ``places(codes)`` gives, for an array of the integer column ``code``, what is added to each vector (an array of as many rows) and a list of
    (grp, sign) arrays, -1 for none. A task keeps one matrix of all groups, whose number the design fixes, so that rows are neither repeated
    nor sorted with their vectors, and hands on one row per group. Rows without a vector take no part."""
    def partial(batches):
        total = None
        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column("v")))
            if not batch.num_rows:
                continue
            vectors, codes = batch.column("v"), batch.column("code").to_numpy()
            x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(codes), -1)
            if total is None:
                total, count = np.zeros((groups, x.shape[1])), np.zeros(groups, np.int64)
            step = max(1, CELLS // x.shape[1])
            for lo in range(0, len(x), step):
                shift, found = places(codes[lo:lo + step])
                own = x[lo:lo + step] + shift
                for grp, sign in found:
                    order = np.argsort(grp, kind="stable")
                    order = order[np.searchsorted(grp[order], 0):]
                    if len(order):
                        at = grp[order]
                        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                        total[at[first]] += np.add.reduceat(own[order] * sign[order, None], first, axis=0)
                        count[at[first]] += np.diff(np.append(first, len(at)))
        if total is not None:
            some = np.flatnonzero(count)
            offsets = pa.array(np.arange(len(some) + 1) * total.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.ListArray.from_arrays(offsets, pa.array(total[some].reshape(-1))), pa.array(count[some])],
                                             names=["grp", "v", "n"])

    parts = rows.select(F.col(code).cast("long").alias("code"), F.col(vec).alias("v")).mapInArrow(partial, "grp long, v array<double>, n long")
    g = parts.groupBy("grp").agg(Summarizer.sum(array_to_vector("v")).alias("__s"), F.sum("n").alias("n"))
    return g.select("grp", vector_to_array("__s").alias("sum_vec"), "n")


def mean_vectors(df: DataFrame, by: list[str], vec: str, out: str = "mean_vec") -> DataFrame:
    s = vector_sums(df, by, vec)
    return s.select(*by, V.scale("sum_vec", 1.0 / F.col("n")).alias(out), "n")


def difference_of_means(df: DataFrame, by: list[str], positive: str, vec: str) -> DataFrame:
    """Per group: both means, their raw difference and the unit direction (null when degenerate)."""
    m = mean_vectors(df, by + [positive], vec)
    p = m.filter(F.col(positive)).select(*by, F.col("mean_vec").alias("mean_pos"), F.col("n").alias("n_pos"))
    q = m.filter(~F.col(positive)).select(*by, F.col("mean_vec").alias("mean_neg"), F.col("n").alias("n_neg"))
    both = null_safe_join(p, q, by) if by else p.crossJoin(q)
    return both.withColumn("raw", V.minus("mean_pos", "mean_neg")).withColumn("direction", V.unit("raw"))


def direction_fit(df: DataFrame, by: list[str], positive: str, vec: str) -> DataFrame:
    """In-sample statistics of a difference-of-means direction: separation, projection means and SDs per side and
    the accuracy of the midpoint threshold."""
    d = difference_of_means(df, by, positive, vec)
    small = d.select(*by, "direction", "raw", "mean_pos", "mean_neg", "n_pos", "n_neg")
    scored = null_safe_join(df.select(*by, positive, vec), small, by).select(
        *by, positive, V.dot(vec, "direction").alias("p"), V.norm("raw").alias("separation"),
        ((V.dot("mean_pos", "direction") + V.dot("mean_neg", "direction")) / 2).alias("mid"))
    pos = F.col(positive)
    right = F.when(pos, F.col("p") > F.col("mid")).otherwise(F.col("p") <= F.col("mid"))
    return scored.groupBy(*by).agg(
        F.max("separation").alias("separation"), F.avg(F.when(pos, F.col("p"))).alias("mean_pos"),
        F.avg(F.when(~pos, F.col("p"))).alias("mean_neg"), F.stddev_samp(F.when(pos, F.col("p"))).alias("sd_pos"),
        F.stddev_samp(F.when(~pos, F.col("p"))).alias("sd_neg"), F.avg(right.cast("double")).alias("accuracy"))


def contrast_weights(rows: DataFrame, design: Design, encoding: str, axis: str, kind: str) -> DataFrame:
    """Keys-only: the weight of every (record, template, cell, response) row in its record's mean contrast.

    ``prompt``: pole A minus pole B per response; ``interaction``: the approve-minus-decline difference of that;
    ``unfair``: overt minus decline under the same prompt. Incomplete units weigh nothing."""
    spark = rows.sparkSession
    keys = ["record_id", "template", "cell", "response"]
    k = rows.select(*keys)
    if kind == "unfair":
        unit = k.filter(F.col("response").isin("overt", "decline")).select(
            *keys, F.col("cell").alias("unit"), F.when(F.col("response") == "overt", 1.0).otherwise(-1.0).alias("sign"))
        need = 2
    else:
        placed = [(p.a.key, i, 1.0) for i, p in enumerate(design.pairs(axis, encoding))]
        placed += [(p.b.key, i, -1.0) for i, p in enumerate(design.pairs(axis, encoding))]
        grid = F.broadcast(spark.createDataFrame(placed, "cell string, pair int, sign double"))
        j = k.join(grid, "cell")
        if kind == "prompt":
            unit = j.withColumn("unit", F.concat_ws("|", F.col("pair").cast("string"), "response"))
            need = 2
        elif kind == "interaction":
            unit = (j.filter(F.col("response").isin("approve", "decline"))
                    .withColumn("sign", F.when(F.col("response") == "approve", F.col("sign")).otherwise(-F.col("sign")))
                    .withColumn("unit", F.col("pair").cast("string")))
            need = 4
        else:
            raise ValueError(f"kind must be prompt, interaction or unfair, got {kind!r}")
    whole = unit.groupBy("record_id", "template", "unit").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") == need)
    units = whole.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_units"))
    return (unit.join(whole.select("record_id", "template", "unit"), ["record_id", "template", "unit"])
            .groupBy(*keys).agg(F.sum("sign").alias("s")).join(units, "record_id")
            .select(*keys, (F.col("s") / F.col("n_units")).alias("weight")))


def record_contrasts(states: DataFrame, design: Design, encoding: str, axis: str, kind: str = "prompt",
                     vec: str = "state") -> DataFrame:
    """One mean contrast vector per record: (record_id, contrast)."""
    w = contrast_weights(states, design, encoding, axis, kind)
    j = states.join(w, ["record_id", "template", "cell", "response"]).filter(F.col("weight") != 0)
    return vector_sums(j, ["record_id"], vec, "weight", "contrast").drop("n")


def balanced_contrasts(states: DataFrame, axis_sign: Column, response_sign: Column, by: list[str], vec: str = "state"
                       ) -> DataFrame:
    """Contrasts of complete blocks straight from the sign columns: no join, one pass over the states. The weight of a
    row is axis sign x response sign, divided by the number of complete units."""
    w = states.withColumn("__w", (axis_sign * response_sign).cast("double")).filter("__w <> 0")
    s = vector_sums(w, by, vec, "__w", "__sum")
    return s.select(*by, V.scale("__sum", 2.0 / F.col("n")).alias("contrast"))


def record_sums(df: DataFrame, by: list[str], vec: str, weights: dict[str, Column]) -> DataFrame:
    """Several weighted sums of each record's few vectors: rows (by, one column per weight, n). The vectors are gathered once as they are and
    summed in place, so that no sum of doubles per weight is shuffled; nothing moves if rows lie together by (some of) ``by``."""
    g = df.groupBy(*by).agg(F.collect_list(F.struct(*[w.cast("double").alias(k) for k, w in weights.items()], F.col(vec).alias("v"))).alias("__rows"))

    def summed(k: str) -> Column:
        zero = F.transform(F.col("__rows")[0]["v"], lambda x: F.lit(0.0))
        return F.aggregate("__rows", zero, lambda t, r: F.zip_with(t, r["v"], lambda a, x: a + x.cast("double") * r[k]))

    return g.select(*by, *[summed(k).alias(k) for k in weights], F.size("__rows").cast("long").alias("n"))


def axis_contrasts(states: DataFrame, signs: dict[str, Column], response_sign: Column, by: list[str], vec: str = "state",
                   factor: float = 1.0) -> DataFrame:
    """`balanced_contrasts` of several axes from one pass: a record's states are gathered once and summed under every axis's sign.
    Rows (by, contrast, axis)."""
    marked = None
    for s in signs.values():
        marked = (s != 0) if marked is None else marked & (s != 0)
    s = record_sums(states.filter(marked), by, vec, {a: sign * response_sign for a, sign in signs.items()})
    parts = F.array(*[F.struct(V.scale(F.col(a), 2.0 * factor / F.col("n")).alias("contrast"), F.lit(a).alias("axis")) for a in signs])
    return s.select(*by, F.explode(parts).alias("e")).select(*by, "e.contrast", "e.axis")


def cross_fitted(contrasts: DataFrame, by: list[str], fold: str, vec: str = "contrast") -> DataFrame:
    """Per fold the unit direction fitted on the records outside it: (total - fold) / (n - n_fold)."""
    return left_out(vector_sums(contrasts, by + [fold], vec), by, fold)


def left_out(per: DataFrame, by: list[str], fold: str) -> DataFrame:
    """`cross_fitted` from the folds' sums (by, fold, sum_vec, n)."""
    whole = per.groupBy(*by).agg(Summarizer.sum(array_to_vector("sum_vec")).alias("__s"), F.sum("n").alias("all_n"))
    whole = whole.select(*by, vector_to_array("__s").alias("all_vec"), "all_n")
    j = null_safe_join(per, whole, by) if by else per.crossJoin(F.broadcast(whole))
    rest = V.scale(V.minus("all_vec", "sum_vec"), 1.0 / F.when(F.col("all_n") > F.col("n"), F.col("all_n") - F.col("n")))
    return j.select(*by, fold, V.unit(rest).alias("direction"), (F.col("all_n") - F.col("n")).alias("n_fit"))


def excluding(units: DataFrame, by: list[str], fold_set: str, template: str, keys: DataFrame, vec: str = "diff"
              ) -> DataFrame:
    """Directions without some folds and a template, from sums per (fold set, template): the groups that share no
    excluded fold and are of another template are added up. ``keys`` holds (excluded_folds, excluded_template); rows
    (by, keys, direction, n_fit). The group sums are few (fold sets x templates), whatever the number of units."""
    sums = vector_sums(units, by + [fold_set, template], vec)
    pairs = sums.crossJoin(F.broadcast(keys)).filter(
        ~F.arrays_overlap(F.col(fold_set), F.col("excluded_folds"))
        & (F.col("excluded_template").isNull() | (F.col(template) != F.col("excluded_template"))))
    g = by + ["excluded_folds", "excluded_template"]
    fit = pairs.groupBy(*g).agg(Summarizer.sum(array_to_vector("sum_vec")).alias("__s"), F.sum("n").alias("n_fit"))
    return fit.select(*g, V.unit(vector_to_array("__s")).alias("direction"), "n_fit")


def dots(rows: DataFrame, keys: list[str], vec: str, directions: DataFrame, on: list[str] = ()) -> DataFrame:
    """``h.u`` for every row and the directions that apply to it: one pass, after which the states are not needed.
    ``directions``: (direction_id, direction, on...), a few."""
    j = rows.join(directions, list(on)) if on else rows.crossJoin(directions)
    return j.select(*keys, "direction_id", V.dot(vec, "direction").alias("along"))


def head_scores(rows: DataFrame, vec: str, head: DataFrame, bias: float = 0.0, out: str = "reward") -> DataFrame:
    """Linear head ``w.h + b``; ``head`` is one row (weight)."""
    return rows.crossJoin(F.broadcast(head)).withColumn(out, V.dot(vec, "weight") + F.lit(bias)).drop("weight")


def gated_scores(rows: DataFrame, vec: str, gates: str, head: DataFrame, out: str = "reward") -> DataFrame:
    """Gated quantile head: sum over objectives of gate x mean over quantiles of (R h). ``head`` rows (objective,
    quantile, weight); the weights fold into one vector per objective first, and a wrong number of gates fails."""
    mean = mean_vectors(head, ["objective"], "weight").select("objective", F.col("mean_vec").alias("w"))
    packed = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("objective", "w"))), lambda s: s.w).alias("__rows"))
    j = rows.crossJoin(F.broadcast(packed))
    total = F.aggregate(F.zip_with(F.col("__rows"), F.col(gates), lambda r, g: V.dot(r, F.col(vec)) * g), F.lit(0.0), lambda a, x: a + x)
    bad = F.size(gates) != F.size("__rows")
    return j.withColumn(out, F.when(bad, F.raise_error(F.lit("one gate per objective is needed")).cast("double")).otherwise(total)
                        ).drop("__rows")


def nulled(scored: DataFrame, reward: str, along: str, head_along: str, alpha: Column) -> Column:
    """Score after removing a share ``alpha`` of a unit direction: ``r - alpha (h.u)(w.u)``; linear in alpha, so a
    sweep needs no second projection."""
    return F.col(reward) - alpha * F.coalesce(F.col(along) * F.col(head_along), F.lit(0.0))


def orthonormal_span(vectors: list[np.ndarray]) -> np.ndarray:
    """Orthonormal rows that span a few collected directions: the right singular vectors of their unit rows, without
    those whose singular value is rounding. Zero vectors add nothing."""
    rows = np.array([np.asarray(v, float) / np.linalg.norm(v) for v in vectors if np.linalg.norm(v) > V.TINY])
    if not len(rows):
        return rows
    _, size, right = np.linalg.svd(rows, full_matrices=False)
    return right[size > GS_RTOL * size.max()]


def basis_frame(directions: DataFrame, name: str = "basis") -> DataFrame:
    """Orthonormal rows (direction_id, k, direction) of a table of at most a few dozen directions."""
    rows = directions.select("direction_id", "direction").filter(F.col("direction").isNotNull()).orderBy("direction_id").collect()
    basis = orthonormal_span([np.array(r["direction"]) for r in rows])
    return directions.sparkSession.createDataFrame(
        [(name, k, [float(x) for x in b]) for k, b in enumerate(basis)], "direction_id string, k int, direction array<double>")


def outside_span(vec, basis: np.ndarray) -> Column:
    """Share of a vector's norm outside the span of an orthonormal basis."""
    inside = F.lit(0.0)
    for b in basis:
        d = V.dot(vec, F.array(*[F.lit(float(x)) for x in b]))
        inside = inside + d * d
    n2 = V.dot(vec, vec)
    return F.sqrt(F.greatest(1.0 - inside / F.when(n2 > 0, n2), F.lit(0.0)))


def random_units(df: DataFrame, draws: int, dim: int, seed: int) -> DataFrame:
    """Seeded random unit vectors (draw, direction) from hashed normals; a few draws of one dimension."""
    u1 = (F.pmod(hash15(seed, "u", F.col("draw"), F.col("pos")), F.lit(10**9)) + 1) / F.lit(1e9 + 1)
    u2 = F.pmod(hash15(seed, "v", F.col("draw"), F.col("pos")), F.lit(10**9)) / F.lit(1e9)
    z = F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * np.pi * u2)
    spark = df.sparkSession
    g = spark.range(draws).withColumnRenamed("id", "draw").withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))))
    v = g.withColumn("z", z).groupBy("draw").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "z"))), lambda s: s.z).alias("v"))
    return v.select("draw", V.unit("v").alias("direction"))


def split_half_cosine(contrasts: DataFrame, key: str, repeats: int, seed: int, by: list[str] = ()) -> DataFrame:
    """Mean cosine between directions fitted on two hashed halves of the records; null below four records.

    Halves are equal by rank within each repeat."""
    from counterlens.functions.keyed import digest
    from counterlens.operators.ranking import hash_rank

    by = list(by)
    reps = F.broadcast(contrasts.sparkSession.range(repeats).withColumnRenamed("id", "repeat"))
    ranked = hash_rank(contrasts.select(*by, key).crossJoin(reps), digest(seed, "split_half", F.col("repeat"), F.col(key)),
                       [key], by + ["repeat"], "half_rank")
    n = contrasts.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    ranked = (null_safe_join(ranked, F.broadcast(n), by) if by else ranked.crossJoin(F.broadcast(n)))
    half = ranked.withColumn("first", F.col("half_rank") <= F.floor(F.col("__n") / 2)).drop("half_rank")
    j = half.join(contrasts, by + [key])
    m = vector_sums(j, by + ["repeat", "first"], "contrast")
    a = m.filter("first").select(*by, "repeat", F.col("sum_vec").alias("a"))
    b = m.filter("not first").select(*by, "repeat", F.col("sum_vec").alias("b"))
    cos = a.join(b, by + ["repeat"]).select(*by, V.cosine("a", "b").alias("c"))
    out = cos.groupBy(*by).agg(F.avg("c").alias("split_half"))
    return (null_safe_join(out, n, by) if by else out.crossJoin(n)).select(
        *by, F.when(F.col("__n") >= 4, F.col("split_half")).alias("split_half"), F.col("__n").alias("n_records"))


def replicate_means(vectors: DataFrame, key: str, vec: str, replicates: int, seed: int) -> DataFrame:
    """The mean vector of every bootstrap replicate over records: (b, mean_vec). Draw ``j`` of replicate ``b`` is the same function of
    (seed, b, j) for any number of records. Records and draws meet by blocks of ranks; a block is one matrix product for each run of replicates."""
    ranked = index_clusters(vectors.select(key, doubles(vec).alias("v")), key, [])
    blocks = ranked.select(F.expr(f"idx div {BLOCK}").alias("__block"), F.expr(f"cast(idx % {BLOCK} as int)").alias("place"), "v")
    draws = drawn_places(vectors.agg(F.count(F.lit(1)).alias("n")), replicates, seed)

    def partial(records: pa.Table, drawn: pa.Table) -> pa.Table:
        if not len(records) or not len(drawn):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.list_(pa.float64()), pa.float64())], names=["b", "v", "n"])
        at = records.column("place").to_numpy()
        m = np.empty((len(at), len(records.column("v")[0])))
        m[at] = records.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(m.shape)
        b, places = drawn.column("b").to_numpy(), drawn.column("places").to_pylist()
        sums, counts = [], []
        for lo in range(0, len(b), AT_ONCE):
            own = places[lo:lo + AT_ONCE]
            flat = np.frombuffer(b"".join(own), np.uint16) + np.repeat(np.arange(len(own)) * len(m), [len(x) // 2 for x in own])
            w = np.bincount(flat, minlength=len(own) * len(m)).reshape(len(own), len(m)).astype(float)
            sums.append(w @ m)
            counts.append(w.sum(axis=1))
        sums = np.concatenate(sums)
        offsets = pa.array(np.arange(len(b) + 1) * sums.shape[1], pa.int32())
        return pa.table([pa.array(b), pa.ListArray.from_arrays(offsets, pa.array(sums.reshape(-1))), pa.array(np.concatenate(counts))], names=["b", "v", "n"])

    parts = blocks.groupBy("__block").cogroup(draws.groupBy("__block")).applyInArrow(partial, "b long, v array<double>, n double")
    g = parts.groupBy("b").agg(Summarizer.sum(array_to_vector("v")).alias("__m"), F.sum("n").alias("n"))
    return g.select("b", V.scale(vector_to_array("__m"), 1.0 / F.col("n")).alias("mean_vec"))


def flip_norms(vectors: DataFrame, key: str, vec: str, flips: int, seed: int, block: int = 500) -> DataFrame:
    """``|sum_i s_i v_i|^2`` for every sign flip: rows (flip, norm2).

    Each task multiplies its block of records by their signs and emits one partial vector per flip; the partial sums
    meet per flip. Signs are counter-based on (flip, record index), so the result does not depend on the layout, and
    the work grows linearly with the records."""
    indexed = index_clusters(vectors.select(key, vec), key, []).select("idx", doubles(vec).alias("v"))

    def partial(batches):
        def mix(x):
            x = x % MODULUS
            x2 = (x * x) % MODULUS
            return ((x2 * x2) % MODULUS) * x % MODULUS

        total = None
        for pdf in batches:
            if not len(pdf):
                continue
            m = np.stack(pdf["v"].to_numpy())
            idx = pdf["idx"].to_numpy(np.int64)[None, :]
            if total is None:
                total = np.zeros((flips, m.shape[1]))
            for lo in range(0, flips, block):
                f = np.arange(lo, min(lo + block, flips), dtype=np.int64)[:, None]
                x = mix(np.int64(seed % MODULUS) + ROUND_KEYS[0] + f)
                x = mix(mix(x + ROUND_KEYS[1] + idx) + ROUND_KEYS[2])
                total[lo:lo + f.shape[0]] += np.where(x % 2 == 0, 1.0, -1.0) @ m
        if total is not None:
            for lo in range(0, flips, block):
                hi = min(lo + block, flips)
                yield pd.DataFrame({"flip": np.arange(lo, hi, dtype=np.int64), "v": list(total[lo:hi])})

    parts = indexed.mapInPandas(partial, "flip long, v array<double>")
    s = parts.groupBy("flip").agg(Summarizer.sum(array_to_vector("v")).alias("s")).select("flip", vector_to_array("s").alias("v"))
    return s.select("flip", V.dot("v", "v").alias("norm2"))


def dimension_variances(df: DataFrame, vec: str) -> DataFrame:
    """Sum over dimensions of the sample variance, and the mean vector: one row (total_variance, mean_vec, n)."""
    v = array_to_vector(doubles(vec))
    g = df.agg(Summarizer.metrics("mean", "variance", "count").summary(v).alias("m"))
    return g.select(V.total(vector_to_array("m.variance")).alias("total_variance"),
                    vector_to_array("m.mean").alias("mean_vec"), F.col("m.count").alias("n"))
