"""Edits of states as few vectors, scored in one pass; erasures fitted for every fold from one set of moments.

Whatever an edit takes out of a state, ``x - sum_j a_j (b_j . (x - mean))``, a linear head sees only the dot products with
the ``b_j``: the rows of all edits are stacked, a batch of states is multiplied with them once, and every edit's score is a
combination of the columns. Directions and joint subspaces (``a_j = alpha b_j``, orthonormal), erasure maps and random subspaces are
all edits, and the states are read once however many there are.

Moments are gathered per fold in blocks of rows of the Gram matrix; what a fold's fit rests on is the total minus the fold,
so no state is read again for another fold, concept or method. A reducer holds one block (``BLOCK`` x d), a task
``TASK_BYTES`` of blocks, in several passes where the matrices of all folds are larger.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from counterlens.functions import vectors as X
from counterlens.operators import vectors as V

BLOCK, TASK_BYTES = 256, 128 << 20
NONE, DIFFMEAN, AFFINE, AFFINE_CELLS = "none", "diffmean", "affine", "affine_cells"
METHODS = (NONE, DIFFMEAN, AFFINE, AFFINE_CELLS)


@dataclass(frozen=True)
class Edit:
    """What a linear head loses: ``sum_j c_j (b_j . x) - shift``."""

    name: str
    rows: np.ndarray
    c: np.ndarray
    shift: float = 0.0


def projection(name: str, vectors, head, alpha: float = 1.0) -> Edit:
    """Share ``alpha`` of the span of ``vectors`` taken out."""
    basis = V.orthonormal_span([np.asarray(v, float) for v in vectors]).reshape(-1, len(head))
    return Edit(name, basis, alpha * (basis @ np.asarray(head, float)))


def erasure(name: str, mean, a, b, head) -> Edit:
    """``x - sum_j a_j (b_j . (x - mean))``; ``a`` and ``b`` have one row per j."""
    a, b = (np.asarray(m, float).reshape(-1, len(head)) for m in (a, b))
    c = a @ np.asarray(head, float)
    return Edit(name, b, c, float(c @ (b @ np.asarray(mean, float))))


def random_spans(df: DataFrame, k: int, draws: int, dim: int, seed: int) -> list[np.ndarray]:
    """``draws`` seeded random k-dimensional subspaces, as vectors that span them."""
    rows = V.random_units(df, draws * k, dim, seed).orderBy("draw").collect()
    return [np.array([r["direction"] for r in rows[i * k:(i + 1) * k]]) for i in range(draws)]


def score_edits(rows: DataFrame, keep: list[str], vec: str, edits: list[Edit] | dict, head, by: str | None = None) -> DataFrame:
    """``keep`` columns of every row once per edit: edit, ``reward`` and ``edited``. With ``by``, ``edits`` maps each value of that
    column to its edits (the same names for each); a row of a value without edits is left out. The edits travel with the tasks:
    their number and width are the caller's, not the data's."""
    head = np.asarray(head, float)
    groups = edits if by else {None: edits}
    names = [e.name for e in next(iter(groups.values()))]
    packed = {}
    for key, own in groups.items():
        if [e.name for e in own] != names:
            raise ValueError("every group needs the same edits in the same order")
        owner = np.repeat(np.arange(len(own)), [len(e.rows) for e in own])
        combine = np.zeros((len(owner), len(own)))
        combine[np.arange(len(owner)), owner] = np.concatenate([e.c for e in own]) if len(owner) else []
        stack = np.concatenate([e.rows.reshape(-1, len(head)) for e in own])
        packed[key] = stack.T, combine, np.array([e.shift for e in own])
    held = rows.sparkSession.sparkContext.broadcast(packed)
    wide = rows.select(*keep, *([F.col(by).alias("by_")] if by else []), V.doubles(vec).alias("x_"))
    schema = StructType([wide.schema[c] for c in keep] + [StructField("reward", DoubleType()), StructField("scores_", ArrayType(DoubleType()))])

    def run(frames):
        for pdf in frames:
            for key, own in pdf.groupby("by_") if by else [(None, pdf)]:
                if key in held.value and len(own):
                    stack, combine, shift = held.value[key]
                    x = np.stack(own["x_"].to_numpy())
                    base = x @ head
                    out = own[keep].copy()
                    out["reward"] = base
                    out["scores_"] = list(base[:, None] - (x @ stack) @ combine + shift)
                    yield out

    scored = wide.mapInPandas(run, schema)
    label = F.array(*[F.lit(n) for n in names])
    return scored.select(*keep, "reward", F.posexplode("scores_").alias("at_", "edited")).select(
        *keep, F.element_at(label, F.col("at_") + 1).alias("edit"), "reward", "edited")


# ---- moments, all folds at once ------------------------------------------------------------------------------------------
def fold_moments(df: DataFrame, fold: str, vec: str, labels: str, folds: int) -> DataFrame:
    """Per (fold, part): ``v``, sums over the fold's rows. Part -1 is n, the sums of x and of the 0/1 ``labels`` and their cross
    products; part i the rows ``BLOCK * i`` and on of x'x."""
    first = df.select(F.size(vec).alias("d"), F.size(labels).alias("c")).first()
    if first is None:
        return df.sparkSession.createDataFrame([], f"{fold} int, part int, v array<double>")
    d = first["d"]
    parts = -(-d // BLOCK)
    per_pass = max(1, TASK_BYTES // (8 * d * BLOCK * max(folds, 1)))
    rows = df.select(F.col(fold).cast("int").alias("fold"), V.doubles(vec).alias("x"), F.transform(labels, lambda z: z.cast("double")).alias("z"))

    def gathered(low: int, high: int):
        def run(frames):
            held: dict[tuple[int, int], np.ndarray] = {}
            for pdf in frames:
                for f, own in pdf.groupby("fold"):
                    x = np.stack(own["x"].to_numpy())
                    found = {i: (x[:, i * BLOCK:(i + 1) * BLOCK].T @ x).ravel() for i in range(low, high)}
                    if not low:
                        z = np.stack(own["z"].to_numpy())
                        found[-1] = np.concatenate([[len(x)], x.sum(0), z.sum(0), (x.T @ z).ravel()])
                    for i, v in found.items():
                        held[f, i] = held[f, i] + v if (f, i) in held else v
            for (f, i), v in held.items():
                yield pd.DataFrame({"fold": [f], "part": [i], "v": [v]})
        return run

    found = None
    for low in range(0, parts, per_pass):
        one = rows.mapInPandas(gathered(low, min(low + per_pass, parts)), "fold int, part int, v array<double>")
        found = one if found is None else found.unionByName(one)
    return found.groupBy("fold", "part").agg(Summarizer.sum(array_to_vector("v")).alias("s")).select(
        F.col("fold").alias(fold), "part", vector_to_array("s").alias("v"))


def left_out(moments: DataFrame, fold: str) -> DataFrame:
    """The moments without each fold: total minus fold. A part that a fold lacks is the total."""
    total = moments.groupBy("part").agg(Summarizer.sum(array_to_vector("v")).alias("s")).select("part", vector_to_array("s").alias("t"))
    grid = total.crossJoin(F.broadcast(moments.select(fold).distinct()))
    own = grid.join(moments, [fold, "part"], "left")
    return own.select(fold, "part", F.when(F.col("v").isNull(), F.col("t")).otherwise(X.minus("t", "v")).alias("v"))


def _assembled(pdf: pd.DataFrame, c: int):
    by = {int(i): np.asarray(v, float) for i, v in zip(pdf["part"], pdf["v"])}
    side = by.pop(-1)
    d = (len(side) - 1 - c) // (1 + c)
    sx, sz, xz = side[1:1 + d], side[1 + d:1 + d + c], side[1 + d + c:].reshape(d, c)
    return side[0], sx, sz, xz, np.concatenate([by[i].reshape(-1, d) for i in sorted(by)])


def _affine(n, sx, sz, xz, values, q) -> tuple[np.ndarray, np.ndarray]:
    """Rows a and b of the least-change erasure: the whitened cross-covariance's directions, coloured and whitened."""
    keep = values > values.max() * 1e-9
    root = np.sqrt(values[keep])
    whiten, colour = (q[:, keep] / root) @ q[:, keep].T, (q[:, keep] * root) @ q[:, keep].T
    cross = xz / n - np.outer(sx / n, sz / n)
    u, s, _ = np.linalg.svd(whiten @ cross, full_matrices=False)
    u = u[:, s > max(s.max(), 1e-30) * 1e-6]
    return (colour @ u).T, (whiten @ u).T


def fold_erasers(moments: DataFrame, fold: str, concepts: dict[str, int], columns: int, cells: list[int]) -> DataFrame:
    """Per fold, concept and method: ``mean``, rows ``a`` and ``b`` of the erasure, from moments (usually `left_out`). ``concepts``:
    name -> its place among the label columns; ``cells``: the places that `AFFINE_CELLS` erases together (one fit per fold, given
    under every concept)."""
    out = "fold int, concept string, method string, n double, mean array<double>, a array<array<double>>, b array<array<double>>"

    def solve(pdf):
        n, sx, sz, xz, xx = _assembled(pdf, columns)
        mean = sx / n
        values, q = np.linalg.eigh((xx + xx.T) / (2 * n) - np.outer(mean, mean))
        joint = _affine(n, sx, sz[cells], xz[:, cells], values, q)
        rows = []
        for name, at in concepts.items():
            rows.append((name, NONE, np.zeros((0, len(sx))), np.zeros((0, len(sx)))))
            diff = xz[:, at] / sz[at] - (sx - xz[:, at]) / (n - sz[at]) if 0 < sz[at] < n else np.zeros(len(sx))
            size = np.linalg.norm(diff)
            u = (diff / size)[None] if size >= X.TINY else np.zeros((0, len(sx)))
            rows.append((name, DIFFMEAN, u, u))
            rows.append((name, AFFINE, *_affine(n, sx, sz[[at]], xz[:, [at]], values, q)))
            rows.append((name, AFFINE_CELLS, *joint))
        zero = np.zeros(len(sx))
        return pd.DataFrame({"fold": int(pdf["fold"].iloc[0]), "concept": [r[0] for r in rows], "method": [r[1] for r in rows], "n": n,
                             "mean": [zero if r[1] == DIFFMEAN else mean for r in rows], "a": [r[2].tolist() for r in rows], "b": [r[3].tolist() for r in rows]})

    return moments.select(F.col(fold).cast("int").alias("fold"), "part", "v").groupBy("fold").applyInPandas(solve, out)


def eraser_edits(erasers: DataFrame, head) -> dict[int, list[Edit]]:
    """Erasers of every fold as edits named ``concept|method``: folds x concepts x methods x at most their columns vectors."""
    found: dict[int, list[Edit]] = {}
    for r in erasers.orderBy("fold", "concept", "method").collect():
        found.setdefault(r["fold"], []).append(erasure(f"{r['concept']}|{r['method']}", r["mean"], r["a"], r["b"], head))
    return found


def erased_states(rows: DataFrame, fold: str, vec: str, erasers: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``erased`` of each row of a fold under that fold's erasers (concept, method)."""
    small = F.broadcast(erasers.select(F.col("fold").alias("f_"), "concept", "method", "mean", "a", "b"))
    j = rows.join(small, F.col(fold) == F.col("f_"))
    centred = X.minus(vec, "mean")
    along = F.transform("b", lambda b: X.dot(b, F.col("c_")))
    off = F.aggregate(F.zip_with("a", "l_", lambda a, s: F.transform(a, lambda y: y * s)), F.transform("c_", lambda _: F.lit(0.0)), lambda t, v: X.plus(t, v))
    j = j.withColumn("c_", centred).withColumn("l_", along).withColumn("o_", off)
    return j.select(*keep, "concept", "method", X.minus(vec, "o_").alias("erased"))
