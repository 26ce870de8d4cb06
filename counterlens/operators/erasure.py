"""Concept erasure and probes: moments on Spark, one small solve on the driver, MLlib probes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterlens.session import cut_lineage

SNAP_RTOL = 1e-4


@dataclass
class AffineEraser:
    """``x - sum_j a_j (b_j . (x - mean))``: after it no linear function of the states predicts the concepts."""

    mean: np.ndarray
    a: np.ndarray
    b: np.ndarray


def fit_eraser(df: DataFrame, vec: str, concept: str) -> AffineEraser:
    """Least-change affine erasure of one or several 0/1 concepts (an array column): project the whitened states off the
    whitened cross-covariance. Moments are reduced in blocks of rows of the Gram matrix (`edits.fold_moments`); the solve is one task's."""
    from counterlens.operators import edits as E

    k = df.select(F.size(concept).alias("k")).first()["k"]
    moments = E.fold_moments(df.withColumn("__f", F.lit(0)), "__f", vec, concept, 1)
    row = E.fold_erasers(moments, "__f", {"all": 0}, k, list(range(k))).filter(F.col("method") == E.AFFINE_CELLS).first()
    mean = np.array(row["mean"])
    return AffineEraser(mean, *(np.array(row[c], float).reshape(-1, len(mean)) for c in ("a", "b")))


def difference_eraser(df: DataFrame, vec: str, label: str) -> AffineEraser:
    """Projection off the difference of class means; the mean plays no part."""
    from counterlens.operators.vectors import difference_of_means

    d = difference_of_means(df.withColumn("__y", F.col(label) == 1), [], "__y", vec).select("direction").first()["direction"]
    size = len(df.select(vec).first()[0])
    u = np.zeros(size) if d is None else np.array(d)
    return AffineEraser(np.zeros(size), u[None], u[None])


def apply_affine(df: DataFrame, vec: str, eraser: AffineEraser, out: str) -> DataFrame:
    """Apply the map batch by batch; its few vectors are the only thing sent to the tasks."""
    mean, a, b = eraser.mean, eraser.a, eraser.b

    @F.pandas_udf("array<double>")
    def erase(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        x = np.stack(v.to_numpy()).astype(float)
        return pd.Series(list(x - ((x - mean) @ b.T) @ a))

    return df.withColumn(out, erase(F.transform(vec, lambda x: x.cast("double"))))


def snapped(train: DataFrame, vec: str, before: str) -> np.ndarray:
    """Features that erasure left constant up to rounding, or that were constant before."""
    def spread(c):
        return train.agg(Summarizer.metrics("std").summary(array_to_vector(F.transform(c, lambda x: x.cast("double")))).alias("s")).first()["s"]["std"].toArray()
    after, ref = spread(vec), spread(before)
    return (after <= SNAP_RTOL * ref) | (ref == 0)


def probe(df: DataFrame, vec: str, label: str, eval_flag: str, hidden: int = 256, seeds: tuple[int, ...] = (0,),
          iterations: int = 200, dead: np.ndarray | None = None) -> DataFrame:
    """Held-out predictions of a linear and a one-hidden-layer probe on standardised features: adds ``lin`` and ``mlp``
    (correct or not) to the evaluation rows. Several seeds vote by majority, so their number is odd."""
    if not seeds or len(seeds) % 2 == 0:
        raise ValueError("an odd number of seeds is needed for a majority vote")
    values = F.transform(vec, lambda x: x.cast("double"))
    if dead is not None and dead.any():
        mask = F.array(*[F.lit(not bool(b)) for b in dead])
        values = F.zip_with(values, mask, lambda x, ok: F.when(ok, x).otherwise(0.0))
    data = df.withColumn("__x", array_to_vector(values)).withColumn("label", F.col(label).cast("double"))
    train, held = data.filter(~F.col(eval_flag)), data.filter(F.col(eval_flag))
    n = train.count()
    scaler = StandardScaler(inputCol="__x", outputCol="features", withMean=True, withStd=True).fit(train)
    tr, ev = scaler.transform(train).persist(), scaler.transform(held)        # read once per training step
    linear = LogisticRegression(maxIter=1000, regParam=1.0 / n, standardization=False).fit(tr)
    out = linear.transform(ev).withColumn("lin", F.col("prediction") == F.col("label")).drop("prediction", "rawPrediction", "probability")
    votes: Column = F.lit(0.0)
    width = tr.select(F.size(vec)).first()[0]
    for s in seeds:
        net = MultilayerPerceptronClassifier(layers=[width, hidden, 2], maxIter=iterations, seed=s, predictionCol=f"__p{s}",
                                             rawPredictionCol=f"__r{s}", probabilityCol=f"__q{s}").fit(tr)
        out = net.transform(out).drop(f"__r{s}", f"__q{s}")
        votes = votes + F.col(f"__p{s}")
    tr.unpersist()
    return out.withColumn("mlp", (votes * 2 > len(seeds)).cast("double") == F.col("label")).drop("__x", "features", "label", *[f"__p{s}" for s in seeds])


def recoverability(items: DataFrame, by: list[str], fit: str, label: str, lin: str = "lin", mlp: str = "mlp") -> DataFrame:
    """Accuracies and chance of pooled fits; chance is each fit's own majority share, weighted by its items."""
    y = F.col(label).cast("boolean")
    per = items.groupBy(*by, fit).agg(F.count(F.lit(1)).alias("n"), F.count_if(y).alias("y"), F.count_if(F.col(lin)).alias("l"), F.count_if(F.col(mlp)).alias("m"))
    n = F.sum("n")
    chance = F.sum(F.greatest(F.col("y"), F.col("n") - F.col("y"))) / n
    a, b = F.sum("l") / n, F.sum("m") / n
    return per.groupBy(*by).agg(a.alias("linear_acc"), b.alias("mlp_acc"), chance.alias("chance"), (a - chance).alias("linear_above_chance"), (b - chance).alias("mlp_above_chance"))


def erasure_items(df: DataFrame, vec: str, label: str, eval_flag: str, method: str, hidden: int = 256, iterations: int = 200,
                  seeds: tuple[int, ...] = (0,)) -> DataFrame:
    """The evaluation rows with both probes' hits under one erasure (``none``, ``diffmean`` or ``affine``), fitted on the training side."""
    train, dead = df.filter(~F.col(eval_flag)), None
    erased = df.withColumn("__e", F.transform(vec, lambda x: x.cast("double")))
    if method != "none":
        eraser = (difference_eraser(train, vec, label) if method == "diffmean"
                  else fit_eraser(train.withColumn("__z", F.array(F.col(label).cast("double"))), vec, "__z"))
        erased = apply_affine(df, vec, eraser, "__e")
        dead = snapped(erased.filter(~F.col(eval_flag)), "__e", vec)
    return probe(erased, "__e", label, eval_flag, hidden, seeds, iterations, dead).drop("__e")


def erasure_rows(df: DataFrame, vec: str, label: str, eval_flag: str, methods: list[str], hidden: int = 256, iterations: int = 200,
                 seeds: tuple[int, ...] = (0,)) -> DataFrame:
    """Recoverability of a concept under each erasure, on one split."""
    rows = [recoverability(erasure_items(df, vec, label, eval_flag, m, hidden, iterations, seeds).withColumn("fit", F.lit(0)), [], "fit", label)
            .withColumn("method", F.lit(m)) for m in methods]
    return reduce(DataFrame.unionByName, rows)


def fold_recoverability(df: DataFrame, vec: str, label: str, fold: str, folds: int, methods: list[str], hidden: int = 256, iterations: int = 200,
                        seeds: tuple[int, ...] = (0,)) -> DataFrame:
    """Recoverability over all folds: each is held out once from the erasure and the probes, and the hits are pooled."""
    items = [cut_lineage(erasure_items(df.withColumn("__held", F.col(fold) == f), vec, label, "__held", m, hidden, iterations, seeds)
                         .select(F.lit(f).alias("fit"), label, "lin", "mlp")).withColumn("method", F.lit(m)) for f in range(folds) for m in methods]
    return recoverability(reduce(DataFrame.unionByName, items), ["method"], "fit", label)


def verdict(none_low: Column, erased_low: Column) -> Column:
    """Reading of the two lower bounds: linear probe before erasure, non-linear probe after it."""
    return (F.when(~F.coalesce(none_low > 0, F.lit(False)), "not decodable without erasure: says nothing")
            .when(erased_low > 0, "non-linearly recoverable after erasure (entangled)").otherwise("not recoverable after erasure (low-complexity)"))


def bag_of_words(train: DataFrame, evaluate: DataFrame, key: str, text: str, pattern: str = "[A-Za-z']+", min_texts: int = 1) -> DataFrame:
    """The binary bag of each text over all words of the training texts: rows (key, word), one per distinct known word,
    a null word where a text has none. The vocabulary is a table as large as it needs to be and meets the words on the
    word; it never passes through the driver."""
    def words(df: DataFrame) -> DataFrame:
        found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))
        return df.select(key, F.explode(found).alias("word"))

    known = words(train).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_texts).select("word")
    held = words(evaluate).join(known, "word")
    return evaluate.select(key).join(held, key, "left")
