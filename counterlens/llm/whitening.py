"""Embedding whitening with MLlib's distributed block matrices.

Entries are quantised to ``floor(256 * c)``. The moments are those of the distinct quantised vectors: their rows get
dense indices, are centred and become a BlockMatrix; its transpose times itself is the scatter matrix, whose
eigenvectors are found on the driver (d x d numbers, d being the width of a vector). All rows, copies too, become a
second BlockMatrix, and its product with the whitening matrix holds every row's components. The covariance of the
whitened distinct vectors, measured the same way, tells how far it is from the identity.

Scale: the scatter product splits the rows (``multiply`` with several splits of the middle dimension), so that no task
meets more than some ``SPLIT`` blocks of a block column, and adds products of one block column squared. Indices come
from each partition's own count and a table of one row per partition. Copies of one vector merge in partial
aggregates; no join is keyed by a vector, so one that is very common is nothing special. Rows are read again from
written tables if executors are lost. The driver holds block coordinates (MLlib's own), d sums and d x d numbers.

Edge cases: rows whose vector is null, empty or holds a null or non-finite entry go, and vectors of another length than
most (ties: the shorter); rows that share an id or have none stay rows of their own; components beyond the rank
(eigenvalue below rounding) have null ``whitened``, and ``explained`` is null where the trace is 0; fewer dimensions than
components give as many as there are; an empty table gives an empty result; other columns are ignored. Entries beyond
the range of a long saturate; sums and deviations are exact, deviations of more than 38 digits are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterlens.llm.common import stored

GRID = 256                         # steps of one unit
ROWS, COLUMNS = 1024, 1024         # of a block
SPLIT = 8                          # blocks of a column that one task multiplies
SCHEMA = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, "
          "identity_error double")


def quantised(rows: DataFrame, grid: int = GRID) -> DataFrame:
    """vec_id, x (longs) of the rows that take part."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    v = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    v = v.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
    size = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    v = v.filter(F.size("v") == (size["n"] if size else 0))
    return v.select("vec_id", F.transform("v", lambda c: F.floor(c * float(grid))).alias("x"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` stored, with a dense ``idx`` from 0: a row's place in its partition plus the rows of those before."""
    kept = stored(rows.withColumn("mark", F.monotonically_increasing_id()), name)
    part = F.shiftright("mark", 33)
    sizes = kept.groupBy(part.alias("part")).count()
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    placed = kept.join(offsets, part == F.col("part"))
    return placed.withColumn("idx", F.col("offset") + F.col("mark").bitwiseAND((1 << 33) - 1)).drop("mark", "part", "offset")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task and dimension: the exact sum as text."""
    total = None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"))
            own = x.sum(axis=0) if np.abs(x).max() < (1 << 62) // len(x) else x.astype(object).sum(axis=0)
            total = own.astype(object) if total is None else total + own.astype(object)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array([str(t) for t in total])], names=["at", "s"])


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def moments(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and their exact sums by dimension."""
    n = fit.count()
    sums = fit.select("x").mapInArrow(_sums, "at int, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return n, [int(r["s"]) for r in sums.orderBy("at").collect()]


def _centred(n: int, sums: list[int], keep: tuple[str, ...]):
    """``keep`` columns, the centred vector x - S/n (from the exact n*x - S), and the exact sum of squares of n*x - S."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = max((abs(s) for s in sums), default=0)
        for batch in batches:
            x = _matrix(batch.column("x")) if batch.num_rows else np.zeros((0, len(sums)), np.int64)
            most = n * int(np.abs(x.astype(float)).max(initial=0)) + big
            exact = most < 1 << 62
            diff = n * x - np.array(sums, np.int64) if exact else n * x.astype(object) - np.array(sums, object)
            if exact and most * most * max(len(sums), 1) < 1 << 62:
                squares = (diff * diff).sum(axis=1).tolist()
            else:
                squares = (diff.astype(object) ** 2).sum(axis=1).tolist()
            squares = [str(s) if len(str(s)) <= 38 else None for s in squares]
            flat = pa.array((diff / n).astype(float).ravel() if len(x) else np.zeros(0))
            offsets = pa.array(np.arange(len(x) + 1) * len(sums), pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.ListArray.from_arrays(offsets, flat),
                                              pa.array(squares, pa.string())], names=[*keep, "v", "deviation"])

    return run


def blocks(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """``rows``: idx (dense), v (array of doubles)."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col("idx").alias("index"), array_to_vector("v").alias("vector")), "vector")
    matrix = callMLlibFunc("createIndexedRowMatrix", vectors, n, width)         # rows stay in the JVM
    return IndexedRowMatrix(matrix, n, width).toBlockMatrix(ROWS, min(COLUMNS, width))


def product(a: BlockMatrix, b: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """``a`` times ``b``; the dimension they share is cut into ``splits``, each multiplied in tasks of its own."""
    found = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(found, a.rowsPerBlock, b.colsPerBlock)


def gram(a: BlockMatrix, n: int) -> np.ndarray:
    """Transpose of ``a`` times ``a``, over ``n`` rows."""
    splits = max(1, -(-n // (ROWS * SPLIT)))
    return product(a.transpose(), a, splits).toLocalMatrix().toArray()


def whiten(rows: DataFrame, components: int = 4, grid: int = GRID) -> DataFrame:
    """``rows``: vec_id, embedding. vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    all_rows = numbered(quantised(rows, grid), "quantised")
    fit = numbered(all_rows.select("x").distinct(), "distinct")
    n, sums = moments(fit)
    if not n:
        return spark.createDataFrame([], SCHEMA)
    width, total = len(sums), all_rows.count()
    k = min(components, width)
    centre = lambda df, *keep: df.select(*keep, "x").mapInArrow(
        _centred(n, sums, keep), ", ".join([*(f"{c} long" for c in keep), "v array<double>", "deviation string"]))
    points = blocks(centre(fit, "idx"), n, width)
    scatter = gram(points, n) / n
    e, v = np.linalg.eigh((scatter + scatter.T) / 2)
    e, v = e[::-1], v[:, ::-1]
    v = v * np.where(np.take_along_axis(v, np.abs(v).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    solid = e[:k] > max(e[0], 0) * width * np.finfo(float).eps * 8
    w = v[:, :k] * np.where(solid, 1 / np.sqrt(np.where(solid, e[:k], 1.0)), 0.0)
    cell = min(COLUMNS, width)
    pieces = [((i, 0), DenseMatrix(len(w[a:a + cell]), k, w[a:a + cell].ravel(order="F")))
              for i, a in enumerate(range(0, width, cell))]
    whitening = BlockMatrix(spark.sparkContext.parallelize(pieces, len(pieces)), cell, k, width, k)

    own = gram(product(points, whitening), n) / n
    error = float(np.abs(own - np.eye(k))[np.ix_(solid, solid)].max()) if solid.any() else None
    centred_rows = stored(centre(all_rows, "idx", "vec_id"), "centred")
    placed = product(blocks(centred_rows, total, width), whitening).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", placed._java_matrix_wrapper._java_model)
    found = MLUtils.convertVectorColumnsToML(found, "vector").select(
        F.col("index").alias("idx"), vector_to_array("vector").alias("z"))
    trace = float(np.trace(scatter))
    facts = [(i + 1, bool(solid[i]), float(e[i]) / trace if trace > 0 else None) for i in range(k)]
    facts = F.array(*[F.struct(F.lit(c).alias("component"), F.lit(s).alias("solid"), F.lit(x).cast("double").alias("explained"))
                      for c, s, x in facts])
    both = centred_rows.select("idx", "vec_id", F.col("deviation").cast("decimal(38,0)").alias("deviation")).join(found, "idx")
    each = both.withColumn("f", F.explode(facts))
    return each.select("vec_id", "f.component", F.lit(n).cast("long").alias("n"), "deviation",
                       F.when(F.col("f.solid"), F.element_at("z", F.col("f.component"))).alias("whitened"),
                       "f.explained", F.lit(error).cast("double").alias("identity_error"))
