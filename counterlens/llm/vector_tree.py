"""Approximate nearest neighbours by inner product, in a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; every vector is then filed in a leaf, those of a leaf in bins of bounded
size. A query descends by a priority queue: it expands the node whose centre has the largest inner product with it,
children join the queue, and leaves come out in the order of their promise. How many leaves to visit is calibrated:
for a sample of queries the exact neighbours are found in all vectors, and the visit is widened until the leaves
visited hold ``recall`` of them; a query goes on beyond that many until its leaves hold ``k`` others. Candidates are scored exactly on the original vectors in double precision.

Scale: fitting and calibration are bounded by ``SAMPLE`` and ``PROBES``; all vectors are indexed and stay in their
bins, queries travel to the bins they visit (a query set of stated size against all rows, in blocks of bounded size on both sides). A vector that
occurs very often spreads over many bins of its leaf. A bin returns at most ``k`` rows per query.

Edge cases: vectors that are null, zero, of another length than most, or hold a null or non-finite component take no
part, nor does a row without an id; equal scores go to the smaller id; rows with one id are separate candidates, but never a query's own id;
fewer candidates than ``k`` are all returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterlens.llm.common import Carried, stored

K = 20
SAMPLE, PROBES = 20_000, 128       # vectors the tree is fitted on; queries the visit is calibrated on
BRANCHES, LEAF = 8, 150            # children of a node; sample vectors in a leaf
BIN, BLOCK = 2_000, 4_000          # vectors in a bin; queries that meet a bin at once
RECALL = 0.96
SLACK = 1e-9                       # blocked products may round differently from the exact score


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the vectors that take part."""
    v = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(
        F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
    size = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.filter(F.size("v") == (size["n"] if size else 0))


class Tree:
    """Centres by node; a node's children are ``child[node]``, a leaf has none and a number of its own."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 5):
        self.centres: list[np.ndarray] = []
        self.child: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self.root = self._grow(sample, sample.mean(axis=0), branches, leaf, rng)
        self.centre = np.stack(self.centres)

    def _grow(self, x, centre, branches, leaf, rng) -> int:
        node = len(self.centres)
        self.centres.append(centre)
        self.child.append([])
        self.leaf.append(-1)
        kinds = np.unique(x, axis=0) if len(x) > leaf else x
        if len(kinds) > leaf:
            centres = kinds[rng.choice(len(kinds), branches, replace=False)]
            for _ in range(12):
                near = self._nearest(x, centres)
                centres = np.stack([x[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(branches)])
            near = self._nearest(x, centres)
            parts = [c for c in range(branches) if (near == c).any()]
            if len(parts) > 1:
                self.child[node] = [self._grow(x[near == c], centres[c], branches, leaf, rng) for c in parts]
                return node
        self.leaf[node] = self.leaves
        self.leaves += 1
        return node

    @staticmethod
    def _nearest(x, centres):
        return ((centres ** 2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)

    def file(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the nearest child at every node."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.child[node]:
                out[rows] = self.leaf[node]
                continue
            near = self._nearest(x[rows], self.centre[self.child[node]])
            todo += [(c, rows[near == i]) for i, c in enumerate(self.child[node]) if (near == i).any()]
        return out

    def best_bins(self, q: np.ndarray, most: int | None = None, sizes: np.ndarray | None = None, need: int = 0):
        """Leaves in best-bin-first order: ``most`` of them, and more until they hold ``need`` vectors."""
        promise = self.centre @ q
        queue, out, held = [(-promise[self.root], self.root)], [], 0
        while queue and (most is None or len(out) < most or held < need):
            _, node = heapq.heappop(queue)
            if self.child[node]:
                for c in self.child[node]:
                    heapq.heappush(queue, (-promise[c], c))
            else:
                out.append(self.leaf[node])
                held += int(sizes[self.leaf[node]]) if sizes is not None else 0
        return out


def _matrix(column) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))


def top(scores: np.ndarray, ids: np.ndarray, own, q: np.ndarray, v: np.ndarray, k: int):
    """Exact (id, score) of the best ``k`` among blocked ``scores``, without the query's own id."""
    other = np.flatnonzero(ids != own)
    s = scores[other]
    if len(s) > k:
        edge = np.partition(s, len(s) - k)[len(s) - k]
        other = other[s >= edge - SLACK * max(1.0, abs(edge))]
    exact = np.einsum("ij,j->i", v[other], q)
    order = np.lexsort((ids[other], -exact))[:k]
    return ids[other][order], exact[order]


def _file(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = held.value.file(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=["vec_id", "v", "leaf"])

    return run


def _visits(held, most: int, sizes: np.ndarray, need: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("q"))
            for at in range(0, len(x), 256):
                part = batch.slice(at, 256)
                leaves = [held.value.best_bins(q, most, sizes, need) for q in x[at:at + 256]]
                n = np.array([len(b) for b in leaves])
                rows = part.take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(leaves), pa.int32())], names=["query_id", "q", "leaf"])

    return run


def _score(k: int):
    """Bins and the queries that visit them meet; one block product per bin."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, v = left.column("vec_id").to_numpy(), _matrix(left.column("v").combine_chunks())
        queries, q = right.column("query_id").to_numpy(), _matrix(right.column("q").combine_chunks())
        out = []
        if len(ids) and len(queries):
            for at in range(0, len(q), 512):
                block = q[at:at + 512] @ v.T
                for i, row in enumerate(block):
                    found, score = top(row, ids, queries[at + i], q[at + i], v, k)
                    out.append((np.full(len(found), queries[at + i]), found, score))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.float64())})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_neighbours(vectors: DataFrame, ids: list[int], queries: np.ndarray, k: int) -> DataFrame:
    """Brute force for a bounded set of queries: every partition's best, then the best of all."""
    held = Carried(vectors.sparkSession, (ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v, names = _matrix(batch.column("v")), batch.column("vec_id").to_numpy()
            out = [(i, *top(row, names, i, x, v, k)) for i, x, row in zip(own, q, q @ v.T)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat([i for i, _, _ in out], [len(f) for _, f, _ in out]), pa.int64()),
                pa.array(np.concatenate([f for _, f, _ in out]), pa.int64()), pa.array(np.concatenate([s for _, _, s in out]), pa.float64())],
                names=["query_id", "vec_id", "score"])

    return _best(vectors.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score double"), k)


def sample_of(vectors: DataFrame, n: int, salt: int) -> tuple[list[int], np.ndarray]:
    """The ``n`` vectors with the smallest hash of their id."""
    rows = vectors.orderBy(F.xxhash64(F.lit(salt), "vec_id"), "vec_id").limit(n).toArrow()
    return rows.column("vec_id").to_pylist(), _matrix(rows.column("v").combine_chunks())


def calibrated_visits(tree: Tree, ids: list[int], queries: np.ndarray, filed: DataFrame, k: int, recall: float) -> int:
    """Leaves to visit so that the exact neighbours of the probes are found at ``recall``."""
    truth = exact_neighbours(filed, ids, queries, k).join(filed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect()
    number = {i: at for at, i in enumerate(ids)}
    order = np.zeros((len(ids), tree.leaves), np.int64)
    for at, q in enumerate(queries):
        order[at, tree.best_bins(q)] = np.arange(tree.leaves)
    needed = np.sort([order[number[r["query_id"]], r["leaf"]] for r in truth])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1 if len(needed) else tree.leaves


def nearest(rows: DataFrame, is_query, k: int = K, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score for the rows for which ``is_query`` holds, against all rows."""
    spark = rows.sparkSession
    vectors = stored(usable(rows).filter(F.col("vec_id").isNotNull()), "vectors")
    ids, sample = sample_of(vectors, SAMPLE, 1)
    if not ids:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = Tree(sample)
    held = Carried(spark, tree)
    filed = vectors.mapInArrow(_file(held), "vec_id long, v array<double>, leaf int")
    filed = stored(filed, "filed")
    probes = filed.filter(is_query)
    most = calibrated_visits(tree, *sample_of(probes, PROBES, 2), filed, k, recall) if probes.limit(1).count() else 1
    sizes = np.zeros(tree.leaves, np.int64)
    for r in filed.groupBy("leaf").count().collect():                                       # one row per leaf of the bounded tree
        sizes[r["leaf"]] = r["count"]
    repeats = filed.groupBy("vec_id").count().agg(F.max("count").alias("n")).first()["n"]
    visits = filed.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).mapInArrow(
        _visits(held, most, sizes, k + repeats), "query_id long, q array<double>, leaf int")
    asked = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    held_by = filed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BIN).cast("int").alias("bins"))
    sizes = stored(held_by.join(asked, "leaf"), "leaf-sizes")                                # one row per leaf
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    bins = filed.join(F.broadcast(sizes), "leaf").select("leaf", deal("vec_id", "bins").alias("bin"), every("blocks").alias("block"), "vec_id", "v")
    visits = visits.join(F.broadcast(sizes), "leaf").select("leaf", every("bins").alias("bin"), deal("query_id", "blocks").alias("block"), "query_id", "q")
    found = bins.groupBy("leaf", "bin", "block").cogroup(visits.groupBy("leaf", "bin", "block")).applyInArrow(
        _score(k), "query_id long, vec_id long, score double")
    return _best(found, k)
