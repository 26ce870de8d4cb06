"""SimHash near-duplicates, candidates by the pigeonring principle.

The 64 bits form a ring of five segments. If two fingerprints differ in at most four bits, some segment starts a
chain whose first l segments differ in at most floor(4 l / 5) bits for every l: none in the first, one in the first
two, and so on. The index key is such a chain's beginning: a segment, and the next one with one bit masked (13 or 12
choices), so two fingerprints share a key exactly if the first two budgets hold for that start. Within a key's
bucket the longer chains are checked next, then the full distance.

Scale: texts are hashed once; only distinct fingerprints are compared, so copies never fill a bucket. A bucket
yields a spanning forest of its links, not its pairs, and each task contracts its buckets' links before they are
shuffled; components settle over the shared folder.

Edge cases: a null or wordless text has fingerprint zero and is linked like any other; fewer words than a shingle
count as one shingle; rows with one id share the smallest id of whatever they link to; a component without any
non-null id has a null component_id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterlens.llm.common import lean, shuffle_partitions, stored
from counterlens.llm.components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))      # (lowest bit, bits)
SMALL = 24                                                        # buckets up to this size are compared all at once


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()      # bytes: ASCII case and white space only
    if not words:
        return 0
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    n = max(1, len(words) - size + 1)
    starts = (ends - lens)[:n].tolist()
    ends = ends[size - 1:].tolist() if len(words) >= size else [int(ends[-1])]
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def chain_keys(fp: np.ndarray) -> np.ndarray:
    """All index keys of each fingerprint: (segment, its bits, the masked bit of the next one, the rest of it)."""
    keys = []
    for i, (low, n) in enumerate(SEGMENTS):
        low2, n2 = SEGMENTS[(i + 1) % len(SEGMENTS)]
        own = (fp >> np.uint64(low)) & np.uint64((1 << n) - 1)
        rest = (fp >> np.uint64(low2)) & np.uint64((1 << n2) - 1)
        for j in range(n2):
            masked = rest & ~np.uint64(1 << j)
            keys.append((own << np.uint64(13) | masked) << np.uint64(8) | np.uint64(i << 4 | j))
    return np.stack(keys, axis=1)


def linked(x: np.ndarray, segment: np.ndarray | int) -> np.ndarray:
    """Whether differences ``x`` keep the chain's budgets from ``segment`` on and the distance as a whole."""
    count = len(SEGMENTS)
    bits = [np.bitwise_count((x >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
    if np.ndim(segment) == 0:
        total, ok = np.zeros(len(x), np.int64), np.ones(len(x), bool)
        for l in range(1, count):
            total += bits[(segment + l - 1) % count]
            ok &= total <= DISTANCE * l // count
    else:
        grid = np.stack(bits)
        total, ok, at = np.zeros(len(x), np.int64), np.ones(len(x), bool), np.arange(len(x))
        for l in range(1, count):
            total += grid[(segment + l - 1) % count, at]
            ok &= total <= DISTANCE * l // count
    ok[ok] &= np.bitwise_count(x[ok]) <= DISTANCE
    return ok


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one edge per node, to the smallest node it reaches here."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def bucket_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside equal keys, as a spanning forest; ``key`` sorted."""
    left, right = [], []
    fresh = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
    size = np.diff(np.append(fresh, len(key)))
    small = np.repeat(size <= SMALL, size)
    segment = ((key >> np.uint64(4)) & np.uint64(15)).astype(np.int64)
    step = 1
    while True:
        same = np.flatnonzero((key[step:] == key[:-step]) & small[step:]) if step < len(key) else np.empty(0, np.int64)
        if not len(same):
            break
        ok = same[linked(fp[same] ^ fp[same + step], segment[same])]
        left.append(fp[ok])
        right.append(fp[ok + step])
        step += 1
    for at, n in zip(fresh[size > SMALL], size[size > SMALL]):
        rest = fp[at:at + n]
        while len(rest):                                     # each fingerprint meets only those not linked yet
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                ok = linked(rest ^ x, int(segment[at]))
                left.append(np.full(int(ok.sum()), x))
                right.append(rest[ok])
                queue.extend(rest[ok])
                rest = rest[~ok]
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


@lean
def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        keys = chain_keys(fp)
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)),
                                          pa.array(np.repeat(fp, keys.shape[1]).view(np.int64))], names=["key", "fp"])


@lean
def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition that holds whole buckets."""
    keys, fps = [], []
    for batch in batches:
        keys.append(batch.column("key").to_numpy().view(np.uint64))
        fps.append(batch.column("fp").to_numpy().view(np.uint64))
    if not keys:
        return
    key, fp = np.concatenate(keys), np.concatenate(fps)
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    shared = np.zeros(len(key), bool)
    shared[1:] |= key[1:] == key[:-1]
    shared[:-1] |= key[1:] == key[:-1]
    a, b = bucket_links(key[shared], fp[shared]) if shared.any() else (np.empty(0, np.uint64),) * 2
    a, b = forest(a.view(np.int64), b.view(np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """a, b: fingerprints of ``distinct`` (stored; fp, each once) within ``DISTANCE`` bits, as spanning forests."""
    keys = distinct.select("fp").mapInArrow(_keys, "key long, fp long")
    return keys.repartition(shuffle_partitions(distinct.sparkSession), "key").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long), component_id; one row per input row."""
    own = stored(fingerprints(docs), "fingerprints")
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = fingerprint_links(distinct)
    roots = stored(components(links), "roots")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    labels = stored(rooted.join(least, "root").select("fp", "component_id"), "labels")
    return own.join(labels, "fp").select("doc_id", "fp", "component_id")
