"""What several corpus operators share: reading, durable intermediate tables, words and hashes of Arrow text."""

from __future__ import annotations

import ctypes
import functools
import sys
import types
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterlens.session import checkpoint_dir

SPACE_WORD = r"[^\x20\x09-\x0D]+"                      # words: runs without ASCII white space
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"        # after lower-casing: ASCII letters, digits, all non-ASCII
SHARED = 100_000                                       # ids of several rows that are broadcast
CHUNK_BYTES = 4 << 20                                  # text that a task holds in numpy form at once
ROWS = 1_000                                           # rows of whole texts that go to a Python worker at once

_CODES = np.arange(256)
SPACE_KEEP = ~((_CODES == 32) | ((_CODES >= 9) & (_CODES <= 13)))
ALNUM_KEEP = (_CODES >= 128) | ((_CODES >= 48) & (_CODES <= 57)) | ((_CODES >= 97) & (_CODES <= 122))
LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RECORDS: list[list[str]] = []          # of the stages being built, the innermost last


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the shared checkpoint folder and read back: a cut in the lineage that every executor
    can read again after a loss, and a table whose size the optimiser knows."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _RECORDS:
        _RECORDS[-1].append(path)
    return out


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Paths of the tables stored inside, for `remove` once what was built from them has been written."""
    _RECORDS.append([])
    try:
        yield _RECORDS[-1]
    finally:
        _RECORDS.pop()


def remove(spark: SparkSession, tables: list) -> None:
    """Deletes stored tables (or paths) that nothing reads any more."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keyed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``key``: rows equal in id and key are the same document, equal in id and text.

    Only rows without an id, or whose id other rows have too, need a key: 128 bits of the text. The others' is empty. Shared ids are
    broadcast while there are at most ``SHARED``; beyond, every row has a key."""
    ids = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter(F.col("count") > 1).select("doc_id")
    ids = stored(ids, "shared-ids")
    many = ids.limit(SHARED + 1).count() > SHARED
    rows = docs.select("doc_id", "text")
    digest = F.md5(F.coalesce("text", F.lit("")))
    if many:
        return rows.withColumn("key", digest)
    flagged = rows.join(F.broadcast(ids.withColumn("shared", F.lit(True))), "doc_id", "left")
    return flagged.select("doc_id", "text", F.when(F.col("shared") | F.col("doc_id").isNull(), digest).otherwise(F.lit("")).alias("key"))


def ranked(column) -> tuple[np.ndarray, pa.Array]:
    """Rank of each value among the distinct ones, and these in order."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    coded = column.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


class Keys:
    """Numbers for the keys that a task meets; nearly all are empty."""

    def __init__(self):
        self.number = {"": 0}

    def of(self, column: pa.Array) -> np.ndarray:
        if not pc.sum(pc.binary_length(column)).as_py():
            return np.zeros(len(column), np.int64)
        return np.array([self.number.setdefault(k, len(self.number)) for k in column.to_pylist()], np.int64)

    def ranks(self, numbers: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        rank, names = ranked(pa.array(list(self.number), pa.string()))
        return rank[numbers], names


def row_digest(columns: list[str]) -> Column:
    """128 bits of a row's values, null unlike any value."""
    quoted = [F.col(f"`{c}`") for c in columns]
    return F.unhex(F.md5(F.to_json(F.struct(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(quoted)]))))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with signs added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Free memory that this process's allocators keep goes back to the system, as far as they can say so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)             # the GNU C library's
    if trim:
        trim(0)


def worker_cache(owner: str = "") -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks, while they belong to one ``owner``; another
    one starts empty, so that a stage does not hold what an earlier one needed."""
    held = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache"))
    if getattr(held, "owner", None) != owner:
        held.owner, held.cache = owner, {}
        give_back()
    return held.cache


def lean(run, owner: str = ""):
    """Task function ``run`` over batches, which leaves no free memory with its worker: workers outlive their tasks, and what
    one stage took would stay on top of what all later ones need."""
    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        worker_cache(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to the Python workers ``ROWS`` at a time: whole texts are in them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Carried:
    """A broadcast object of this package's classes, unpacked once per worker."""

    def __init__(self, spark: SparkSession, value):
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.name = f"carried-{uuid.uuid4().hex}"

    @property
    def value(self):
        cache = worker_cache(self.name)
        if self.name not in cache:
            cache[self.name] = cloudpickle.loads(self._bytes.value)
        return cache[self.name]


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES):
    """(rows, bytes, offsets) of at most ``limit`` text bytes, or one row; a null text is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column).fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
        at = 0
        while at < len(col):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            stop = min(stop, len(col))
            own = offsets[at:stop + 1]
            yield batch.slice(at, stop - at), data[own[0]:own[-1]], own - own[0]
            at = stop


def word_spans(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray):
    """Start and end byte of every word, and the row it is in; no word crosses two rows."""
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    ok = keep[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(ok)
    before[0] = False
    before[1:] = ok[:-1]
    after = np.empty_like(ok)
    after[-1] = False
    after[:-1] = ok[1:]
    starts = np.flatnonzero(ok & (~before | edge[:-1]))
    ends = np.flatnonzero(ok & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
BYTE_VALUES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(b)) for b in BASES]


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    inside = np.arange(int(lens.sum())) - np.repeat(first, lens)
    values = BYTE_VALUES[which][data[np.repeat(starts, lens) + inside]]
    values *= powers(BASES[which], int(lens.max()))[inside]
    return mix(np.add.reduceat(values, first) + lens.astype(np.uint64))


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hashes of all windows of ``width`` values, by doubling; not yet mixed."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total, size, block, have = None, 1, values, 0
    while True:
        if width & size:
            if total is None:
                total = block
            else:
                m = len(values) - have - size + 1
                total = total[:m] + np.uint64(pow(base, have, 1 << 64)) * block[have:have + m]
            have += size
        if have == width:
            return total
        m = len(values) - 2 * size + 1
        block = block[:m] + np.uint64(pow(base, size, 1 << 64)) * block[size:size + m]
        size *= 2


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of every window of ``width`` values."""
    size, out = 1, values
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return pick(out[:len(out) - rest], out[rest:]) if rest else out
