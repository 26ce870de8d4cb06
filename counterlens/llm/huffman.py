"""Token ids on disk in a canonical, length-limited Huffman code.

Global id counts give code lengths (package-merge, at most ``limit`` bits), lengths give canonical codes. A
document's code starts at a byte; every ``STEP`` ids a checkpoint keeps the bit offset. Files hold independent
blocks of consecutive documents in ascending id order; the code book (lengths only) is a file of its own. Reading
is table-driven: the next ``limit`` bits index symbol and length, and all checkpoints of a block are decoded side
by side.

Scale: ids are encoded once and kept as a written table; documents are coded before they are range-partitioned by
id, so the shuffle carries compressed bits. The driver sees one count per id of the vocabulary and one length;
positions follow from one total per file.

Edge cases: null and empty texts hold only the end id; rows with one id stay separate rows, ordered by their ids'
checksum; rows without an id come first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from counterlens.llm.common import give_back, lean, remove, short_batches, shuffle_partitions, stored, text_chunks
from counterlens.llm.tokens import encoder
from counterlens.session import checkpoint_dir

STEP = 512                   # ids between two checkpoints
BLOCK_BYTES = 1 << 20        # coded bytes of a block, or one document
GROUP = 1 << 21              # ids decoded side by side
CHUNK = 2 << 20              # text bytes encoded at once

BLOCKS = ("file int, block int, first long, doc_ids array<long>, counts array<long>, offsets array<long>, "
          "checkpoints array<long>, payload binary")


# ---- the code ------------------------------------------------------------------------------------------------
def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for the ids with a count; 0 for the others."""
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(ids) <= 1:
        out[ids] = 1
        return out
    if len(ids) > 1 << limit:
        raise ValueError(f"{len(ids)} ids do not fit codes of {limit} bits")
    order = ids[np.argsort(counts[ids], kind="stable")]
    leaves = counts[order].astype(np.int64)
    level, flags = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = level[:len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, pairs])
        at = np.argsort(merged, kind="stable")
        level = merged[at]
        flags.append(at < len(leaves))
    need, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for leaf in reversed(flags):
        own = int(leaf[:need].sum())
        lengths[:own] += 1
        need = 2 * (need - own)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes counted up by (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    code, last = 0, 0
    for i in order[int((lengths == 0).sum()):]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length for every pattern of the longest length's bits."""
    width = max(int(lengths.max(initial=0)), 1)
    order = np.lexsort((np.arange(len(lengths)), lengths))[int((lengths == 0).sum()):]
    spans = np.left_shift(1, width - lengths[order].astype(np.int64))
    short = (1 << width) - int(spans.sum())
    return (np.append(np.repeat(order, spans), np.zeros(short, np.int64)).astype(np.uint32),
            np.append(np.repeat(lengths[order], spans), np.ones(short, np.uint8)).astype(np.int64), width)


def pack(ids: np.ndarray, counts: np.ndarray, codes: np.ndarray, lengths: np.ndarray):
    """Coded bytes of several documents, their byte offsets, and the checkpoints of each (bits from its start)."""
    width = lengths[ids].astype(np.int64)
    ends = np.cumsum(width)
    last = np.concatenate([[0], np.cumsum(counts)])
    bits = np.concatenate([[0], ends])[last]
    size = (np.diff(bits) + 7) // 8
    offsets = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = ends - width - bits[owner]
    at = inside + 8 * offsets[owner]
    shifted = codes[ids] << (64 - (at & 31) - width).astype(np.uint64)
    words = int(offsets[-1] + 7) // 4 + 2
    high = np.bincount(at >> 5, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=words)
    low = np.bincount((at >> 5) + 1, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)
    payload = (high.astype(np.uint64) + low.astype(np.uint64)).astype(">u4").tobytes()[:int(offsets[-1])]
    step = (np.arange(len(ids)) - last[owner]) % STEP == 0
    marks = np.split(inside[step], np.cumsum(-(-counts // STEP))[:-1])
    return payload, offsets, marks


def unpack(payload: bytes, starts: np.ndarray, counts: np.ndarray, book) -> np.ndarray:
    """Ids of parts that begin at bit ``starts`` and hold ``counts`` ids each (at most STEP), side by side."""
    symbols, lengths, width = book
    raw = np.frombuffer(payload + bytes(12), np.uint8)
    words = (np.lib.stride_tricks.sliding_window_view(raw, 8))
    out = np.zeros((STEP, len(starts)), np.uint32)
    order = np.argsort(-counts, kind="stable")
    at, left = starts[order].copy(), counts[order]
    for k in range(int(counts.max(initial=0))):
        live = int(np.searchsorted(-left, -k, "left"))      # parts with more than k ids
        own = at[:live]
        eight = words[own >> 3].view(">u8").reshape(-1).astype(np.uint64)
        code = ((eight << (own & 7).astype(np.uint64)) >> np.uint64(64 - width)).astype(np.int64)
        out[k, :live] = symbols[code]
        at[:live] += lengths[code]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    rows = out.T[back]
    return rows[np.arange(STEP) < counts[:, None]]


# ---- Spark ---------------------------------------------------------------------------------------------------
def _encode(spec: str, end_id: int):
    """Task function: a row per document, and one last row (``n`` = -1) with the task's count of every id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(spec)
        total = np.zeros(max(known.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1), np.int64)
        wide = len(total) > 1 << 16

        def rows(doc_ids, n, parts):
            return pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int64()), pa.array(parts, pa.binary())], names=["doc_id", "n", "ids"])

        for batch, data, offsets in text_chunks(batches, limit=CHUNK):
            ids, counts = known.encode(data, offsets)
            total += np.bincount(ids, minlength=len(total))
            total[end_id] += len(counts)
            last = np.cumsum(counts)
            ids = np.insert(ids, last, end_id)
            raw, size = ids.astype("<u4" if wide else "<u2").tobytes(), 4 if wide else 2
            ends = (last + np.arange(1, len(last) + 1)) * size
            yield rows(batch.column("doc_id"), counts + 1, [raw[a:b] for a, b in zip(ends - (counts + 1) * size, ends)])
            give_back()                              # known pieces grow in between, so that what a chunk frees is not used again
        yield rows(pa.array([None], pa.int64()), [-1], [total.astype("<i8").tobytes()])

    return lean(run, "tokens")


def _ids_of(batch: pa.RecordBatch):
    """(rows, ids, counts) groups of a stored batch."""
    n = batch.column("n").to_numpy()
    at = 0
    while at < len(n):
        stop = max(at + 1, at + int(np.searchsorted(np.cumsum(n[at:]), GROUP, "right")))
        raw = [v.as_py() for v in batch.column("ids").slice(at, stop - at)]
        kind = "<u2" if sum(map(len, raw)) == 2 * int(n[at:stop].sum()) else "<u4"
        yield batch.slice(at, stop - at), np.frombuffer(b"".join(raw), kind), n[at:stop]
        at = stop


@lean
def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the tasks' counts, as (id, n) rows."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for own in batch.column("ids"):
            own = np.frombuffer(own.as_py(), "<i8")
            total = np.pad(total, (0, max(0, len(own) - len(total)))) + np.pad(own, (0, max(0, len(total) - len(own))))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])


def _code(lengths: np.ndarray):
    codes = canonical_codes(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, ids, counts in _ids_of(batch):
                payload, offsets, marks = pack(ids, counts, codes, lengths)
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[e - c:e].astype("<u4").tobytes()) for e, c in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id"), pa.array(crc, pa.int64()), rows.column("n"),
                    pa.array(list(marks), pa.list_(pa.int64())),
                    pa.array([payload[a:b] for a, b in zip(offsets, offsets[1:])], pa.binary())],
                    names=["doc_id", "crc", "n", "checkpoints", "bits"])

    return lean(run)


@lean
def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs a partition's sorted documents into blocks; the partition's number is the file's."""
    from pyspark import TaskContext

    file, block, first = TaskContext.get().partitionId(), 0, 0
    held: list[tuple] = []
    size = 0

    def done():
        bits = [h[3] for h in held]
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in bits])[:-1]]).astype(np.int64)
        marks = [m + 8 * o for (_, _, m, _), o in zip(held, offsets)]
        return pa.RecordBatch.from_arrays([
            pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([[h[0] for h in held]], pa.list_(pa.int64())),
            pa.array([[h[1] for h in held]], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())),
            pa.array([np.concatenate(marks)], pa.list_(pa.int64())), pa.array([b"".join(bits)], pa.binary())],
            names=["file", "block", "first", "doc_ids", "counts", "offsets", "checkpoints", "payload"])

    for batch in batches:
        for i, n, m, b in zip(batch.column("doc_id"), batch.column("n"), batch.column("checkpoints"), batch.column("bits")):
            held.append((i.as_py(), n.as_py(), m.values.to_numpy(), b.as_py()))
            size += len(held[-1][3])
            if size >= BLOCK_BYTES:
                yield done()
                first += sum(h[1] for h in held)
                held, size, block = [], 0, block + 1
    if held:
        yield done()


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int, limit: int = 18) -> None:
    """Encodes every text and writes blocks and code book under ``path``."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    with short_batches(spark):
        ids = stored(docs.select("doc_id", "text").mapInArrow(_encode(spec, end_id), "doc_id long, n long, ids binary"), "ids")
    found = (ids.filter("n < 0").select("ids").mapInArrow(_count_ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
             .collect())                                     # one row per id of the vocabulary
    counts = np.zeros(max([end_id, *(r["id"] for r in found)]) + 1, np.int64)
    counts[[r["id"] for r in found]] = [r["n"] for r in found]
    lengths = code_lengths(counts, max(limit, int(np.count_nonzero(counts)).bit_length()))       # room for every id that occurs
    coded = ids.filter("n >= 0").mapInArrow(_code(lengths), "doc_id long, crc long, n long, checkpoints array<long>, bits binary")
    (coded.repartitionByRange(shuffle_partitions(spark), "doc_id", "crc").sortWithinPartitions("doc_id", "crc")
     .mapInArrow(_blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks"))
    spark.range(1, numPartitions=1).select(F.lit(bytearray(lengths.tobytes())).alias("lengths")).write.parquet(f"{path}/book")
    remove(spark, [ids])


def _decode(lengths: np.ndarray, with_ids: bool):
    book = decode_table(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts = batch.column("counts")[i].values.to_numpy()
                marks = batch.column("checkpoints")[i].values.to_numpy()
                payload = batch.column("payload")[i].as_py()
                parts = -(-counts // STEP)
                sizes = np.full(len(marks), STEP)
                sizes[np.cumsum(parts) - 1] = counts - (parts - 1) * STEP
                every = [unpack(payload, marks[a:a + GROUP // STEP], sizes[a:a + GROUP // STEP], book)
                         for a in range(0, len(marks), GROUP // STEP)]
                ids = np.concatenate(every).astype("<u4")
                ends = np.cumsum(counts)
                raw = [ids[e - c:e].tobytes() for e, c in zip(ends, counts)]
                at = batch.column("first")[i].as_py() + ends - counts
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(counts), batch.column("file")[i].as_py()), pa.int32()), batch.column("doc_ids")[i].values,
                    pa.array(at, pa.int64()), pa.array(counts, pa.int64()),
                    pa.array(raw, pa.binary()) if with_ids else pa.array([zlib.crc32(r) for r in raw], pa.int64())],
                    names=["file", "doc_id", "at", "n_tokens", "ids" if with_ids else "ids_crc32"])

    return lean(run)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and the document's ids (little-endian unsigned 32-bit), or their checksum ``ids_crc32``,
    decoded from the files. Nothing is shuffled: a file's first position comes from one total per file."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/book").first()["lengths"]), np.uint8)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    files = blocks.groupBy("file").agg(F.sum(size).alias("n"))          # one row per file
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    last = "ids binary" if with_ids else "ids_crc32 long"
    ids = blocks.mapInArrow(_decode(lengths, with_ids), f"file int, doc_id long, at long, n_tokens long, {last}")
    return ids.join(F.broadcast(files), "file").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", last.split()[0])


def new_path(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/llm/token-ids-{uuid.uuid4().hex}"


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None) -> DataFrame:
    """Writes the files, reads them back: doc_id, start, n_tokens, ids_crc32."""
    path = path or new_path(docs.sparkSession)
    write_ids(docs, tokenizer_path, path, end_id)
    return read_ids(docs.sparkSession, path, with_ids=False)
