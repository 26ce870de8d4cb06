"""Packing documents into sequences of a fixed number of tokens, by exact complements of length sums.

Pieces differ for packing by their length alone, so a plan is made on the number of pieces of each length (at most
``limit`` numbers). The longest piece left opens a sequence. If one, two or three pieces left add up to the gap, they
fill it exactly: singles are looked up by length, pairs and triples in an index that says for each sum by how many
pairs of lengths still in stock it is reached. Where no such combination exists the piece that fits best goes in (the
longest, which leaves the smallest gap) and the new gap is looked up. The sequence found is repeated as often as the
stock allows, so the plan has a few thousand lines whatever the corpus; each says which ranks of a length stand where.

Scale: texts are encoded once and written with their ids; lengths are counted there; ranks within a length come from
buckets of ``BUCKET`` pieces and a table of bucket sizes, so that a length that a third of all pieces have is many
buckets. Only lengths and numbers are shuffled, ids stay where they were written. The driver holds the counts
and the plan, both bounded by ``limit``, and tasks carry the plan.

Edge cases: a null or empty text is a piece of one token, the end id; longer documents than ``limit`` are cut, and only
they, the last piece may be shorter; repeated rows and rows that share an id or have none are packed each for
itself; an empty table gives an empty result; other columns are ignored. Which of several pieces of one length stands
where depends on the order of the input, how many sequences there are and their lengths do not.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from counterlens.llm.common import stored, text_chunks, unused
from counterlens.llm.word_tokens import word_encoder

LIMIT = 4096
BUCKET = 50_000                     # pieces ranked at once
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def _cut(spec: str, end_id: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_encoder(spec)
        for rows, data, offsets in text_chunks(batches):
            ids, n = known.encode(data, offsets)
            whole = n + 1
            ends = np.cumsum(whole)
            flat = np.empty(int(ends[-1]), np.uint32)
            last = np.zeros(len(flat), bool)
            last[ends - 1] = True
            flat[last], flat[~last] = end_id, ids
            count = -(-whole // limit)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            length = np.minimum(limit, whole[doc] - piece * limit)
            bounds = np.concatenate([[0], np.cumsum(length)]) * 4
            ids = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat.astype("<u4"))])
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(piece.astype(np.int64) * limit),
                 pa.array(length.astype(np.int64)), ids.cast(pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    return run


def encoded_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids (32-bit little-endian) and a ``row`` of its own for every piece, stored."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(spec, end_id, limit), PIECES)
    return stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")


class Stock:
    """Pieces left by length, and by how many pairs of two lengths in stock each sum is reached."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64)
        self.limit = len(counts) - 1
        self.have = self.left > 0
        both = np.convolve(self.have.astype(np.int64), self.have.astype(np.int64))[:self.limit + 1]
        twice = np.zeros(self.limit + 1, np.int64)
        twice[::2] = self.have[:self.limit // 2 + 1]
        self.pairs = (both - twice) // 2

    def take(self, uses: Counter, times: int):
        for length, n in uses.items():
            self.left[length] -= n * times
            if not self.left[length]:
                self.have[length] = False
                other = np.flatnonzero(self.have[:self.limit - length + 1])
                self.pairs[other + length] -= 1

    def _pair(self, total: int, used: Counter, most: int):
        """The pair of lengths, the first as long as can be, that adds up to ``total``."""
        high = np.arange(min(total - 1, most), (total - 1) // 2, -1)
        for a in high[self.have[high] & self.have[total - high]].tolist():
            b = total - a
            free = self.left[a] - used[a], self.left[b] - used[b]
            if min(free) >= 1 and (a != b or free[0] >= 2):
                return [a, b]
        return None

    def exact(self, gap: int, used: Counter):
        """One, two or three lengths in stock that add up to ``gap``; None where there are none."""
        if self.left[gap] > used[gap]:
            return [gap]
        found = self._pair(gap, used, gap)
        if found or gap < 3:
            return found
        first = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
        rest = gap - first
        reach = self.pairs[rest] > 0
        even = rest % 2 == 0
        reach |= even & (self.left[rest // 2] >= 2)
        for a in first[self.have[first] & reach].tolist():
            if self.left[a] > used[a]:
                found = self._pair(gap - a, used + Counter([a]), a)
                if found:
                    return [a, *found]
        return None

    def best_fit(self, gap: int, used: Counter):
        for a in np.flatnonzero(self.have[:gap + 1])[::-1].tolist():
            if self.left[a] > used[a]:
                return a
        return None


def plan(counts: np.ndarray) -> list[tuple[Counter, int]]:
    """Sequences as (number of pieces by length, repetitions), from the number of pieces of each length 0..limit."""
    stock, out = Stock(counts), []
    for top in range(stock.limit, 0, -1):
        while stock.left[top]:
            used, gap = Counter([top]), stock.limit - top
            while gap:
                found = stock.exact(gap, used) or [stock.best_fit(gap, used)]
                if found[0] is None:
                    break
                used.update(found)
                gap -= sum(found)
            times = min(int(stock.left[length]) // n for length, n in used.items())
            stock.take(used, times)
            out.append((used, times))
    return out


def _lines(sequences: list[tuple[Counter, int]]) -> np.ndarray:
    """length, first rank, repetitions, first sequence, offset: rank ``first + j * times + i`` of that length is the
    j-th of it in sequence ``base + i``."""
    lines, ranks, base = [], Counter(), 0
    for uses, times in sequences:
        offset = 0
        for length in sorted(uses, reverse=True):
            lines.append((length, ranks[length], times, base, offset))
            ranks[length] += uses[length] * times
            offset += uses[length] * length
        base += times
    lines.sort()
    return np.array(lines, np.int64).reshape(-1, 5)


def place(pieces: DataFrame, limit: int = LIMIT, row: str = "row") -> DataFrame:
    """``pieces`` (stored; ``length`` from 1 to ``limit``, ``row`` unique, and any other columns) with ``sequence_id`` and
    ``offset``; offsets in a sequence follow one another without a gap."""
    spark = pieces.sparkSession
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 0 < (length or 0) <= limit for length in sizes):
        raise ValueError("pieces are from 1 to limit tokens long")
    counts = np.zeros(limit + 1, np.int64)
    counts[list(sizes)] = list(sizes.values())
    lines = _lines(plan(counts))
    held = spark.sparkContext.broadcast(lines)
    slot, other, rank = (unused(pieces, n) for n in ("slot", "other_slot", "rank"))
    buckets = max(1, -(-int(counts.sum()) // BUCKET))
    keyed = pieces.withColumn(slot, F.struct("length", F.pmod(F.xxhash64(row), F.lit(buckets)).alias("bucket")))
    local = keyed.withColumn(rank, F.row_number().over(Window.partitionBy(slot).orderBy(row)).cast("long") - 1)
    before = F.sum("n").over(Window.partitionBy(f"{other}.length").orderBy(f"{other}.bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = keyed.groupBy(F.col(slot).alias(other)).agg(F.count(F.lit(1)).alias("n")).select(other, F.coalesce(before, F.lit(0)).alias("before"))
    ranked = local.join(starts, local[slot] == starts[other])
    ranked = ranked.select(*[local[c] for c in pieces.columns], (local[rank] + starts["before"]).alias(rank))
    schema = StructType(list(pieces.schema.fields)).add("sequence_id", LongType()).add("offset", LongType())

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        wide = int(table[:, 1].max(initial=0)) + 1
        keys = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            length, r = (batch.column(c).to_numpy() for c in ("length", rank))
            at = np.searchsorted(keys, length * wide + np.minimum(r, wide - 1), "right") - 1
            _, first, times, base, offset = (table[at, k] for k in range(5))
            q = r - first
            kept = [batch.column(c) for c in batch.schema.names if c != rank]
            names = [c for c in batch.schema.names if c != rank]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(base + q % times), pa.array(offset + q // times * length)],
                                             names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(put, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, doc_ids and ids of every packed sequence, its pieces in order."""
    part = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    whole = placed.groupBy("sequence_id").agg(part.alias("p"))
    joined = F.aggregate("p", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return whole.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"),
                        F.col("p.doc_id").alias("doc_ids"), joined.alias("ids"))
