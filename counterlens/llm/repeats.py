"""Repeated word windows across the corpus: a count-min sketch first, exact grouping of what it lets through.

A window of ``width`` words has an anchor: the smallest hash among its runs of ``gram`` words. Equal windows have
equal anchors at equal offsets, so a window can only be repeated if its anchor occurs at two positions, and the
number of occurrences of the anchor bounds the window's from above. First pass: every partition writes the
sketch of its anchors' positions; merged cell by cell, the sketch never counts an anchor below its true number.
Second pass: only windows whose anchor is estimated at two or more are grouped by a 96-bit hash of their words;
of each group the occurrence with the smallest (doc_id, start) stays and the words of every other one go. The
sketch loses no repeated window; what it lets through wrongly costs a row and is found single.

Scale: a partition keeps one row per distinct window (its earliest), the others are known to be later at once, so
a passage that a third of all documents share arrives as one row per partition. The merged sketch is two bitmaps
of ``cells`` bits (32 MB at the default), whatever the input; on inputs with more distinct anchors than cells the
filter lets more windows through (never fewer), so ``cells`` should follow executor memory.

Edge cases: null and short texts have no window and lose nothing; a null id sorts before all others; rows equal
in id and text are one document and share its result, rows with one id and different texts are two documents,
ordered by a 128-bit hash of the text; a run of equal words repeats itself and keeps its first window; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterlens.llm.common import (BASES, SPACE_KEEP, Keys, keyed_rows, lean, mix, ranked, rolling, shuffle_partitions, sliding, span_hashes,
                                    text_chunks, word_spans)

WIDTH, GRAM = 20, 10
CELLS = 1 << 27          # cells of each of the two sketch rows
SLICE = 1 << 21          # cells that one merging step holds
CHUNK = 2 << 20          # text bytes in numpy form at once
FLUSH = 1_000_000        # windows a task gathers before it writes the earliest of each
GROUP = 250_000          # windows settled at once
_SALTS = (np.uint64(0x632BE59BD9B4E019), np.uint64(0x2545F4914F6CDD1D))


def _anchors(words: np.ndarray, left: np.ndarray, width: int, gram: int):
    """Anchor hash of every window start (0 where no window starts) for word hashes ``words``; ``left``: words
    from each one to its document's end."""
    out = np.zeros(len(words), np.uint64)
    if len(words) >= width:
        low = sliding(mix(rolling(words, gram, BASES[0])) | np.uint64(1), width - gram + 1)
        out[:len(low)] = np.where(left[:len(low)] >= width, low, np.uint64(0))
    return out


def _anchor_positions(words: np.ndarray, anchors: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Hashes at the positions that are the anchor of at least one window, once per position."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    own = mix(rolling(words, gram, BASES[0])) | np.uint64(1)
    reach = width - gram + 1
    padded = np.concatenate([np.zeros(reach - 1, np.uint64), anchors[:len(own)]])
    best = sliding(padded, reach, np.maximum)           # the windows that cover a position start at most reach - 1 before
    return own[best == own]


def _cells(anchors: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(anchors + _SALTS[row]) & np.uint64(cells - 1)).astype(np.int64)


def _read(data, offsets):
    starts, ends, doc = word_spans(data, offsets, SPACE_KEEP)
    words = span_hashes(data, starts, ends)
    ends_at = np.searchsorted(doc, np.arange(len(offsets) - 1), "right")
    return words, doc, ends_at[doc] - np.arange(len(words)) if len(words) else np.empty(0, np.int64)


def _squeezed(hits: np.ndarray) -> bytes:
    """Sorted cell numbers as compressed differences."""
    return zlib.compress(np.diff(hits, prepend=0).astype("<u4").tobytes(), 1)


def _sketch(cells: int, anchors_of):
    """Task function: cells that this partition's anchors hit, each at most twice, by (row, slice)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []

        def flush():
            every = np.concatenate(found)
            found.clear()
            for row in range(2):
                at = np.sort(_cells(every, row, cells))
                at = at[(np.arange(len(at)) < 2) | (at != np.concatenate([[-1, -1], at[:-2]])[:len(at)])]
                parts = at // SLICE
                cut = np.flatnonzero(np.diff(parts, prepend=-1))
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array(row * (cells // SLICE) + parts[cut], pa.int32()),
                    "hits": pa.array([_squeezed(x) for x in np.split(at % SLICE, cut[1:])], pa.binary())})

        for _, data, offsets in text_chunks(batches, limit=CHUNK):
            found.append(anchors_of(data, offsets))
            if sum(map(len, found)) >= FLUSH:
                yield from flush()
        if found and sum(map(len, found)):
            yield from flush()

    return lean(run)


@lean
def _merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by slice: the bitmap of cells that are hit twice or more, per slice."""
    now, seen = None, None

    def done():
        return pd.DataFrame({"slice": [now], "bits": [np.packbits(seen >= 2).tobytes()]})

    for f in frames:
        for k, hits in zip(f["slice"], f["hits"]):
            if k != now:
                if now is not None:
                    yield done()
                now, seen = k, np.zeros(SLICE, np.uint8)
            at = np.cumsum(np.frombuffer(zlib.decompress(hits), "<u4"), dtype=np.int64)
            once = np.ones(len(at), bool)
            once[1:] = at[1:] != at[:-1]
            for own in (at[once], at[~once]):           # each cell at most once per step, so += counts right
                seen[own] = np.minimum(seen[own] + 1, 2)
    if now is not None:
        yield done()


def word_anchors(width: int, gram: int):
    """Bytes and offsets of some texts to the anchors of their windows."""
    def run(data, offsets):
        words, _, left = _read(data, offsets)
        return _anchor_positions(words, _anchors(words, left, width, gram), width, gram)

    return run


def sketch(docs: DataFrame, anchors_of, cells: int = CELLS) -> list[np.ndarray]:
    """The two merged bitmaps of cells hit twice or more; their size is fixed by ``cells``."""
    hits = docs.select("text").mapInArrow(_sketch(cells, anchors_of), "slice int, hits binary")
    merged = (hits.repartition(shuffle_partitions(docs.sparkSession), "slice").sortWithinPartitions("slice")
              .mapInPandas(_merge, "slice int, bits binary"))
    rows = [np.zeros(cells // 8, np.uint8) for _ in range(2)]
    per = cells // SLICE
    for r in merged.toLocalIterator():
        at = (r["slice"] % per) * (SLICE // 8)
        rows[r["slice"] // per][at:at + SLICE // 8] = np.frombuffer(r["bits"], np.uint8)
    return rows


def hit_twice(bits: list[np.ndarray], anchors: np.ndarray, cells: int) -> np.ndarray:
    """Which anchors (0: none) both sketch rows estimate at two or more."""
    ok = anchors != 0
    for row in range(2):
        at = _cells(anchors[ok], row, cells)
        hit = (bits[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        ok[np.flatnonzero(ok)[hit == 0]] = False
    return ok


def in_order(h1, h2, null, ids, key, start):
    """Sorted by window, then by place: null ids first."""
    order = np.lexsort((start, key, ids, ~null, h2, h1))
    return tuple(x[order] for x in (h1, h2, null, ids, key, start))


def first_and_later(h1, h2, null, ids, key, start):
    """Of sorted places: the first of each window, and those at another place than the first."""
    first = np.ones(len(h1), bool)
    first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    own = np.maximum.accumulate(np.where(first, np.arange(len(h1)), 0))
    later = (ids != ids[own]) | (null != null[own]) | (key != key[own]) | (start != start[own])
    return first, later


def runs(null, ids, key, start):
    """Consecutive starts in one document as (…, start, number)."""
    order = np.lexsort((start, key, ids, ~null))
    null, ids, key, start = (x[order] for x in (null, ids, key, start))
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1]) | (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(fresh)
    last = np.append(at, len(ids))[1:] - 1
    return null[at], ids[at], key[at], start[at], start[last] - start[at] + 1


def _candidates(held, cells: int, width: int, gram: int):
    """Task function: windows that the sketch calls repeated. ``run`` 0: the earliest of its kind here; otherwise
    so many consecutive windows that an earlier one in this partition equals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value

        parts: list[tuple] = []
        keys = Keys()

        def rows(h1, h2, null, ids, key, start, length, names):
            return pa.RecordBatch.from_arrays([
                pa.array(h1.view(np.int64)), pa.array(h2.view(np.int32)), pa.array(ids, mask=null), names.take(pa.array(key)),
                pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32))], names=["h1", "h2", "doc_id", "key", "start", "run"])

        def flush():
            h1, h2, null, ids, key, start = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            key, names = keys.ranks(key)
            h1, h2, null, ids, key, start = in_order(h1, h2, null, ids, key, start)
            first, later = first_and_later(h1, h2, null, ids, key, start)
            yield rows(*(x[first] for x in (h1, h2, null, ids, key, start)), np.zeros(int(first.sum())), names)
            if later.any():
                null, ids, key, start, length = runs(*(x[later] for x in (null, ids, key, start)))
                # runs need no partner: the hash of their own place keeps them alone in their group
                own = mix(ids.view(np.uint64) ^ mix(start.astype(np.uint64) ^ mix(key.astype(np.uint64))))
                yield rows(own, mix(own).astype(np.uint32), null, ids, key, start, length, names)

        for batch, data, offsets in text_chunks(batches, limit=CHUNK):
            words, doc, left = _read(data, offsets)
            keep = np.flatnonzero(hit_twice(bits, _anchors(words, left, width, gram), cells))
            if not len(keep):
                continue
            other = mix(words ^ np.uint64(BASES[1]))
            starts_at = np.searchsorted(doc, np.arange(batch.num_rows))
            ids = batch.column("doc_id")
            own = doc[keep]
            parts.append((mix(rolling(words, width, BASES[0])[keep]), mix(rolling(other, width, BASES[1])[keep]).astype(np.uint32),
                          np.asarray(ids.is_null())[own], ids.fill_null(0).to_numpy(zero_copy_only=False)[own],
                          keys.of(batch.column("key"))[own], keep - starts_at[own]))
            if sum(len(p[0]) for p in parts) >= FLUSH:
                yield from flush()
        if parts:
            yield from flush()

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by window: every place but the first, in runs."""
    def settle(t: pa.Table):
        columns = ["doc_id", "key", "start", "run"]
        known = t.column("run").to_numpy() > 0
        yield from t.filter(pa.array(known)).select(columns).to_batches()
        t = t.filter(pa.array(~known))
        ids = t.column("doc_id")
        key, names = ranked(t.column("key"))
        places = in_order(t.column("h1").to_numpy(), t.column("h2").to_numpy(), np.asarray(ids.is_null()), ids.fill_null(0).to_numpy(),
                          key, t.column("start").to_numpy())
        _, later = first_and_later(*places)
        null, ids, key, start, length = runs(*(x[later] for x in places[2:]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null), names.take(pa.array(key)), pa.array(start), pa.array(length, pa.int32())], names=columns)

    yield from by_whole_groups(batches, ("h1", "h2"), GROUP, settle)


def by_whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, str], size: int, settle):
    """Calls ``settle`` on tables of about ``size`` rows that hold all rows of each key; rows come sorted by key."""
    held: list[pa.Table] = []
    n = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        n += len(batch)
        if n >= size:
            t = pa.concat_tables(held).combine_chunks()
            a, b = (t.column(c).to_numpy() for c in keys)
            whole = int(np.flatnonzero((a == a[-1]) & (b == b[-1]))[0])           # the last key may go on
            if whole:
                yield from settle(t.slice(0, whole).combine_chunks())
            rest = t.slice(whole)
            held, n = [rest.take(pa.array(np.arange(len(rest)))) if whole else rest], len(rest)      # a copy, or all of ``t`` would stay
            del t
    if n:
        yield from settle(pa.concat_tables(held).combine_chunks())


def later_windows(rows: DataFrame, width: int = WIDTH, gram: int = GRAM, cells: int = CELLS) -> DataFrame:
    """``rows``: as ``keyed_rows``. doc_id, key, start, run: starts of windows whose words also start earlier (``run``
    consecutive ones)."""
    held = rows.sparkSession.sparkContext.broadcast(sketch(rows, word_anchors(width, gram), cells))
    found = rows.mapInArrow(_candidates(held, cells, width, gram),
                            "h1 long, h2 int, doc_id long, key string, start int, run int")
    # The earliest of each window per task, then of all: at most one row per window and flush meets here.
    return (found.repartition(shuffle_partitions(rows.sparkSession), "h1", "h2").sortWithinPartitions("h1", "h2")
            .mapInArrow(_settle, "doc_id long, key string, start int, run int"))


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, digests = [], [], []
            for text, gone in zip(batch.column("text"), batch.column("gone")):
                words = (text.as_py() or "").encode().split()
                cut = 0
                if gone.is_valid and len(gone.values):
                    at = gone.values.field("start").to_numpy()
                    mark = np.zeros(len(words) + 1, np.int64)
                    np.add.at(mark, at, 1)
                    np.add.at(mark, at + gone.values.field("run").to_numpy() - 1 + width, -1)
                    keep = np.cumsum(mark[:-1]) == 0
                    cut = len(words) - int(keep.sum())
                    kept = list(compress(words, keep))
                else:
                    kept = words
                counts.append(len(words))
                removed.append(cut)
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def join_back(rows: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text of ``rows`` (as ``keyed_rows``) and, from ``found`` (doc_id, key, ...; one row per document), its other columns."""
    extra = [c for c in found.columns if c not in ("doc_id", "key")]
    right = found.select(F.coalesce("doc_id", F.lit(0)).alias("__i"), F.col("doc_id").isNull().alias("__n"),
                         F.col("key").alias("__k"), *extra)
    return rows.join(right, (F.coalesce(rows["doc_id"], F.lit(0)) == right["__i"])
                     & (rows["doc_id"].isNull() == right["__n"]) & (rows["key"] == right["__k"]),
                     "left").select("doc_id", "text", *extra)


def drop_repeated_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, cells: int = CELLS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; one row per input row."""
    rows = keyed_rows(docs)
    gone = later_windows(rows, width, gram, cells).groupBy("doc_id", "key").agg(
        F.collect_list(F.struct("start", "run")).alias("gone"))
    return join_back(rows, gone).mapInArrow(_cut(width), "doc_id long, n_words long, n_removed long, kept_sha256 string")
