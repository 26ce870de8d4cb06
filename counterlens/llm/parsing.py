"""Repeated byte strings of fixed length across the corpus, by triggered parsing.

Rolling-hash triggers cut every text: the trigger of a ``length``-byte string is the first smallest hash among its
``GRAM``-byte runs, so equal strings have equal triggers at equal offsets, and the strings that share one trigger
occurrence form a phrase. Phrases whose trigger occurs once in the corpus (by the count-min sketch of ``repeats``)
hold no repeat and end there; only the others, mostly the text that copies share, go on. A phrase is cut into pieces
of at most ``STEP`` neighbouring strings, which share all but ``STEP - 1`` bytes: that common core names the piece,
and the wings, ``STEP - 1`` bytes on either side of it, tell its strings apart. Pieces meet by the 128-bit hash of
their core; two strings are equal exactly if they lie in pieces of one core and their part of the wings is equal.

The order of suffixes is needed only up to equality of their first ``length`` bytes, so no suffix array is built: the
array of the dictionary alone takes eight bytes for each byte of distinct text, more than the disk that the whole
operator needs here.

Scale: pieces equal in core and wings are merged in their task before the shuffle, so a passage that a third of all
documents share arrives once per task; what meets under one core is one piece per task and the pieces with different
wings. Texts move once, to meet what is cut from them.

Edge cases: null and short texts lose nothing; every row is a document, so a row that is there twice repeats itself
and both lose all but what is short; a null id is an id; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterlens.llm.common import BASES, BYTE_VALUES, keyed_rows, mix, powers, shuffle_partitions, sliding, text_chunks
from counterlens.llm.repeats import CELLS, by_whole_groups, hit_twice, join_back, sketch

LENGTH, GRAM, STEP = 200, 64, 16
CHUNK = 1 << 20
PLACE_BITS = 26                        # positions of a block in the low bits of what triggers are chosen by
FLUSH = 100_000                        # pieces a task gathers before it merges equal ones
GROUP = 100_000                        # pieces settled at once

PIECES = "k1 long, k2 long, doc_id long, key string, start int, low int, high int, many boolean, wings binary, run int"


class Prefix:
    """Hashes of arbitrary byte spans from prefix sums."""

    def __init__(self, data: np.ndarray, which: int):
        base = BASES[which]
        self.back = powers(pow(base, -1, 1 << 64), len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[which][data] * powers(base, len(data))[:len(data)], out=self.sums[1:])

    def spans(self, starts, width: int) -> np.ndarray:
        return mix((self.sums[starts + width] - self.sums[starts]) * self.back[starts] + np.uint64(width))

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.back[:n] + np.uint64(width))


def triggers(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """For every start of a whole string: the trigger's place, -1 elsewhere; and all gram hashes."""
    place = np.full(len(data), -1, np.int64)
    if len(data) < length:
        return place, np.empty(0, np.uint64), None
    prefix = Prefix(data, 0)
    grams = prefix.all(gram) | np.uint64(1)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    for at in range(0, len(grams), 1 << (PLACE_BITS - 1)):
        part = grams[at:at + (1 << (PLACE_BITS - 1)) + length]
        if len(part) < length - gram + 1:
            break
        best = sliding((part & ~mask) | np.arange(len(part), dtype=np.uint64), length - gram + 1)
        best = best[:1 << (PLACE_BITS - 1)]
        place[at:at + len(best)] = at + (best & mask).astype(np.int64)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    place[left < length] = -1
    return place, grams, prefix


def byte_anchors(length: int, gram: int):
    def run(data, offsets):
        place, grams, _ = triggers(data, offsets, length, gram)
        return grams[np.unique(place[place >= 0])]

    return run


def pieces_of(data: np.ndarray, offsets: np.ndarray, bits, cells: int, length: int, gram: int):
    """Pieces of the phrases that may repeat: core hashes, row, core start and the offsets ``low..high`` of their
    strings' starts before the core, and the wings."""
    place, grams, prefix = triggers(data, offsets, length, gram)
    cut = np.flatnonzero(np.diff(place, prepend=-2) != 0)
    end = np.append(cut[1:], len(place))
    own = place[cut]
    ok = own >= 0
    ok[ok] = hit_twice(bits, grams[own[ok]], cells)
    cut, end, own = cut[ok], end[ok], own[ok]
    near, far = own - (end - 1), own - cut                        # distances of the phrase's starts to its trigger
    n = far // STEP - near // STEP + 1
    which = np.repeat(np.arange(len(own)), n)
    step = near[which] // STEP + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    core = own[which] - STEP * step
    low = np.maximum(near[which] - STEP * step, 0)
    high = np.minimum(far[which] - STEP * step, STEP - 1)
    if not len(core):
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none, np.empty((0, 2 * STEP - 2), np.uint8)
    width = length - STEP + 1
    k1 = prefix.spans(core, width)
    k2 = Prefix(data, 1).spans(core, width)
    side = STEP - 1
    around = np.concatenate([core[:, None] + np.arange(-side, 0), core[:, None] + width + np.arange(side)], axis=1)
    wings = data[np.clip(around, 0, len(data) - 1)]
    at = np.arange(2 * side)
    wings[(at < side - high[:, None]) | (at >= 2 * side - low[:, None])] = 0     # bytes that no string of the piece has
    row = np.searchsorted(offsets, core, "right") - 1
    return k1, k2, row, core - offsets[row], low, high, wings


def _merge_runs(doc: np.ndarray, start: np.ndarray, run: np.ndarray):
    """Union of start ranges per document number: (doc, start, run), sorted."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], (start + run)[order]
    reach = stop + doc * (1 << 40)
    reach = np.maximum.accumulate(reach)
    fresh = np.ones(len(doc), bool)
    fresh[1:] = start[1:] + doc[1:] * (1 << 40) > reach[:-1]
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], reach[last] - doc[at] * (1 << 40) - start[at]


def _pieces(held, cells: int, length: int, gram: int):
    """Task function: distinct pieces of a task, and runs of string starts that repeat inside the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        ids: list[tuple] = []                                   # (id, key) by document number

        def batch_of(k1, k2, doc, start, low, high, many, wings, length_):
            own = [ids[d] for d in doc.tolist()]
            return pa.RecordBatch.from_arrays([
                pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array([i for i, _ in own], pa.int64()),
                pa.array([k for _, k in own], pa.string()), pa.array(start, pa.int32()), pa.array(low, pa.int32()),
                pa.array(high, pa.int32()), pa.array(many), pa.array(wings, pa.binary()), pa.array(length_, pa.int32())],
                names=[c.split()[0] for c in PIECES.split(", ")])

        def flush():
            k1, k2, doc, start, low, high, wings = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            line = np.concatenate([k1[:, None].view(np.uint8).reshape(len(k1), 8), k2[:, None].view(np.uint8).reshape(len(k1), 8),
                                   low[:, None].astype(np.uint8), high[:, None].astype(np.uint8), wings], axis=1)
            line = np.ascontiguousarray(line).view([("", np.void, line.shape[1])]).reshape(-1)
            _, first, back, count = np.unique(line, return_index=True, return_inverse=True, return_counts=True)
            many = count > 1
            yield batch_of(k1[first], k2[first], doc[first], start[first], low[first], high[first], many,
                           [w.tobytes() for w in wings[first]], np.zeros(len(first)))
            done = many[back]
            if done.any():
                d, s, r = _merge_runs(doc[done], start[done] - high[done], high[done] - low[done] + 1)
                own = mix(mix(d.astype(np.uint64) + np.uint64(1)) ^ s.astype(np.uint64) ^ k1[0])
                zero = np.zeros(len(d))
                yield batch_of(own, mix(own), d, s, zero, zero, np.ones(len(d), bool), [b""] * len(d), r)

        for batch, data, offsets in text_chunks(batches, limit=CHUNK):
            k1, k2, row, start, low, high, wings = pieces_of(data, offsets, held.value, cells, length, gram)
            if not len(k1):
                continue
            seen, number = np.unique(row, return_inverse=True)
            base = len(ids)
            picked = batch.select(["doc_id", "key"]).take(pa.array(seen))
            ids.extend(zip(picked.column("doc_id").to_pylist(), picked.column("key").to_pylist()))
            parts.append((k1, k2, base + number, start, low, high, wings))
            if sum(len(p[0]) for p in parts) >= FLUSH:
                yield from flush()
                ids.clear()
        if parts:
            yield from flush()

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by core: which strings of each piece occur twice, as runs of starts."""
    def settle(t: pa.Table):
        run = t.column("run").to_numpy()
        if (run > 0).any():
            yield from t.filter(pa.array(run > 0)).select(["doc_id", "key", "start", "run"]).to_batches()
        t = t.filter(pa.array(run == 0))
        k1, k2 = (t.column(c).to_numpy().view(np.uint64) for c in ("k1", "k2"))
        name = mix(k1 ^ mix(k2))
        low, high, many = (t.column(c).to_numpy() for c in ("low", "high", "many"))
        wings = np.frombuffer(b"".join(t.column("wings").to_pylist()), np.uint8).reshape(len(t), 2 * STEP - 2)
        twice = np.zeros((len(t), STEP), bool)
        for x in range(STEP):
            at = np.flatnonzero((low <= x) & (x <= high))
            own = np.zeros((len(at), 16), np.uint8)
            own[:, :STEP - 1] = wings[at, STEP - 1 - x:2 * STEP - 2 - x]
            two = own.view(np.uint64)
            h = mix(name[at] ^ mix(two[:, 0] ^ mix(two[:, 1] + np.uint64(1))))
            order = np.argsort(h)
            h = h[order]
            same = h[1:] == h[:-1]
            again = np.zeros(len(at), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            twice[at, x] = again | many[at]
        # offset x before the core is start - x: runs of set offsets become runs of starts
        edge = np.diff(np.pad(twice, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        _, stop = np.nonzero(edge == -1)
        start = t.column("start").to_numpy()[row] - (stop - 1)
        picked = t.select(["doc_id", "key"]).take(pa.array(row)).combine_chunks()
        out = pa.table({"doc_id": picked.column("doc_id"), "key": picked.column("key"),
                        "start": pa.array(start, pa.int32()), "run": pa.array(stop - first, pa.int32())})
        yield from out.to_batches()

    yield from by_whole_groups(batches, ("k1", "k2"), GROUP, settle)


def repeated_starts(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, cells: int = CELLS) -> DataFrame:
    """``rows``: as ``keyed_rows``. doc_id, key, start, run: starts of ``length``-byte strings that also start elsewhere."""
    held = rows.sparkSession.sparkContext.broadcast(sketch(rows, byte_anchors(length, gram), cells))
    pieces = rows.mapInArrow(_pieces(held, cells, length, gram), PIECES)
    return (pieces.repartition(shuffle_partitions(rows.sparkSession), "k1", "k2").sortWithinPartitions("k1", "k2")
            .mapInArrow(_settle, "doc_id long, key string, start int, run int"))


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, digests = [], [], [], []
            for text, gone in zip(batch.column("text"), batch.column("gone")):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                cut, parts, at, n = 0, [], 0, 0
                if gone.is_valid and len(gone.values):
                    start = gone.values.field("start").to_numpy().astype(np.int64)
                    stop = start + gone.values.field("run").to_numpy() - 1 + length
                    order = np.argsort(start, kind="stable")
                    reach = np.maximum.accumulate(stop[order])
                    fresh = np.ones(len(order), bool)
                    fresh[1:] = start[order][1:] > reach[:-1]            # touching spans are one
                    first = np.flatnonzero(fresh)
                    for a, b in zip(start[order][first].tolist(), reach[np.append(first[1:], len(order)) - 1].tolist()):
                        parts.append(raw[at:a])
                        at, cut, n = b, cut + b - a, n + 1
                parts.append(raw[at:])
                sizes.append(len(raw))
                removed.append(cut)
                spans.append(n)
                digests.append(hashlib.sha256(b"".join(parts)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)),
                                              pa.array(digests, pa.string())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def drop_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, cells: int = CELLS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row per input row."""
    rows = keyed_rows(docs)
    gone = repeated_starts(rows, length, gram, cells).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "run")).alias("gone"))
    return join_back(rows, gone).mapInArrow(
        _cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
