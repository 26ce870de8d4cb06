"""Benchmark decontamination by a positional inverted index of the training texts.

The training corpus becomes segments, each an inverted index of some megabytes of whole documents: sorted term
hashes, and for every term the ascending positions of all its occurrences. Positions run through the segment with a
gap between documents, so a match never crosses one. Benchmark items are cut into windows. In each segment a window's
candidates are the positions of its rarest term there, shifted by the term's offset; the lists of the other terms,
again rarest first, thin them out. An exact phrase needs every term at its offset; a proximity match allows every
term to be ``slop`` words off.

Scale: one pass writes the segments (no shuffle), a second reads them where they lie; work per segment depends on the
benchmark's windows, most of which end at a term that the segment lacks. The benchmark is the query set and
travels with the tasks; its size is checked.

Edge cases: null and wordless texts have 0 words and are never hit; items without words have no window, shorter
ones a single window; items with one id count once; null item ids are the empty string; rows of ``documents`` each
get their row, whatever their id; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterlens.llm.common import ALNUM_KEEP, LOWER, Carried, lean, span_hashes, stored, text_chunks, word_spans

WINDOW, SLOP = 10, 2
SEGMENT_BYTES = 6 << 20
QUERY_LIMIT = 512 << 20                                 # characters of benchmark text that may travel with the tasks
GAP = 64                                                # free positions after each document; above window + slop

SEGMENTS = "terms binary, firsts binary, positions binary, doc_ids array<{}>, bases array<int>, counts array<int>"


@lean
def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per segment."""
    for batch, data, offsets in text_chunks(batches, limit=SEGMENT_BYTES):
        lower = LOWER[data]
        starts, ends, doc = word_spans(lower, offsets, ALNUM_KEEP)
        counts = np.bincount(doc, minlength=batch.num_rows)
        bases = np.cumsum(counts + GAP) - (counts + GAP)
        position = np.arange(len(starts)) + GAP * doc
        h = span_hashes(lower, starts, ends)
        order = np.argsort(h, kind="stable")
        h = h[order]
        firsts = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0)
        yield pa.RecordBatch.from_arrays([
            pa.array([h[firsts].tobytes()], pa.binary()), pa.array([np.append(firsts, len(h)).astype(np.int32).tobytes()], pa.binary()),
            pa.array([position[order].astype(np.int32).tobytes()], pa.binary()),
            pa.array([batch.column("doc_id").to_pylist()], pa.list_(batch.schema.field("doc_id").type)),
            pa.array([bases], pa.list_(pa.int32())), pa.array([counts], pa.list_(pa.int32()))],
            names=["terms", "firsts", "positions", "doc_ids", "bases", "counts"])


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def positional_index(docs: DataFrame) -> DataFrame:
    """The stored index; a row is a segment."""
    return stored(docs.select("doc_id", "text").mapInArrow(_index, SEGMENTS.format(_id_type(docs))), "postings")


class Windows:
    """The benchmark's distinct windows: term numbers by offset, and the items each belongs to."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        found: dict[tuple, set[int]] = {}
        self.items = sorted({i for i, _ in items})
        number = {i: n for n, i in enumerate(self.items)}
        for item, text in items:
            data = LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
            starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM_KEEP)
            h = span_hashes(data, starts, ends).tolist()
            for at in range(max(1, len(h) - size + 1) if h else 0):
                found.setdefault(tuple(h[at:at + size]), set()).add(number[item])
        self.terms = np.unique(np.array([t for w in found for t in w], np.uint64))
        self.windows = [np.searchsorted(self.terms, np.array(w, np.uint64)) for w in found]
        self.owners = [sorted(x) for x in found.values()]
        self.lens = np.array([len(w) for w in self.windows], np.int64)
        self.flat = np.concatenate([np.empty(0, np.int64), *self.windows])
        self.at = np.cumsum(self.lens) - self.lens


def _near(sorted_positions: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
    """Which ``wanted`` have a position within ``slop``."""
    if not len(sorted_positions):
        return np.zeros(len(wanted), bool)
    at = np.searchsorted(sorted_positions, wanted - slop)
    return (at < len(sorted_positions)) & (sorted_positions[np.minimum(at, len(sorted_positions) - 1)] <= wanted + slop)


def _search(held, slop: int):
    names = ["doc_id", "n_words", "n_hit", "n_items", "n_near", "items", "items_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Windows = held.value
        for batch in batches:
            for i in range(batch.num_rows):
                terms = np.frombuffer(batch.column("terms")[i].as_py(), np.uint64)
                firsts = np.frombuffer(batch.column("firsts")[i].as_py(), np.int32)
                positions = np.frombuffer(batch.column("positions")[i].as_py(), np.int32)
                bases = batch.column("bases")[i].values.to_numpy()
                counts = batch.column("counts")[i].values.to_numpy()
                at = np.searchsorted(terms, q.terms)
                known = at < len(terms)
                known[known] = terms[at[known]] == q.terms[known]
                held_at = np.where(known, at, 0)
                total = np.where(known, firsts[held_at + 1] - firsts[held_at], 0) if len(terms) else np.zeros(len(q.terms), np.int64)
                live = np.flatnonzero(np.minimum.reduceat(total[q.flat], q.at) > 0) if len(q.flat) else []

                def postings(term):
                    return positions[firsts[at[term]]:firsts[at[term] + 1]]

                marks = np.zeros(int(bases[-1] + counts[-1]) + GAP + 1 if len(bases) else 1, np.int32)
                exact_doc, exact_item, near_doc, near_item = [], [], [], []
                for w in live:
                    own = q.windows[w]
                    order = np.argsort(total[own], kind="stable")
                    start = exact = postings(own[order[0]]).astype(np.int64) - order[0]
                    for o in order[1:]:
                        have = postings(own[o])
                        start = start[_near(have, start + o, slop)]
                        if not len(start):
                            break
                    if not len(start):
                        continue
                    exact = np.intersect1d(exact, start)
                    for o in order[1:]:
                        exact = exact[_near(postings(own[o]), exact + o, 0)]
                    np.add.at(marks, exact, 1)
                    np.add.at(marks, exact + len(own), -1)
                    # the rarest term may itself be off by the slop; its document is what counts
                    for hits, docs, items in ((exact, exact_doc, exact_item), (start + order[0], near_doc, near_item)):
                        d = np.unique(np.searchsorted(bases, hits, "right") - 1)
                        for item in q.owners[w]:
                            docs.append(d)
                            items.append(np.full(len(d), item))
                covered = np.concatenate([[0], np.cumsum(np.cumsum(marks) > 0)])
                n_hit = covered[bases + counts] - covered[bases] if len(bases) else np.empty(0, np.int64)
                found: dict[int, set[int]] = {}
                close: dict[int, set[int]] = {}
                for docs, items, into in ((exact_doc, exact_item, found), (near_doc, near_item, close)):
                    for d, k in zip(np.concatenate(docs).tolist() if docs else [], np.concatenate(items).tolist() if items else []):
                        into.setdefault(d, set()).add(k)
                lists = [sorted(q.items[k] for k in found.get(d, ())) for d in range(len(bases))]
                near = [len(close.get(d, set()) - found.get(d, set())) for d in range(len(bases))]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_ids")[i].values, pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array([len(x) for x in lists], pa.int64()), pa.array(near, pa.int64()), pa.array(lists, pa.list_(pa.string())),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists], pa.string())], names=names)

    return lean(run, held.name)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, n_near (items only near), items, items_sha256; one row per input row."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    if size > QUERY_LIMIT:
        raise ValueError(f"benchmark of {size} characters: run it in parts of at most {QUERY_LIMIT}")
    held = Carried(spark, Windows([(r["item"], r["text"]) for r in items.toLocalIterator()], window))
    return positional_index(docs).mapInArrow(
        _search(held, slop), f"doc_id {_id_type(docs)}, n_words long, n_hit long, n_items long, n_near long, items array<string>, items_sha256 string")
