"""Packing: ids against the library, whole sequences, plans against the lower bound and against exact search."""

import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from counterlens.llm import packing, word_tokens
from test_corpus import frame, hard_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def encoder():
    with open(PATH, encoding="utf-8") as f:
        return word_tokens.WordEncoder(f.read())


def test_words_give_the_library_ids(library):
    texts = ["", " ", "a", " a ", "a\tb\r\nc", "Don't they'LL 's S'S", "<|endoftext|> z<|startoftext|>Q <|end oftext|>", "日本 語 　 x", "x y z \x1c q\x0bw\x0cv",
             "é ́x ñ́ ́", "ΟΔΟΣ ΟΔΟΣ. Σ", "İstanbul ǅ", "1 22 333½", "\U0001f600 \U0001f600 a‍b", "\u0085 x \x85y", "ends\n", "#$% ^&*( )'re're"]
    known = encoder()
    assert known.by_piece
    for _ in range(2):                                                   # the second time every word is known
        ids, n = known.encode(*flat(texts))
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


KNOWN, LIBRARY = encoder(), Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aB' \t\n\r\x0b é́̈Σσ1½-<|>endoftxr日‍")), max_size=30), max_size=6))
def test_any_texts_give_the_library_ids(texts):
    ids, n = KNOWN.encode(*flat(texts))
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]



def test_equal_names_are_encoded_whole(library, monkeypatch):
    known = encoder()
    texts = ["alpha beta", "gamma delta alpha"]
    monkeypatch.setitem(word_tokens.Encoder._places.__globals__, "piece_names", lambda data, starts, ends: (
        np.zeros(len(starts), np.uint64), np.arange(len(starts)).astype(np.uint64)))
    ids, n = known.encode(*flat(texts))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for x in want for i in x] and known.counts(*flat(texts)).tolist() == n.tolist()


@lru_cache(maxsize=None)
def _fewest(limit, lengths):
    """Exact number of sequences by search over what may share one with the longest piece."""
    if not lengths:
        return 0
    first, rest = lengths[0], lengths[1:]
    best, seen = len(lengths), set()
    def fill(gap, at, taken):
        nonlocal best
        left = tuple(x for i, x in enumerate(rest) if i not in taken)
        if left not in seen:
            seen.add(left)
            best = min(best, 1 + _fewest(limit, left))
        for i in range(at, len(rest)):
            if rest[i] <= gap:
                fill(gap - rest[i], i + 1, taken | {i})
    fill(limit - first, 0, frozenset())
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_small_plans_are_near_the_fewest(lengths):
    counts = np.bincount(lengths, minlength=13)
    found = packing.plan(counts)
    total = Counter()
    for uses, times in found:
        assert times >= 1 and sum(length * n for length, n in uses.items()) <= 12
        for length, n in uses.items():
            total[length] += n * times
    assert total == Counter(lengths)
    assert sum(t for _, t in found) <= _fewest(12, tuple(sorted(lengths, reverse=True))) + 1


def test_plans_of_many_pieces_meet_the_bound():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 4097, 20_000), np.minimum(4096, rng.lognormal(5.5, 1.2, 50_000).astype(int) + 1), np.full(10_000, 1),
                    rng.integers(300, 900, 30_000)):
        counts = np.bincount(lengths, minlength=4097)
        bound = max(-(-int(lengths.sum()) // 4096), int((lengths > 2048).sum()))
        found = packing.plan(counts)
        assert sum(t for _, t in found) <= bound * 1.01 + 1 and len(found) < 12_000


def test_pair_index_follows_the_stock():
    rng = np.random.default_rng(2)
    stock = packing.Stock(rng.integers(0, 3, 41))
    while stock.have.any():
        length = int(rng.choice(np.flatnonzero(stock.have)))
        stock.take(Counter([length]), 1)
        own = np.flatnonzero(stock.left)
        want = Counter(a + b for a in own for b in own if a < b)
        assert stock.pairs.tolist() == [want[s] for s in range(41)]


def test_packed_documents(spark, library):
    rows = hard_rows() + [(2000, "word " * 9000, "s", "en"), (2001, "word " * 4095, "s", "en"), (2002, "word " * 4096, "s", "en")]
    rows += [(None, None, "s", "en")] * 40
    docs = frame(spark, rows).repartition(5)
    pieces = packing.encoded_pieces(docs, PATH, 1)
    placed = packing.place(pieces)
    found = placed.collect()
    want = Counter()
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(-(-len(ids) // 4096)):
            own = ids[k * 4096:(k + 1) * 4096]
            want[i, k, k * 4096, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(r["ids"])) for r in found) == want
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], bytes(r["ids"])))
    for own in by.values():
        own.sort()
        assert [o for o, _, _ in own] == np.concatenate([[0], np.cumsum([n for _, n, _ in own])[:-1]]).tolist()
        assert sum(n for _, n, _ in own) <= 4096
    assert len(by) <= -(-sum(r["length"] for r in found) // 4096) + 1
    whole = packing.sequences(spark.createDataFrame(found, placed.schema)).collect()
    assert {r["sequence_id"]: bytes(r["ids"]) for r in whole} == {s: b"".join(x for _, _, x in own) for s, own in by.items()}


def test_many_buckets_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 7)
    pieces = spark.range(500).selectExpr("id as row", "cast(1 + id % 5 as bigint) as length", "id as slot", "id as rank", "id as other_slot", "id as n", "id as before")
    placed = packing.place(pieces, limit=10)
    found = placed.collect()
    assert placed.columns == [*pieces.columns, "sequence_id", "offset"] and sorted(r["n"] for r in found) == list(range(500))
    cells = {(r["sequence_id"], r["offset"] + k) for r in found for k in range(r["length"])}
    assert len(cells) == sum(r["length"] for r in found) == 10 * len({r["sequence_id"] for r in found})


def test_packing_of_nothing(spark):
    assert packing.place(packing.encoded_pieces(frame(spark, []), PATH, 1)).count() == 0
