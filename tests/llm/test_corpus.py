"""Corpus operators against plain versions: whole small tables with nulls, empty and long texts, ties, repeated rows
and columns whose names the operators use themselves."""

import os

import brute
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from counterlens.llm import (common, huffman, language, licenses, mixing, parsing, positions, repeats, simhash, token_cache, tokens,
                             vector_tree)
from counterlens.llm import queries
from counterlens.llm.components import components

SMALL = os.environ.get("AUDIT_SF_DIR", "/root/testdata/sf0.001")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size string, start string, run string, "
          "rank string, fp string, words string, `__k` string, key string, `__lang` string, `__tid` string, `__id` string, `__row` string, "
          "`__copies` string, tid string, node string, kept_id string, row_key string, times string, copy string, found_lang string, root string")
CELLS = 1 << 21


def hard_rows():
    table = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    rows = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in table]
    passage = " ".join(f"shared{i}" for i in range(60))
    rows += [
        (1001, None, "src0", "en"), (1002, "", "src0", None), (1003, " \t\n", None, "de"), (1004, "x", None, None),
        (1005, "same " * 90, "src1", "en"), (1006, "same " * 45, "src1", "en"), (1007, "é" * 300 + " " + "é" * 300, "src2", "fr"),
        (1008, "Before it. " + passage + " after.", "src3", "en"), (1009, passage, "src3", "en"), (1010, "X" + passage + " end", "src4", "en"),
        (1011, "CC BY and cc-by; General Public  License, ALL RIGHTS RESERVED. general public", "src5", "en"),
        (1012, "a  b \n c  d <|endoftext|> e 's  ", "src6", "en"), (1013, rows[0][1], "src7", "en"), (None, rows[1][1], "src8", "en"),
        (None, "no id " * 30, None, "en"), (1014, rows[2][1] + " tail", "", "en"), (1014, rows[3][1], "src9", "en"),
        (1015, (rows[4][1] or "x ") * 60, "src1", "en"),
    ]
    rows += [(1016, passage, "src2", "en")] * 2
    return rows


def frame(spark, rows):
    data = [(i, t, k, s, None if t is None else len(t), *["clash"] * (SCHEMA.count(",") - 4)) for i, t, s, k in rows]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return hard_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ---- 1: mixing -----------------------------------------------------------------------------------------------
def test_mix_meets_targets(docs, rows):
    size, target = brute.targets(rows)
    found = mixing.pareto_mix(docs).collect()
    again = mixing.pareto_mix(docs.repartition(3)).collect()
    place = lambda rs: sorted(((r["doc_id"], r["size"], r["copies"]) for r in rs), key=repr)
    assert place(found) == place(again)
    assert len(found) == len(rows)
    taken = {}
    for r in found:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():
        own = [r["size"] for r in found if r["source"] == s]
        best = brute.nearest_total(own, target[s])
        assert abs(n - target[s]) <= best + 0.02 * target[s] + 1, (s, n, target[s], best)


def test_mix_prefers_by_measure(spark):
    rows = [(i, "w " * 10, "a", "en") for i in range(2000)] + [(9000 + i, "w " * 10, "b", "en") for i in range(4000)]
    df = frame(spark, rows).withColumn("liking", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    found = mixing.pareto_mix(df, weights=(1.0, 5.0), share=0.5, measure=F.col("liking"))
    n = {r["even"]: r["n"] for r in found.filter("source = 'a'").groupBy((F.col("doc_id") % 2 == 0).alias("even")).agg(F.sum("copies").alias("n")).collect()}
    assert n[True] + n[False] == pytest.approx(500, abs=2) and n[True] / n[False] == pytest.approx(3, rel=0.25)


def test_mix_of_nothing(none):
    assert mixing.pareto_mix(none).count() == 0


# ---- 2, 4: repeats -------------------------------------------------------------------------------------------
def test_window_repeats(docs, rows):
    found = got(repeats.drop_repeated_windows(docs, cells=CELLS), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert found == brute.window_repeats(rows)


def test_rows_of_one_id_are_told_apart(spark, monkeypatch):
    """However many rows share an id: those that are unlike lose nothing to each other."""
    shared = " ".join(f"s{j}" for j in range(60))
    rows = [(None, f"{shared} {i}", "s", "en") for i in range(9)] + [(7, f"{i} {shared}", "s", "en") for i in range(9)]
    rows += [(None, " ".join(f"w{i}x{j}" for j in range(40)), "s", "en") for i in range(300)] + [(8, "cc by " * 3, "s", "en"), (8, "no license", "s", "en")]
    docs = frame(spark, rows).repartition(5)
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    bytes_columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    for most in (100_000, 1):
        monkeypatch.setattr("counterlens.llm.common.SHARED", most)
        found = repeats.drop_repeated_windows(docs, cells=CELLS).collect()
        assert sum(r["n_removed"] > 0 for r in found) == 17 and len(found) == len(rows)
        assert all(r["n_removed"] == 0 for r in found if r["n_words"] == 40)
        assert got(parsing.drop_repeated_bytes(docs, cells=CELLS), *bytes_columns) == brute.byte_repeats(rows)
        found = got(licenses.license_scan(docs).filter("doc_id = 8"), "n_base", "base_labels")
        assert found == [(0, ""), (3, "cc-by")]
    keys = [r["key"] for r in common.keyed_rows(docs).collect()]
    assert len(set(keys)) == len({t for _, t, _, _ in rows}) and {len(k) for k in keys} == {32}
    assert got(repeats.drop_repeated_windows(docs, cells=CELLS), *columns)


def test_full_sketch_loses_nothing(docs, rows):
    """A sketch whose cells all overflow lets everything through and the result stays."""
    found = got(repeats.drop_repeated_windows(docs, cells=repeats.SLICE, gram=3), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert found == brute.window_repeats(rows)


def test_byte_repeats(docs, rows):
    found = got(parsing.drop_repeated_bytes(docs, cells=CELLS), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == brute.byte_repeats(rows)


def test_repeats_of_nothing(none):
    assert repeats.drop_repeated_windows(none, cells=CELLS).count() == 0
    assert parsing.drop_repeated_bytes(none, cells=CELLS).count() == 0


# ---- 3, 5: tokens --------------------------------------------------------------------------------------------
def test_pieces_give_the_library_ids(tokenizer):
    with open(PATH, encoding="utf-8") as f:
        known = tokens.Encoder(f.read())
    texts = ["", " ", "a", " a", "a ", "a  b", "a \n b", "a\n b", "x  y", "don't  they'll 's", "<|endoftext|> z<|endoftext|>", "日本 語 　 x",
             "tab\there \x1c q", "a\u00a0 b \u2003c d\u3000 e", "\u0085 x \x85y", "ends\n x\n", "One.\nTwo, three.\n\nFour é, × ÷. ü.ö\nEnd. \n", "a.b,c .d ,e\u00a0", "x\u2003.\ny z\n", "1 22 333", "é́ …", "\U0001f600 \U0001f600"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, n = known.encode(data, offsets)
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert known.by_piece and n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert known.counts(data, offsets).tolist() == n.tolist()


def test_token_counts_and_cache(spark, docs, rows, tokenizer):
    cache = token_cache.new_cache(spark)
    want = sorted(((d[0], len((d[1] or "").encode()), len(x), len(x) > 1024) for d, x in zip(rows, brute.token_ids(rows, tokenizer))), key=repr)
    columns = ("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got(token_cache.token_counts(docs, PATH, cache), *columns) == want
    kept = spark.read.parquet(cache).count()
    assert kept == len({d[1] or "" for d in rows})
    assert got(token_cache.token_counts(docs, PATH, cache), *columns) == want
    assert spark.read.parquet(cache).count() == kept                    # nothing was left to encode


def test_token_counts_of_nothing(spark, none):
    assert token_cache.token_counts(none, PATH, token_cache.new_cache(spark)).count() == 0


@pytest.mark.parametrize("limit", [4, 6, 12])
def test_code_lengths_are_optimal_and_limited(limit):
    import heapq

    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    lengths = huffman.code_lengths(counts, limit)
    assert lengths[0] == 0 and lengths.max() <= limit
    assert sum(2.0 ** -int(x) for x in lengths[1:]) <= 1
    if limit == 12:
        heap = [int(c) for c in counts[1:]]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            heapq.heappush(heap, (a := heapq.heappop(heap)) + (b := heapq.heappop(heap)))
            cost += a + b
        assert int((counts * lengths).sum()) == cost


def test_code_round_trip():
    rng = np.random.default_rng(3)
    counts = np.array([1, 3000, 1, 1500])
    ids = rng.zipf(1.3, int(counts.sum())) % 5000
    lengths = huffman.code_lengths(np.bincount(ids, minlength=5000), 14)
    payload, offsets, marks = huffman.pack(ids, counts, huffman.canonical_codes(lengths), lengths)
    starts = np.concatenate([m + 8 * o for m, o in zip(marks, offsets)])
    sizes = np.concatenate([[min(huffman.STEP, c - a) for a in range(0, c, huffman.STEP)] for c in counts])
    assert (huffman.unpack(payload, starts, sizes, huffman.decode_table(lengths)) == ids).all()


def test_huffman_files(docs, rows, tokenizer):
    path = huffman.new_path(docs.sparkSession)
    found = got(huffman.round_trip(docs, PATH, queries.END_ID, path), "doc_id", "start", "n_tokens", "ids_crc32")
    assert found == brute.huffman_rows(rows, tokenizer, queries.END_ID)
    whole = huffman.read_ids(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    assert got(whole, *whole.columns) == found


def test_huffman_of_nothing(none):
    assert huffman.round_trip(none, PATH, queries.END_ID).count() == 0


# ---- 6: language ---------------------------------------------------------------------------------------------
def test_automaton_parses_like_substring_search():
    alphabet = language.Alphabet(["abracadabra banana"])
    sample = alphabet.read("abracadabra banana cabana")
    table = {"x": language.automaton(sample, alphabet.size)}
    parser = language.Parser(alphabet, table, {"x": 1.0})
    text = bytes(sample)
    for t in ("banana bread", "zzz", "abracadabra banana cabana", "a", "cabracabana dabra"):
        own = alphabet.read(t)
        assert parser.phrases([own])[0, 0] == brute.phrases(bytes(own), text)


def test_language_accuracy(spark, docs, rows):
    parser = language.train(docs)
    found = language.predictions(docs, parser).collect()
    import zlib

    assert len(found) == len(rows)
    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    lang = {d[0]: d[3] for d in rows if d[0] is not None and d[0] < 1000}
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in found if r["held_out"] and r["doc_id"] in lang]
    assert np.mean(held) > 0.95
    und = {r["doc_id"] for r in found if r["lang_pred"] == "und"}
    assert und == {1001, 1002, 1003}


def test_every_letter_of_the_samples_counts(spark):
    """Hundreds of letters a script: two languages that differ in rare letters alone, and texts by plain parsing."""
    rng = np.random.default_rng(6)
    latin = "the quick brown fox jumps over lazy dogs " * 40
    letters = {"a": [chr(0x4E00 + i) for i in range(600)], "b": [chr(0x5E00 + i) for i in range(600)], "c": [chr(0xAC00 + i) for i in range(600)]}
    words = {k: ["".join(rng.choice(v, 4)) for _ in range(150)] for k, v in letters.items()}
    text = lambda k: "".join(rng.choice(words[k], 50))
    rows = [(i, text("abc"[i % 3]) if i % 4 else latin, "s", "abc"[i % 3] if i % 4 else "en") for i in range(240)]
    parser = language.train(frame(spark, rows))
    assert parser.alphabet.size > 700 and sum(t.to.nbytes + t.owner.nbytes for t in parser.tables) < 1 << 24
    for k in "abc":
        assert parser.predict([text(k) for _ in range(20)])[0] == [k] * 20
    alphabet = language.Alphabet([t for _, t, _, _ in rows])
    sample = alphabet.read("".join(t + " " for _, t, _, _ in rows[1:40]))
    whole = "".join(map(chr, sample))
    one = language.Parser(alphabet, {"x": language.automaton(sample, alphabet.size)}, {"x": 1.0})
    for t in ("quick dogs", text("a")[:100], text("b")[:60] + "\u0436\u0436 the", rows[5][1]):
        own = alphabet.read(t)[:language.BLOCK]
        assert one.phrases([own])[0, 0] == brute.phrases("".join(map(chr, own)), whole)


def test_language_of_nothing(docs, none):
    assert language.predictions(none, language.train(none)).count() == 0
    assert {r["lang_pred"] for r in language.predictions(docs.limit(5), language.train(none)).collect()} == {"und"}


# ---- 7: licenses ---------------------------------------------------------------------------------------------
def test_base_phrases(docs, rows):
    found = got(licenses.license_scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert found == brute.licenses(rows)


def test_diagonals_bear_edits(spark):
    text = dict(licenses.TEMPLATES)["mit"].split()
    edited = text[:5] + ["kindly"] + text[5:]
    rows = [(1, "Intro words. " + " ".join(text), "a", "en"), (2, " ".join(edited), "a", "en"), (3, " ".join(text[:4]), "a", "en"),
            (4, " ".join(w for p in zip(text, text[::-1]) for w in p), "a", "en")]
    found = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.license_scan(frame(spark, rows)).collect()}
    assert found[1] == ("mit", 1.0) and found[2][0] == "mit" and found[2][1] < 1
    assert found[3] == ("", 0.0) and found[4] == ("", 0.0)


def test_licenses_of_nothing(none):
    assert licenses.license_scan(none).count() == 0


# ---- 8: SimHash ----------------------------------------------------------------------------------------------
def test_simhash_components(spark, docs, rows):
    found = simhash.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fp"), "component_id")
    assert got(found, "doc_id", "fp", "component_id") == brute.simhash(rows)


def test_chain_index_finds_every_close_pair():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base.copy()
    for k in range(300):
        for b in rng.choice(64, k % 7, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    fps = np.unique(np.concatenate([base, near]))
    keys = simhash.chain_keys(fps)
    order = np.argsort(keys.reshape(-1), kind="stable")
    a, b = simhash.bucket_links(keys.reshape(-1)[order], np.repeat(fps, keys.shape[1])[order])
    close = {(int(x), int(y)) for i, x in enumerate(fps) for y in fps[:i] if int(x ^ y).bit_count() <= 4}
    assert {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist())} == close


def test_big_bucket_keeps_components():
    center = 0x0123456789ABCDEF
    fps = np.array(sorted({center ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(20)}), np.uint64)
    keys = simhash.chain_keys(fps)
    order = np.argsort(keys.reshape(-1), kind="stable")
    a, b = simhash.bucket_links(keys.reshape(-1)[order], np.repeat(fps, keys.shape[1])[order])
    nodes, roots = simhash.forest(a, b)
    assert set(nodes.tolist()) | set(roots.tolist()) == set(fps.tolist()) and len(set(roots.tolist())) == 1


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (100, 101), (7, 7), (5, 6), (6, 5)]
    found = {(r["node"], r["root"]) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {(i, 0) for i in range(41)} | {(i, 99) for i in (99, 100, 101)}


def test_simhash_of_nothing(none):
    assert simhash.near_duplicates(none).count() == 0


# ---- 9: benchmark --------------------------------------------------------------------------------------------
def test_contamination(spark, docs, rows):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()]
    items += [(900, None), (901, "..."), (902, "SHARED3 shared4"), (None, " ".join(f"shared{i}" for i in range(20, 35))), (902, "zzz")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = positions.contamination(docs, benchmark)
    assert got(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256") == brute.contamination(rows, items)
    empty = positions.contamination(docs, benchmark.limit(0))
    assert empty.agg(F.sum("n_hit")).first()[0] == 0 and empty.count() == len(rows)


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, "zero " + item, "a", "en"), (2, "one two and three four five six seven eight nine ten", "a", "en"),
            (3, "one two three four a b c d five six seven eight nine ten", "a", "en")]
    found = {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in
             positions.contamination(frame(spark, rows), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    assert found == {1: (10, 0), 2: (0, 1), 3: (0, 0)}


def test_contamination_of_nothing(spark, none):
    assert positions.contamination(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# ---- 10: neighbours ------------------------------------------------------------------------------------------
def vector_rows():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 12))
    rows = [(i, [float(x) for x in centres[i % 8] + 0.4 * rng.normal(size=12)]) for i in range(700)]
    same = [float(x) for x in rng.normal(size=12)]
    rows += [(1000 + i, same) for i in range(300)]
    rows += [(2000, None), (2020, [0.0] * 12), (2040, [float("nan")] * 12), (2060, [None] + [1.0] * 11), (2080, [1.0, 2.0]), (None, [1.0] * 12)]
    return rows


def test_neighbours_recall(spark, monkeypatch):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    want = brute.neighbours([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    found = {}
    for r in vector_tree.nearest(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(want)
    hits = 0
    for q, own in found.items():
        own.sort()
        assert [x[0] for x in own] == list(range(1, 21))
        assert own == sorted(own, key=lambda x: (-x[2], x[1]))
        hits += len({x[1] for x in own} & {x[0] for x in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_few_vectors_are_all_returned(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (3, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert got(vector_tree.nearest(df, F.col("vec_id") % 20 == 0), "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 0.5), (0, 2, 3, -1.0)]
    assert vector_tree.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_small_leaves_are_topped_up(spark, monkeypatch):
    """However few leaves the calibration asks for, every query gets all of its k neighbours."""
    monkeypatch.setattr(vector_tree, "calibrated_visits", lambda *a: 1)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(600, 6)) * 0.01 + 1, *[rng.normal(size=(3, 6)) * 0.01 + c for c in rng.normal(size=(60, 6)) * 30]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(20, x[20].tolist())] * 30, "vec_id long, embedding array<double>")
    found = {}
    for r in vector_tree.nearest(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert len(found) == 39 and all(len(v) >= 20 and i not in v for i, v in found.items())


# ---- the pipeline --------------------------------------------------------------------------------------------
def test_pipeline_stages(spark, docs, rows):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()]
    state, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in state.select("doc_id", "text", "source", "lang").collect()]
        out = stage(spark, state, SMALL)
        assert out.columns == docs.columns
        state = spark.createDataFrame(out.collect(), SCHEMA)
        after = [tuple(r) for r in state.select("doc_id", "text", "source", "lang").collect()]
        seen[name] = before, after
    before, after = seen["language_id"]
    assert sorted(after, key=repr) == sorted((r for r in before if any(c.isalpha() for c in r[1] or "")), key=repr)
    before, after = seen["near_duplicates"]
    best = {}
    for g, r in zip(five_word_groups([r[1] for r in before]), before):
        best[g] = min(best.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    assert sorted((r[0] is None, r[0] or 0) for r in after) == sorted(best.values())
    before, after = seen["decontamination"]
    hit = {r[0] for r in brute.contamination(before, items) if r[2] > 0}
    assert hit and sorted(after, key=repr) == sorted((r for r in before if r[0] not in hit), key=repr)
    before, after = seen["mixture"]
    _, target = brute.targets(before)
    assert set(after) <= set(before) and len(after) > 0
    words = sum(len(brute.SPACE.findall(r[1] or "")) for r in after)
    assert words == pytest.approx(sum(target.values()), rel=0.1)
    last = corpus_pipeline.STAGES[-1][1](spark, state, SMALL)
    assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and last.count() == len(after)


def five_word_groups(texts, least=0.8):
    sets = []
    for t in texts:
        w = brute.SPACE.findall((t or "").translate(brute.LOWER))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    return [find(x) for x in range(len(texts))]


def test_near_duplicates_by_shingles(spark, rows):
    """Edits spread over a text leave 0.8 of its five-word shingles but move more than four bits of its SimHash."""
    base = [f"word{i}" for i in range(400)]
    some = [" ".join("other" if i in at else w for i, w in enumerate(base)) for at in ((), (50, 150, 250), (20, 120, 220, 320, 380), range(0, 400, 30))]
    short = ["a b c d e f g h i j k l", "A  b c d e f g h i j k l", "a b c d e f g h i j k m", "a b c d", "a b c d e", None, " "]
    more = [(3000 + i, t, "src0", "en") for i, t in enumerate(some + short)]
    more += [(3100, "one id with one text " * 3, "src0", "en"), (3100, "and the same id over a different one", "src0", "en"),
             (None, some[0], "src0", "en"), (None, "only null ids here " * 4, "src0", "en"), (None, "only null ids here " * 4, "src0", "en")]
    table = rows + more
    group = five_word_groups([r[1] for r in table])
    best = {}
    for g, r in zip(group, table):
        best[g] = min(best.get(g, (True, 0, "")), (r[0] is None, r[0] or 0, "" if r[0] is not None else r[1]), key=lambda k: k[:2])
    out = corpus_pipeline.near_duplicates(spark, frame(spark, table).repartition(5), SMALL)
    ids = sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None)
    assert ids == sorted(i for none, i, _ in best.values() if not none) and ids.count(3100) == 2
    assert len(out.collect()) == len(best)
    assert len({brute.fingerprint(t) for t in some[:2]}) == 2 and (brute.fingerprint(some[0]) ^ brute.fingerprint(some[2])).bit_count() > 4


def test_decisions_hold_for_rows_not_ids(spark):
    """Rows without an id, and rows that share one, are each judged and mixed by themselves."""
    item = pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()[0]["text"]
    bad, clean = "Before it " + item + " after it", "nothing of any benchmark in here"
    rows = [(None, bad, "a", "en"), (None, clean, "a", "en"), (7, bad, "a", "en"), (7, clean, "a", "en"), (8, clean, "a", "en"), (8, clean, "a", "en")]
    out = corpus_pipeline.decontamination(spark, frame(spark, rows), SMALL)
    assert got(out, "doc_id", "text") == sorted([(None, clean), (7, clean), (8, clean), (8, clean)], key=repr)
    rows = [(None, f"t{i} " * (20 + i % 7), "a", "en") for i in range(300)] + [(5, f"u{i} " * 30, "b", "en") for i in range(300)]
    rows += [(6, "same row " * 10, "b", "en")] * 40
    _, target = brute.targets(rows)
    words = {}
    for r in corpus_pipeline.mixture(spark, frame(spark, rows), SMALL).collect():
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    assert set(words) == set(target)
    for s, n in words.items():
        assert n == pytest.approx(target[s], rel=0.03), (s, n, target[s])


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
