"""One small case for each finding of a review that changed the code."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterlens.operators import resampling as S
from counterlens.operators import rules as R
from counterlens.operators import vectors as V

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_replicate_means_over_several_blocks_draw_as_sql_does(spark, monkeypatch):
    monkeypatch.setattr(S, "SPAN", 3000)
    n, reps, rng = S.BLOCK + 900, 6, np.random.default_rng(3)
    v = rng.normal(size=(n, 2))
    df = spark.createDataFrame([(f"r{i}", x.tolist()) for i, x in enumerate(v)], "k string, v array<double>")
    got = {r.b: r.mean_vec for r in V.replicate_means(df, "k", "v", reps, 7).collect()}
    idx = S.index_clusters(df.select("k"), "k", []).toPandas().sort_values("idx")["k"]
    order = v[[int(k[1:]) for k in idx]]
    assert sorted(got) == list(range(reps))
    for b in range(reps):
        drawn = S.draws_in_block(n, np.array([b]), n, 7)[0]
        assert got[b] == pytest.approx(order[drawn].mean(axis=0).tolist())


def test_a_line_break_after_a_letter_is_no_end_of_text(spark):
    """$ matches before a last line break: the word after "é\\n" is not inside another word."""
    docs = spark.createDataFrame([(1, "le café\nAnna dort"), (2, "caféAnna"), (3, "x. Anna")], "id int, t string")
    names = spark.createDataFrame([("anna",)], "name string")
    assert sorted((r.id, r.first_name) for r in R.first_name_hits(docs, "id", "t", names).collect()) == [(1, "Anna"), (3, "Anna")]


def test_pairing_candidates_leave_out_no_more_than_forty_records(spark):
    from counterlens.functions.keyed import digest, hash15
    from counterlens.queries import registry, splits
    sf = "/root/testdata/sf0.01"
    r = splits.recs(spark, sf).select("record_id", digest(splits.SEED, F.col("record_id")).alias("d"), *[
        (F.pmod(hash15(F.col("record_id"), F.lit(e), F.lit(t)), F.lit(20)) != 0).alias(e + t) for e in ("explicit", "proxy") for t in ("v1", "v2")]).collect()
    probes = {x.record_id for x in sorted(r, key=lambda x: (x.d, x.record_id))[:40]}
    want = {x.record_id for x in r if all(x[2:])} - probes
    assert {x.record_id for x in registry.QUERIES["j21_pairing_candidates"](spark, sf).collect()} == want


def test_what_the_fingerprints_join_is_not_tried_under_lists(spark, monkeypatch):
    import hashlib

    from counterlens.llm import similar
    texts = [" ".join(f"w{i}" if i != 7 * k else f"x{k}" for i in range(400)) for k in range(40)]
    rows = [(hashlib.md5(t.encode()).digest(), t) for t in texts]
    seen, settled = [], similar._settled

    def counted(own, pairs):
        seen.append(pairs.count())
        return settled(own, pairs)

    monkeypatch.setattr(similar, "_settled", counted)
    found = similar.similar_texts(spark.createDataFrame(rows, "tid binary, text string")).collect()
    assert len({r.root for r in found}) == 1 and len(found) == 40
    assert seen[0] > 0 and sum(seen) < 80
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_record_sums_move_vectors_as_they_are(spark):
    rng = np.random.default_rng(5)
    v, k, s = rng.normal(size=(60, 3)).astype(np.float32), rng.integers(0, 7, 60), rng.integers(-1, 2, 60)
    df = spark.createDataFrame([(int(a), int(b), x.tolist()) for a, b, x in zip(k, s, v)], "k int, s int, v array<float>").repartition(4)
    got = {r.k: r for r in V.record_sums(df, ["k"], "v", {"x": F.col("s"), "y": F.lit(0.5)}).collect()}
    for a in set(k):
        assert got[a].x == pytest.approx((s[k == a, None] * v[k == a].astype(float)).sum(axis=0).tolist())
        assert got[a].y == pytest.approx((0.5 * v[k == a].astype(float)).sum(axis=0).tolist()) and got[a].n == (k == a).sum()


def test_hold_out_keys_need_no_states_and_readings_gather_no_blocks(spark):
    from counterlens.queries import directions
    sf = "/root/testdata/sf0.001"
    keys = directions.pair_rows(directions.domain_texts(spark, sf, False))
    assert "embedding" not in keys._jdf.queryExecution().optimizedPlan().toString()
    assert {"source", "name_folds", "template", "sign", "w"} <= set(keys.columns) and keys.filter("sign = 1").count() == keys.filter("sign = -1").count()


def test_cells_read_from_what_they_share_have_the_same_features(spark):
    """The clause earlier in the body, other surroundings, no clause, none at all, runs that reach the clause."""
    from counterlens.operators import blocks as B
    cells = {1: [("One. ab Two!", "ab"), ("One. cd. Two!", "cd."), ("One. . Two!", "."), ("One.  x  Two!", " x ")],
             2: [("ab ab", "ab"), ("cd ab", "cd"), ("ab cd", "cd"), ("", "ab")], 3: [("plain", ""), ("plain", "lain")], 4: [(None, "a"), ("xax", "a"), ("xbx", None)],
             5: [("aXe", "X"), ("aie", "i"), ("a\n\U0001F600e", "\n\U0001F600"), ("a!e", "!"), ("aXe", "Xe")], 6: [("X tail", "X"), ("io tail", "io")], 7: [("head?X", "X"), ("head?!", "!")]}
    df = spark.createDataFrame([(k, v) for k, v in cells.items()], "id int, cells array<struct<text string, clause string>>")
    first = F.get("cells", F.lit(0))
    df = df.withColumn("a", B.surroundings(first["text"], first["clause"])).withColumn("a", B.read_surroundings("a"))
    both = df.select(B.cell_features("cells", "a").alias("x"), F.transform("cells", lambda c: B.gate_features(c["text"], c["clause"])).alias("y"))
    assert both.schema["x"].dataType.elementType.simpleString() == both.schema["y"].dataType.elementType.simpleString()
    for r in both.collect():
        assert r.x == r.y


def test_counts_of_the_first_and_the_next_rows_need_no_whole_ranking(spark):
    """Equal to row_number over all rows, at every size; no window stands over a whole group."""
    from counterlens.operators import ranking
    df = spark.range(3000).selectExpr("id", "id % 2 AS g", "CASE WHEN id % 7 > 0 THEN id % 7 END AS v")
    digest = F.sha2(F.concat_ws("|", "g", "id"), 256)
    rows = sorted((r.d, r.id, r.g, r.v) for r in df.withColumn("d", digest).collect())
    for k in (0, 1, 400, 750, 1500, 2000):
        out = ranking.first_and_next(df, digest, ["id"], ["g"], "v", spark.createDataFrame([(k,)], "k long"))
        want = {}
        for g in (0, 1):
            for i, r in enumerate([r for r in rows if r[2] == g][:2 * k]):
                n = want.setdefault((g, r[3]), [0, 0])
                n[i >= k] += 1
        assert {(r.g, r.v): [r["first"], r["next"]] for r in out.collect()} == want


def test_random_directions_are_read_where_the_embeddings_lie(spark):
    """No array of floats is dealt out by record, and nothing is fitted."""
    from counterlens.queries import registry
    plan = registry.QUERIES["r9_random_floor"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    dealt = [plan[i + 1] for i, line in enumerate(plan) if "RepartitionByExpression" in line]
    assert any("AS off" in line or "AS reward" in line for line in dealt) and not any("embedding" in line.split("AS ")[-1] for line in dealt)
    assert not any("embedding#" in line.split("] ")[0] and "RepartitionByExpression" in line for line in plan)


def test_insertion_points_look_for_boundaries_once(spark):
    """One pass over a text's pieces, for the cut and for whether there is one."""
    from counterlens.functions import text as T
    from counterlens.queries import registry
    plan = registry.QUERIES["p16_insertion_points"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
    texts = [(1, "A b. C d? E!  F"), (2, "Dr. No. x"), (3, ". a.b. c"), (4, "x U.S. y. I. z"), (5, None), (6, ""), (7, "e.g. a-b.c. \" d.\" e"), (8, "é.g. x1a. y")]
    got = {r.id: r.b for r in spark.createDataFrame(texts, "id int, t string").select("id", T.sentence_boundaries("t").alias("b")).collect()}
    assert got[5] is None and got[6] == [] and got[1] == [4, 9, 12]


@pytest.mark.parametrize("name", ["v17_v18_geometry", "a29_contrast_lengths", "v7_cross_fitted_directions"])
def test_sums_over_records_gather_no_record(spark, name, monkeypatch):
    """A record's states are not brought together where only sums over records are asked for."""
    from counterlens.queries import registry, vectors
    monkeypatch.setattr(vectors, "contrasts", None)
    out = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "collect_list(struct(" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() > 0


def test_coded_sums_add_every_place_of_a_row(spark, monkeypatch):
    """Rows in several groups or none, chunks of a few rows, a row without a vector."""
    monkeypatch.setattr(V, "CELLS", 12)
    rng = np.random.default_rng(5)
    v, code = rng.normal(size=(300, 3)).astype(np.float32), rng.integers(0, 40, 300)
    df = spark.createDataFrame([(int(c), x.tolist()) for c, x in zip(code, v)] + [(1, None)], "c int, v array<float>").repartition(3)
    shift = rng.normal(size=(40, 3))
    places = lambda c: (shift[c], [(c % 7 - 1, np.where(c % 2, 1.0, -1.0)), (np.where(c < 20, c % 3, -1), np.full(len(c), 0.5))])
    want, n = np.zeros((7, 3)), np.zeros(7, int)
    for c, x in zip(code, v.astype(float)):
        for g, s in ((c % 7 - 1, 1 if c % 2 else -1), (c % 3 if c < 20 else -1, 0.5)):
            if g >= 0:
                want[g] += s * (x + shift[c])
                n[g] += 1
    got = {r.grp: r for r in V.coded_sums(df, "c", "v", places, 7).collect()}
    assert sorted(got) == np.flatnonzero(n).tolist()
    for g, r in got.items():
        assert r.sum_vec == pytest.approx(want[g].tolist()) and r.n == n[g]


def test_pair_sums_move_no_states_and_repeat_no_vectors(spark):
    """Equal to the sums over pair rows with their states; only numbers and codes go to the embeddings."""
    from counterlens.queries import directions as D
    sf, by = "/root/testdata/sf0.001", ["fit", "source", "name_folds", "template"]
    sums = D.pair_sums(spark, sf)
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Summarizer" not in plan.split("MapInArrow")[-1] and "zip_with" not in plan
    key = lambda r: (r.fit, r.source, tuple(r.name_folds), r.template)
    want = {key(r): r for r in V.vector_sums(D.pair_rows(D.domain_states(spark, sf)), by, "state", "sign").collect()}
    got = {key(r): r for r in sums.collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert r.sum_vec == pytest.approx(want[k].sum_vec, abs=1e-9) and 2 * r.n == want[k].n


def test_counts_of_equal_scores_meet_before_they_move(spark, monkeypatch):
    """As many rows of counts as there are scores and sides in a task, not as there are records; the AUCs are those of single records."""
    from pyspark.sql import GroupedData
    monkeypatch.setattr(S, "HELD", 70)
    n, reps, rng = 600, 30, np.random.default_rng(9)
    score, y, g = rng.integers(0, 5, (n, 2)) / 4, rng.integers(0, 2, n).astype(bool), ("a", None)
    df = spark.createDataFrame([(f"r{i}", g[k], float(score[i, k]), bool(y[i])) for i in range(n) for k in range(2)], "k string, g string, s double, y boolean")
    moved, apply = [], GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, *a: (moved.append(self._df), apply(self, *a))[1])
    got = {(r.g, r.b): r.auc for r in S.auc_replicates(df, ["g"], "k", "s", "y", reps, 3, block=200).collect()}
    assert moved[0].count() < n
    w = {}
    for flag, salt in ((True, 1), (False, 2)):
        side = df.filter(F.col("y") == F.lit(flag)).select("k").distinct()
        w |= {r.k: np.frombuffer(bytes(r.w), np.uint8).astype(float) for r in S.draw_counts(side, "k", [], reps, 3, salt).collect()}
    w = np.stack([w[f"r{i}"] for i in range(n)])
    for k in range(2):
        s = score[:, k]
        won = (s[y][:, None] > s[~y][None, :]) + 0.5 * (s[y][:, None] == s[~y][None, :])
        for b in range(reps):
            assert got[g[k], b] == pytest.approx(w[y, b] @ won @ w[~y, b] / (w[y, b].sum() * w[~y, b].sum()))


def test_buckets_are_found_by_halving(spark):
    from counterlens.operators import ranking
    cuts = sorted(np.random.default_rng(1).integers(0, 50, 100).astype(float).tolist())
    df = spark.createDataFrame([(cuts, float(x) / 2) for x in range(-3, 105)] + [(cuts, None)], "c array<double>, x double")
    for r in df.select("x", ranking.count_below("c", F.col("x"), 100).alias("n")).collect():
        assert r.n == (0 if r.x is None else sum(c < r.x for c in cuts))


def test_known_components_go_on_as_stars(spark, monkeypatch):
    """Stars end after one round; without new links nothing is written; old and new links together give the same components."""
    from counterlens.llm import components as C
    from counterlens.llm import similar
    written, store = [], C.stored
    monkeypatch.setattr(C, "stored", lambda df, name: (written.append(name), store(df, name))[1])
    rows = lambda df: sorted((r.node, r.root) for r in df.collect())
    roots = C.components(spark.createDataFrame([(1, 2), (1, 3), (4, 5), (4, 6)], "a long, b long"))
    assert written.count("large") == 1 and rows(roots) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4)]
    assert similar._joined(roots, spark.createDataFrame([], "a long, b long")) is roots and written.count("large") == 1
    more = spark.createDataFrame([(3, 6), (7, 8), (8, 9)], "a long, b long")
    assert rows(similar._joined(roots, more)) == [(i, 1) for i in range(1, 7)] + [(7, 7), (8, 7), (9, 7)]


WORKER = """
import re, sys
import numpy as np, pyarrow as pa
import public_tokenizers
from counterlens.llm import huffman, similar

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches(rows, seed):
    rng = np.random.default_rng(seed)
    for _ in range(rows // 1000):
        words = np.array([f"w{x:x}" for x in rng.integers(0, 1 << 40, 100_000)]).reshape(1000, 100)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1000)), pa.array([" ".join(x) for x in words])], names=["doc_id", "text"])

for _ in similar._shingles(batches(1000, 0)):
    pass
spec = open(public_tokenizers.path("byte_bpe_50k.json")).read()
for _ in huffman._encode(spec, 2)(batches(1000, 1)):
    pass
for _ in similar._shingles(batches(1000, 0)):
    pass
before = held()
for _ in huffman._encode(spec, 2)(batches(4000, 2)):
    pass
for _ in similar._shingles(batches(1000, 0)):
    pass
print(before, held())
"""


def test_a_worker_returns_what_its_tasks_took():
    """Workers outlive tasks: after a stage of tokens, a stage of shingles holds little more than the interpreter and its libraries."""
    import subprocess
    import sys
    out = subprocess.run([sys.executable, "-c", WORKER], capture_output=True, text=True, check=True, cwd=ROOT).stdout
    before, after = map(float, out.split())
    assert before < 110 and after < 110


def test_texts_are_encoded_in_short_batches(spark, monkeypatch):
    """The token files are written from batches of at most ROWS rows; the session's own setting stays."""
    import public_tokenizers
    from counterlens.llm import huffman
    seen, store, name = [], huffman.stored, "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(huffman, "stored", lambda df, n: (seen.append(spark.conf.get(name)), store(df, n))[1])
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    assert huffman.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), 2).count() == 2
    assert seen == ["1000"] and spark.conf.get(name) == before


def test_known_pieces_stay_in_order():
    """Pieces learned in many steps are found again, with the ids of whole texts."""
    import public_tokenizers
    from counterlens.llm.tokens import Encoder
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        known = Encoder(f.read())
    rng = np.random.default_rng(5)
    for _ in range(6):
        texts = [" ".join(f"{x:x}" for x in rng.integers(0, 3000, 50)) for _ in range(20)]
        raw = [t.encode() for t in texts]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        ids, counts = known.encode(data, offsets)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [known.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert (np.diff(known.name.astype(object)) > 0).all() and len(known.name) == len(known.check) == len(known.number) == known.count
