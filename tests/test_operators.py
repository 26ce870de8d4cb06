"""Brute-force checks, planted effects, refusals and layout invariance."""

import hashlib
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterlens.functions import text as T
from counterlens.functions import vectors as X
from counterlens.functions.keyed import digest
from counterlens.operators import blocks as B
from counterlens.operators import comparative as C
from counterlens.operators import contracts as Q
from counterlens.operators import decision as D
from counterlens.operators import erasure as E
from counterlens.operators import guardrail as G
from counterlens.operators import ranking as R
from counterlens.operators import resampling as S
from counterlens.operators import splits as P
from counterlens.operators import vectors as V
from counterlens.operators.design import CREDIT, EDUCATION, HIRING, stage_clauses


@pytest.fixture
def skewed(spark):
    """One group holds two thirds of the rows, one has a null key."""
    rng = random.Random(1)
    rows = [(f"k{i}", "hot" if i % 3 else (None if i % 6 else f"g{i % 5}"), float(rng.randrange(20)), rng.random() < 0.4)
            for i in range(400)]
    return spark.createDataFrame(rows, "key string, grp string, score double, pos boolean")


def test_hash_rank_equals_row_number(spark, skewed):
    got = R.hash_rank(skewed, digest(5, F.col("key")), ["key"], ["grp"], "rk")
    skewed.createOrReplaceTempView("skewed")
    want = spark.sql("select key, row_number() over (partition by grp order by sha2(concat('5|', key), 256), key) rk from skewed")
    assert {(r.key, r.rk) for r in got.select("key", "rk").collect()} == {(r.key, r.rk) for r in want.collect()}


@pytest.mark.parametrize("buckets", [1, 4, 16])
def test_auc_equals_all_pairs(skewed, buckets):
    got = {r.grp: r.auc for r in R.auc(skewed, ["grp"], "score", "pos", buckets).collect()}
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r.grp, ([], []))[0 if r.pos else 1].append(r.score)
    for g, (p, q) in groups.items():
        want = sum((a > b) + 0.5 * (a == b) for a in p for b in q) / (len(p) * len(q)) if p and q else None
        assert got[g] is None if want is None else math.isclose(got[g], want, abs_tol=1e-12)


def test_ordered_rank_and_running_totals(skewed):
    rows = skewed.select("key", "grp", "score")
    ranked = R.ordered_rank(rows, ["grp"], "score", ["key"], "rk", 4).collect()
    by = {}
    for r in ranked:
        by.setdefault(r.grp, []).append(r)
    for members in by.values():
        members.sort(key=lambda r: r.rk)
        assert [r.rk for r in members] == list(range(1, len(members) + 1))
        assert [(r.score, r.key) for r in members] == sorted((r.score, r.key) for r in members)


def test_replicates_do_not_depend_on_partitions(spark, skewed):
    def run(parts):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        out = S.cluster_bootstrap(skewed.repartition(parts), "key", {"n": F.lit(1.0), "s": F.col("score")},
                                  {"mean": lambda s: s["s"] / s["n"]}, [], 100, 3).collect()[0]
        spark.catalog.clearCache()
        return round(out.estimate, 9), round(out.ci_low, 9), round(out.ci_high, 9), out.n_clusters
    try:
        assert run(1) == run(7) == run(16)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_bootstrap_against_brute_force(spark, skewed):
    """The same draws applied by hand."""
    out = S.cluster_bootstrap(skewed, "key", {"n": F.lit(1.0), "s": F.col("score")}, {"mean": lambda s: s["s"] / s["n"]}, [], 50, 3).first()
    import hashlib
    rows = sorted(skewed.collect(), key=lambda r: hashlib.sha256(r.key.encode()).hexdigest())
    m = S.MODULUS
    fifth = lambda x: pow(x % m, 5, m)
    means = []
    for b in range(50):
        idx = [fifth(fifth(fifth(3 + S.ROUND_KEYS[0] + b) + S.ROUND_KEYS[1] + j) + S.ROUND_KEYS[2]) * len(rows) // m for j in range(len(rows))]
        means.append(np.mean([rows[i].score for i in idx]))
    assert math.isclose(out.ci_low, np.percentile(means, 2.5)) and math.isclose(out.ci_high, np.percentile(means, 97.5))


def test_single_cluster_has_no_interval(spark):
    one = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, x double")
    r = S.cluster_bootstrap(one, "k", {"n": F.lit(1.0), "s": F.col("x")}, {"mean": lambda s: s["s"] / s["n"]}, [], 20).first()
    assert r.estimate == 1.5 and r.ci_low is None and r.n_boot_valid == 0


def _counts(spark, n, replicates, seed):
    rows = S.draw_counts(spark.range(n), "id", [], replicates, seed).collect()
    return {r["id"]: np.frombuffer(bytes(r["w"]), np.uint8) for r in rows}


@pytest.mark.parametrize("block", [4096, 64])
def test_draws_are_uniform(spark, monkeypatch, block):
    """Every replicate draws as often as there are levels, whatever the number of blocks, and all levels alike."""
    monkeypatch.setattr(S, "BLOCK", block)
    w = np.stack(list(_counts(spark, 250, 800, 11).values()))
    assert w.shape == (250, 800) and (w.sum(axis=0) == 250).all()
    chi2 = ((w.sum(axis=1) - 800.0) ** 2 / 800).sum()
    assert 160 < chi2 < 350 and abs((w == 0).mean() - math.exp(-1)) < 0.01


def test_blocks_agree_with_a_plain_recount(spark, monkeypatch):
    """Sums, crossed sums and AUCs of several blocks equal those of the draw counts, replicate by replicate."""
    monkeypatch.setattr(S, "BLOCK", 32)
    rng = np.random.default_rng(4)
    n, reps = 150, 60
    score, y, other = rng.integers(0, 40, n) / 10, rng.integers(0, 2, n).astype(bool), rng.integers(0, 45, n)
    df = spark.createDataFrame([(i, float(s), bool(p), int(o)) for i, (s, p, o) in enumerate(zip(score, y, other))], "id long, s double, y boolean, o long")
    w = _counts(spark, n, reps, 5)
    sums = {r["b"]: r["s"] for r in S.replicate_sums(df, "id", ["s"], [], reps, 5).collect()}
    assert all(sums[b] == pytest.approx(sum(w[i][b] * score[i] for i in range(n))) for b in range(reps))

    counts = {}
    for flag, salt in ((True, 1), (False, 2)):
        part = S.draw_counts(df.filter(F.col("y") == F.lit(flag)).select("id"), "id", [], reps, 5, salt).collect()
        counts |= {r["id"]: np.frombuffer(bytes(r["w"]), np.uint8).astype(float) for r in part}
    found = {(r["g"], r["b"]): r["auc"] for r in S.auc_replicates(df.withColumn("g", F.lit("x")), ["g"], "id", "s", "y", reps, 5, block=20).collect()}
    for b in range(reps):
        wins = sum(counts[i][b] * counts[j][b] * ((score[i] > score[j]) + 0.5 * (score[i] == score[j])) for i in np.flatnonzero(y) for j in np.flatnonzero(~y))
        pos, neg = sum(counts[i][b] for i in np.flatnonzero(y)), sum(counts[j][b] for j in np.flatnonzero(~y))
        assert found["x", b] == pytest.approx(wins / (pos * neg))


def test_sentence_boundaries_by_hand(spark):
    texts = ['Dr. Huang met J. Smith. "Yes." He said e.g. no. So did I. The E.C. system fails. Is it? Yes!\nEnd', "no mark", "a. b",
             '"Hi!" ok.', "One.\n\nTwo. Three.", "", "U.S. law. Ok"]

    def walk(body):
        out = []
        for i in range(len(body) - 1):
            ch, nxt = body[i], body[i + 1]
            if nxt not in " \n":
                continue
            if ch in "\"'" and i and body[i - 1] in ".?!":
                out.append(i + 1)
            elif ch in "?!":
                out.append(i + 1)
            elif ch == ".":
                m = re.search(r"([A-Za-z][A-Za-z.]*)$", body[:i])
                w = m.group(1) if m else ""
                short = len(w) == 1 and w.isupper() and w != "I"
                dotted = "." in w and nxt == " " and all(len(p) == 1 for p in w.split("."))
                if not (w.lower() in T.ABBREVIATIONS or short or dotted):
                    out.append(i + 1)
        return out

    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", T.sentence_boundaries("text").alias("b")).collect():
        assert list(r.b) == walk(r.text), r.text


def test_scrub(spark):
    cases = {
        "Dr. Valorie Knoop is a surgeon. She has her own clinic. Call Valorie Knoop on 555-123-4567 or v@x.org, www.k.com. Valorie's son.":
            ("The applicant is a surgeon. They have their own clinic. Call the applicant on [phone] or [email], [url]. The applicant's son.", True),
        "He was born here. HERS is  big.": ("They were born here. Theirs is big.", False),
        "The museum is old. Mrs. Smith won.": ("The museum is old. Smith won.", False),
        "Ihé été hers": ("Ihé été theirs", False),
    }
    df = T.scrub(spark.createDataFrame([(k,) for k in cases], "text string"), "text")
    for r in df.collect():
        assert (r.body, r.name_resolved) == cases[r.text]
    again = T.scrub(df.select(F.col("body").alias("text")), "text").collect()
    assert all(r.text == r.body for r in again)


def test_first_names_skip_places(spark):
    from counterlens.operators.rules import first_name_hits
    texts = [("a", "We met Denver in May. University of Denver."), ("b", "at Denver University"), ("c", "Wisconsin-Madison"),
             ("d", "MADISON and madison"), ("e", "with DeAndre today"), ("f", "Madison University"), ("g", "Éloise Denverly")]
    names = spark.createDataFrame([("Denver",), ("Madison",), ("Deandre",), ("loise",)], "name string")
    got = {r.id: r.first_name for r in first_name_hits(spark.createDataFrame(texts, "id string, t string"), "id", "t", names).collect()}
    assert got == {"a": "Denver", "e": "DeAndre"}


def test_derangement(spark):
    rows = [(f"r{i}", "a" if i < 60 else "b" if i < 110 else "cd"[i % 2]) for i in range(150)]
    out = P.derangement(spark.createDataFrame(rows, "key string, label string"), "key", "label", 4, [("c", "d")]).collect()
    assert sorted(r.target for r in out) == sorted(r.label for r in out) and len(out) == 150
    assert all(r.target != r.label and {r.target, r.label} != {"c", "d"} for r in out)


def test_settled_pairs_respect_the_condition(spark):
    rows = [(f"r{i}", "g", f"n{i % 3}" if i % 2 else "n0", "strong_strong") for i in range(90)]
    out = P.settle_pairs(spark.createDataFrame(rows, "key string, grp string, name string, pool string"), "key", "grp", 2, "name").collect()
    name = {r[0]: r[2] for r in rows}
    used = [k for r in out for k in (r.x, r.y)]
    assert len(used) == len(set(used)) and all(name[r.x] != name[r.y] for r in out)
    assert len(out) == 30                                   # 60 share a name, so 30 others is all that can be met


def test_settled_pairs_are_as_many_as_possible(spark):
    four = [("r0", "g", "a", "weak_weak"), ("r1", "g", "a", "weak_weak"), ("r2", "g", "b", "weak_weak"), ("r3", "g", "b", "weak_weak")]
    cross = [(f"s{i}", "g", "ab"[i % 2], "strong_weak:strong") for i in range(20)] + [(f"w{i}", "g", "ab"[i % 2], "strong_weak:weak") for i in range(20)]
    pooled = spark.createDataFrame(four + cross + [("u", "g", "a", "unused")], "key string, grp string, name string, pool string")
    for seed in range(3):
        pairs = P.settle_pairs(pooled, "key", "grp", seed, "name")
        assert {r.pairing: r["count"] for r in pairs.groupBy("pairing").count().collect()} == {"weak_weak": 2, "strong_weak": 20}
    assert [(r.key, r.reason) for r in P.unpaired(pooled, pairs, "key").collect()] == [("u", "outside the pools")]


@pytest.mark.parametrize("counts", [{"p": (1, 1), "q": (1, 1), "r": (1, 1)}, {"p": (5, 5), "q": (1, 0)}, {"p": (3, 4), "q": (4, 1), None: (2, 2)},
                                    {"p": (6, 6), "q": (2, 3), "r": (3, 1)}, {"p": (9, 0), "q": (0, 4)}, {"p": (4, 0)}, {"p": (2, 7), "q": (3, 2), "r": (1, 1)}])
def test_pairs_across_pools_reach_the_limit(spark, counts):
    """The shorter side, or what is not of one class, whichever is fewer; leftovers have one reason each."""
    rows = [(f"{c}{side}{i}", "g", c, f"strong_weak:{side}") for c, n in counts.items() for side, k in zip(("strong", "weak"), n) for i in range(k)]
    pooled = spark.createDataFrame(rows + [("u", "g", "p", "unused")], "key string, grp string, name string, pool string")
    s, w = (sum(n[k] for n in counts.values()) for k in (0, 1))
    limit = min(s, w, s + w - max(sum(n) for n in counts.values()))
    name, pool = {r[0]: r[2] for r in rows}, {r[0]: r[3] for r in rows}
    for seed in range(2):
        pairs = P.settle_pairs(pooled, "key", "grp", seed, "name").collect()
        used = [k for r in pairs for k in (r.x, r.y)]
        assert len(pairs) == limit and len(used) == len(set(used)) and all(name[r.x] != name[r.y] for r in pairs)
        assert all(pool[r.x].endswith("strong") and pool[r.y].endswith("weak") for r in pairs) and sorted(r.index for r in pairs) == list(range(limit))
    every = P.settle_pairs(pooled, "key", "grp", 1, "name")
    two = P.settle_pairs(pooled, "key", "grp", 1, "name", {"strong_weak": 2})
    assert {(r.x, r.y) for r in two.collect()} == {(r.x, r.y) for r in pairs if r.index < 2}
    rest = [r.reason for r in P.unpaired(pooled, two, "key", "grp", "name", every).collect()]
    assert len(rest) + 2 * min(2, limit) == len(rows) + 1 and rest.count("beyond the request") == 2 * max(0, limit - 2) and rest.count("outside the pools") == 1


def test_derangement_of_many_labels_and_none(spark):
    rows = [(f"r{i}", f"l{i // 2}") for i in range(2400)]
    out = P.derangement(spark.createDataFrame(rows, "key string, label string"), "key", "label", 1).collect()
    assert sorted(r.target for r in out) == sorted(r.label for r in out) and all(r.target != r.label for r in out)
    lopsided = spark.createDataFrame([(f"r{i}", "a" if i < 7 else "b") for i in range(10)], "key string, label string")
    with pytest.raises(ValueError, match="dominates"):
        P.derangement(lopsided, "key", "label", 1)
    assert P.derangement(lopsided.limit(0), "key", "label", 1).count() == 0


def test_numbers_round_as_they_lie(spark):
    from counterlens.functions.numbers import fixed
    values = [36.25, 36.35, 0.15, 0.25, 2.675, -0.25, -36.35, 1e-9, 0.0, 123456.45, 0.05, 99.95]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(fixed(F.col("v"), 1).alias("a"), fixed(F.col("v"), 3, True).alias("b")).collect()
    assert [(r.a.replace("-0.0", "0.0"), r.b) for r in got] == [((f"{v:.1f}").replace("-0.0", "0.0"), f"{v:+.3f}") for v in values]


def test_blocked_bootstrap(spark, monkeypatch):
    """Several blocks: counts of draws add up to n, every cluster is drawn about as often, sums equal a plain recount."""
    from counterlens.operators import resampling as S
    n, reps = 3 * S.BLOCK + 17, 40
    per = np.stack([S.block_draws(n, k, reps, 5) for k in range(4)])
    assert (per.sum(axis=0) == n).all() and abs(per[3].mean() - 17) < 5
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("x"), F.lit(1.0).alias("one"))
    rows = S.replicate_sums(df, "k", ["x", "one"], [], reps, 5).collect()
    assert len(rows) == reps and all(r.one == n for r in rows)
    means = np.array([r.x / r.one for r in rows])
    assert abs(means.mean() - 3) < 0.02 and 0.5 < means.std() / (2 / np.sqrt(n)) < 1.6


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    from counterlens.sources import corpora
    good = " ".join(["A1"] * 20 + ["1"])
    (tmp_path / "c.data").write_text("\n".join(good if i % 3 else "short" for i in range(400)) + "\n")
    ids = []
    for size in ("1k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        ids.append(sorted(r.source_record_id for r in corpora.read_credit_lines(spark, str(tmp_path / "c.data")).collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert ids[0] == ids[1] == sorted(f"line-{i + 1}" for i in range(400) if i % 3)


def test_gate_codes(spark):
    rows = [("A x. body", "A y. body", " x.", " y."), ("A x. x. body", "A y. body", " x.", " y."), ("A x. body", "A y. other", " x.", " y."),
            ("A x. b", "A b y.", " x.", " y."), ("A x. b", "A x. b", " x.", " x."), ("A x. b", "A one two three four five six. b", " x.", " one two three four five six.")]
    got = [r.codes for r in B.gated_pairs(spark.createDataFrame(rows, "text_a string, text_b string, clause_a string, clause_b string"), flesch=1e9).collect()]
    assert got[0] == [] and "clause_not_once" in got[1] and got[2] == ["content_differs"] and got[4] == ["no_contrast"]
    assert got[3] == ["clause_position"] or "content_differs" in got[3]
    assert {"char_delta", "token_delta"} <= set(got[5])


@pytest.mark.parametrize("design", [CREDIT, HIRING, EDUCATION])
def test_design_shapes(design):
    assert len(design.cells()) == 8 and design.cells()[0].signs == (1, 1, 1)
    for encoding in ("explicit", "proxy"):
        pairs = design.all_pairs(encoding)
        assert len(pairs) == 4 * (len(design.marked_axes(encoding)) - 1) + 1
        assert all(sum(x != y for x, y in zip(p.a.signs, p.b.signs)) == (3 if p.axis == "intersection" else 1) for p in pairs)
    with pytest.raises(ValueError):
        design.pairs("height", "explicit")


def test_stage_clauses_refuse_unknown():
    assert stage_clauses("doctorate", "explicit", "student")[1] == " The student is 28 years old."
    for bad in (("grade6", "explicit"), ("phd", "proxy"), ("masters", "implicit")):
        with pytest.raises(ValueError):
            stage_clauses(*bad)


def _planted(spark, f):
    rows = []
    for rec in range(6):
        for t in ("v1", "v2"):
            for c in CREDIT.cells():
                for resp in ("approve", "decline"):
                    rows.append((f"r{rec}", rec % 2 == 0, "explicit", t, c.key, *c.signs, resp, float(f(rec, c.signs, resp))))
    return spark.createDataFrame(rows, "record_id string, strong boolean, encoding string, template string, cell string, s1 int, s2 int, s3 int, response string, reward double")


def test_additive_scores_have_no_interactions(spark):
    r = _planted(spark, lambda rec, s, resp: rec * 0.25 - (0.5 * s[0] + 0.125 * s[1]) * (resp == "approve"))
    e = D.record_effects(r, CREDIT, ["record_id"], {"D": ("approve", "decline")}).collect()
    for row in e:
        assert math.isclose(row["D:main:sex"], -1.0) and math.isclose(row["D:main:age"], -0.25)
        assert all(abs(row[f"D:{k}"]) < 1e-12 for k in ("main:marital_status", "interaction:sex_x_age", "three_way", "additivity_gap"))


def test_corner_gap_is_a_quarter_of_the_three_way(spark):
    rng = random.Random(0)
    r = _planted(spark, lambda *a: rng.randrange(64) / 8)
    for row in D.record_effects(r, CREDIT, ["record_id"], {"D": ("approve", "decline")}).collect():
        assert math.isclose(row["D:additivity_gap"], row["D:three_way"] / 4, abs_tol=1e-9)


def test_constant_approver(spark):
    r = _planted(spark, lambda rec, s, resp: 1.0 if resp == "approve" else 0.0)
    m = D.cell_margins(r, ["record_id", "template", "encoding", "strong"], {"D": ("approve", "decline")})
    acc = {row.strong: row.acc_marked for row in D.accuracy_values(m, CREDIT, ["record_id", "strong"]).collect()}
    assert acc == {True: 1.0, False: 0.0}


def test_length_driven_scores_track_length_only(spark):
    rows = [(f"r{i}", i % 2 == 0, float(i), float(i) * 2 + 1) for i in range(40)]
    q = D.quality_tracking(spark.createDataFrame(rows, "k string, strong boolean, len double, D double").withColumn("g", F.lit("x")), ["g"], "D", "len", buckets=1).first()
    assert math.isclose(q.auc_d, q.auc_length) and abs(q.auc_d_length_residualised - 0.5) < 1e-9


def test_projection_removes_the_direction(spark):
    rng = np.random.default_rng(0)
    rows = [(list(map(float, rng.normal(size=8))), [1.0] + [0.0] * 7) for _ in range(5)]
    df = spark.createDataFrame(rows, "h array<double>, u array<double>")
    for r in df.select(X.dot(X.project_out("h", "u"), "u").alias("a"), X.cosine("u", F.array(*[F.lit(0.0)] * 8)).alias("c")).collect():
        assert abs(r.a) < 1e-12 and r.c is None


def test_span_drops_dependent():
    b = V.orthonormal_span([np.array([1.0, 0, 0]), np.array([3.0, 0, 0]), np.zeros(3), np.array([1.0, 1, 0])])
    assert b.shape == (2, 3) and np.allclose(b @ b.T, np.eye(2))


def test_own_direction_never_saw_its_fold(spark):
    rng = np.random.default_rng(1)
    rows = [(f"r{i}", i % 4, list(map(float, rng.normal(size=4)))) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, fold int, contrast array<double>")
    for r in V.cross_fitted(df, [], "fold").collect():
        rest = np.mean([x[2] for x in rows if x[1] != r.fold], axis=0)
        assert np.allclose(r.direction, rest / np.linalg.norm(rest)) and r.n_fit == 15


def test_erasure_removes_linear_but_not_xor(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 6))
    linear, xor = (x[:, 0] > 0).astype(int), ((x[:, 1] > 0) ^ (x[:, 2] > 0)).astype(int)
    df = spark.createDataFrame([(list(map(float, v)), int(a), int(b), bool(i % 3 == 0)) for i, (v, a, b) in enumerate(zip(x, linear, xor))],
                               "state array<double>, lin_y int, xor_y int, held boolean")
    rows = {r.method: r for r in E.erasure_rows(df, "state", "lin_y", "held", ["none", "affine"], hidden=8, iterations=60).collect()}
    assert rows["none"].linear_acc > 0.9 and rows["affine"].linear_acc < 0.62
    x_rows = E.erasure_rows(df, "state", "xor_y", "held", ["none"], hidden=16, iterations=200).first()
    assert x_rows.linear_acc < 0.65 < x_rows.mlp_acc


def test_flip_norms_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(f"r{i}", list(map(float, rng.normal(size=5)))) for i in range(12)]
    df = spark.createDataFrame(rows, "k string, v array<double>")
    a = {r.flip: r.norm2 for r in V.flip_norms(df.repartition(1), "k", "v", 30, 7).collect()}
    b = {r.flip: r.norm2 for r in V.flip_norms(df.repartition(5), "k", "v", 30, 7).collect()}
    assert len(a) == 30 and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)


def test_best_of_n_ties(spark):
    rows = [("a", 1.0, True), ("a", 1.0, False), ("a", 0.5, False), ("b", 0.0, True), ("b", 1.0, False), ("c", 2.0, True), ("c", 1.0, False)]
    got = {r.item: r.value for r in G.best_of_n(spark.createDataFrame(rows, "item string, s double, ok boolean"), ["item"], "s", "ok").collect()}
    assert got == {"a": 0.5, "b": 0.0, "c": 1.0}


def test_exchange_rate_unbounded(spark):
    rows = [("p1", "g", 1.0, 2.0), ("p2", "g", 1.0, -1.9), ("p3", "g", 1.0, 0.1)]
    r = C.exchange_rates(spark.createDataFrame(rows, "k string, grp string, marker_effect double, quality_margin double"), ["grp"], "k", 50, 0).first()
    assert r.exchange_rate is not None and r.ci_low is None


def test_sizing(spark):
    con = spark.createDataFrame([("m", "a", 2.0, 1.0, 100), ("m", "b", 1.0, 1.0, 100), ("m", "c", 1.0, 0.0, 100)], "model string, contrast string, sd double, scale_sd double, available long")
    r = G.size_contrasts(con, ["model"], [0.5]).first()
    assert r.binding == "a" and r.unsized == 1 and r.n == math.ceil(((1.959964 + 0.841621) * 2 / 0.5) ** 2) and r.exceeds_available


def test_even_split(spark):
    df = spark.createDataFrame([("a", 10), ("b", 3), ("c", 100)], "k string, n long")
    for total in (5, 12, 30, 113):
        got = {r.k: r.alloc for r in P.even_split(df, "k", "n", total).collect()}
        assert sum(got.values()) == total and all(got[k] <= n for k, n in (("a", 10), ("b", 3), ("c", 100)))


def test_contracts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 2)], "k string, y int")
    assert Q.conflicting_labels(df, "k", "y").count() == 1
    with pytest.raises(Q.ContractError):
        Q.require_empty(Q.unknown_levels(df, "k", ["a"]), "levels")
    with pytest.raises(Q.ContractError):
        Q.label_values(df, "y")
    assert Q.label_values(df.filter("y < 2"), "y") == [0, 1]


def test_unknown_code_fails(spark):
    from counterlens.sources.codebook import CODES, lookup, checked_marker
    df = spark.createDataFrame([("A99",)], "c string")
    with pytest.raises(Exception, match="unknown checking"):
        df.select(lookup(CODES["checking"], F.col("c"), "checking")).collect()
    with pytest.raises(Exception, match="start with a space"):
        df.select(checked_marker(F.col("c"))).collect()


def test_sources_and_sinks(spark, tmp_path):
    from counterlens.sources import corpora, sinks
    line = "A11 6 A34 A43 1169 A65 A75 4 A93 A101 4 A121 67 A143 A152 2 A173 1 A192 A201 1"
    (tmp_path / "credit.data").write_text(f"{line}\nshort line\n{line}\n")
    from counterlens.sources.codebook import decode
    rec = decode(corpora.read_credit_lines(spark, str(tmp_path / "credit.data"))).collect()
    assert len(rec) == 2 and rec[0].raw_sex == "male" and rec[0].credit_good and not rec[0].foreign_worker
    (tmp_path / "e.csv").write_text('Essay_ID,score,full_text,prompt_name,gender\n1,6,"Line one\n\nsays ""hi""",Cars, \n2,2,x,Cars,F\n')
    essays = {r.essay_id: r for r in corpora.read_essays(spark, str(tmp_path / "e.csv")).collect()}
    assert essays["1"].full_text == 'Line one\n\nsays "hi"' and essays["1"].raw_sex is None and essays["2"].raw_sex == "F"
    with pytest.raises(corpora.MissingColumn):
        corpora.resolve_columns(spark.range(1).schema, {"b": "text"}, {"text"})
    (tmp_path / "names.txt").write_text("# list\nAda\n\nBob\n")
    assert sorted(r.name for r in corpora.read_word_list(spark, str(tmp_path / "names.txt")).collect()) == ["Ada", "Bob"]
    bios = spark.createDataFrame([("text", 25, 1)], "hard_text string, profession int, gender int")
    bios.write.parquet(str(tmp_path / "bios"))
    assert corpora.read_biographies(spark, str(tmp_path / "bios")).first().profession == "surgeon"
    bench = spark.createDataFrame([("i", "q", ["a"], ["b", "c"], 1, 2, 3, "Math"), ("j", "q", ["a"], ["b"], 1, 2, 3, "Math")], corpora.ITEM_SCHEMA)
    bench.write.parquet(str(tmp_path / "bench"))
    items = corpora.read_benchmark(spark, str(tmp_path / "bench"))
    assert items.filter("subset = 'Math'").select("completions").count() == 2
    with pytest.raises(Exception, match="completion counts"):
        items.collect()
    (tmp_path / "pub.json").write_text(json.dumps({"subset": ["s"], "id": ["1"], "scores": [[0.5, 0.25]]}))
    assert corpora.read_published_scores(spark, str(tmp_path / "pub.json")).count() == 2
    (tmp_path / "res.json").write_text(json.dumps({"metrics": {}}))
    assert corpora.read_results(spark, str(tmp_path / "res.json")).first().kind == "decision"
    assert list(corpora.file_hashes(spark, [str(tmp_path / "res.json")]).values()) == [hashlib.sha256((tmp_path / "res.json").read_bytes()).hexdigest()]
    pairs = spark.createDataFrame([(f"p{i}", "sex" if i % 2 else "age", "explicit", "v1", f"t{i}") for i in range(20)], "id string, varied_axis string, encoding string, template_id string, text_a string")
    sinks.write_manifest(pairs, pairs.select("id", "encoding"), {"gate": pairs.groupBy("varied_axis").count()}, str(tmp_path / "m"), 42)
    assert {r.varied_axis: r.pairs for r in sinks.read_manifest(spark, str(tmp_path / "m")).collect()} == {"sex": 10, "age": 10}
    sinks.write_review_sample(pairs, "varied_axis", 6, 1, str(tmp_path / "sample"))
    assert spark.read.option("header", True).csv(str(tmp_path / "sample")).count() == 6
    with pytest.raises(ValueError):
        sinks.write_scores(pairs, str(tmp_path / "s"), ["id"], ["text_a"])
    sinks.write_scores(pairs, str(tmp_path / "s"), ["id"], ["template_id"])
    with pytest.raises(Exception):
        sinks.write_scores(pairs, str(tmp_path / "s"), ["id"], ["template_id"])
    assert sinks.variant_suffix({"alpha": 0.5, "n": 3}, {"alpha": 1.0, "n": 3}) == "-alpha=0.5"


def test_streamed_intake_first_score_wins(spark, tmp_path):
    from counterlens.streaming.intake import STATE_SCHEMA, read_states, score_missing, start_intake, worklist
    src, out, ckpt = (str(tmp_path / d) for d in ("in", "out", "ckpt"))
    rows = lambda ks, s: spark.createDataFrame([(k, s, [s], [1.0]) for k in ks], STATE_SCHEMA)
    rows(["a", "b"], 1.0).write.mode("append").parquet(src)
    start_intake(spark, src, out, ckpt).awaitTermination()
    rows(["b", "c"], 2.0).write.mode("append").parquet(src)
    start_intake(spark, src, out, ckpt).awaitTermination()
    start_intake(spark, src, out, ckpt).awaitTermination()
    assert {r.text_key: r.score for r in read_states(spark, out).collect()} == {"a": 1.0, "b": 1.0, "c": 2.0}
    assert spark.read.parquet(out).count() == 3

    def scorer(batches):
        for pdf in batches:
            pdf = pdf.assign(score=pdf["text"].str.len().astype(float), state=[[0.0]] * len(pdf), gates=[[1.0]] * len(pdf))
            yield pdf[["text_key", "score", "state", "gates"]]

    texts = spark.createDataFrame([("a", "x"), ("d", "four"), ("d", "four")], "text_key string, text string")
    done = read_states(spark, out)
    assert worklist(texts, done).count() == 1
    assert [(r.text_key, r.score) for r in score_missing(texts, done, scorer).collect()] == [("d", 4.0)]


def test_two_writers_of_one_key(spark, tmp_path):
    """Writers that do not see each other append a key twice; the first stays, and a batch reads only the folders it touches."""
    from concurrent.futures import ThreadPoolExecutor

    from counterlens.streaming.intake import STATE_SCHEMA, append_new, read_states
    out = str(tmp_path / "states")
    batch = lambda s, keys: spark.createDataFrame([(k, s, [s], [1.0]) for k in keys], STATE_SCHEMA)
    batch(0.0, ["x"]).limit(0).write.parquet(str(tmp_path / "unused"))
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda a: append_new(batch(*a), out), [(1.0, [f"k{i}" for i in range(40)]), (2.0, [f"k{i}" for i in range(20, 60)])]))
    raw, states = spark.read.parquet(out), {r.text_key: r.score for r in read_states(spark, out).collect()}
    assert len(states) == 60 and set(states.values()) == {1.0, 2.0}
    best = {}
    for r in raw.collect():
        best[r.text_key] = min(best.get(r.text_key, (1 << 62, "", 0.0)), (r.written, r.writer, r.score))
    assert states == {k: v[2] for k, v in best.items()}
    append_new(batch(9.0, ["k0", "k59", "new"]), out)
    after = {r.text_key: r.score for r in read_states(spark, out).collect()}
    assert after == {**states, "new": 9.0} and spark.read.parquet(out).count() == raw.count() + 1


def test_files_are_those_of_their_manifest(spark, tmp_path):
    from counterlens.sources.corpora import verified_files
    (tmp_path / "pairs.jsonl").write_bytes(b'{"id": 1}\n' * 1000)
    entry = {"sha256": hashlib.sha256((tmp_path / "pairs.jsonl").read_bytes()).hexdigest(), "n_rows": 1000}
    with pytest.raises(FileNotFoundError, match="no manifest.json"):
        verified_files(spark, str(tmp_path), ["pairs.jsonl"])
    (tmp_path / "manifest.json").write_text(json.dumps({"generator_version": "0.4.0", "code": "abc", "seed": 3, "files": {"pairs.jsonl": entry}}))
    assert verified_files(spark, str(tmp_path), ["pairs.jsonl"]) == [{"path": f"{tmp_path}/pairs.jsonl", "sha256": entry["sha256"], "n_rows": 1000,
                                                                      "generator_version": "0.4.0", "generator_code": "abc", "generator_seed": 3}]
    with pytest.raises(ValueError, match="does not list cells.jsonl"):
        verified_files(spark, str(tmp_path), ["cells.jsonl"])
    (tmp_path / "pairs.jsonl").write_bytes(b'{"id": 2}\n' * 1000)
    with pytest.raises(ValueError, match="is not the file"):
        verified_files(spark, str(tmp_path), ["pairs.jsonl"])


def test_percentiles_without_a_sorted_group(spark):
    from counterlens.operators.ranking import exact_percentiles
    rng = np.random.default_rng(9)
    rows = [("a", float(v)) for v in rng.normal(size=301)] + [("b", float(v)) for v in rng.integers(0, 3, 200)] + [("c", 5.0), (None, 1.0), (None, 2.0), ("d", None)]
    found = {r["g"]: r for r in exact_percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"lo": 0.025, "mid": 0.5, "hi": 0.975}, 4).collect()}
    assert set(found) == {"a", "b", "c", None}
    for g, r in found.items():
        own = [x for k, x in rows if k == g]
        assert [r["lo"], r["mid"], r["hi"]] == pytest.approx(np.percentile(own, [2.5, 50, 97.5]).tolist())


def test_positions_of_an_inserted_sentence(spark):
    from counterlens.operators import positioned as PO
    df = spark.createDataFrame([("r", "One here. Two is there. Three."), ("s", "No boundary")], "record_id string, text string")
    cut = {p: [r[0] for r in df.orderBy("record_id").select(PO.insertion_cut("text", p, 3)).collect()] for p in PO.POSITIONS}
    assert cut["opening"] == [0, 0] and cut["conclusion"] == [30, 11] and cut["middle"] == [9, None]
    assert cut["random"][0] in (9, 23) and cut["random"][1] is None
    row = df.filter("record_id = 'r'").select(PO.positioned("text", F.lit(" New."), "middle").alias("t")).first()
    assert row.t == "One here. New. Two is there. Three."
    with pytest.raises(Exception, match="trailing"):
        spark.createDataFrame([("ends ",)], "text string").select(PO.positioned("text", F.lit("x"), "conclusion")).collect()


def test_relations_between_directions(spark):
    from counterlens.operators import relations as R
    from counterlens.operators.design import DESIGNS
    s = R.source_table(spark, DESIGNS)
    g = s.select(F.struct("*").alias("s")).crossJoin(s.select(F.struct("*").alias("t"))).select(
        F.concat_ws("/", "s.domain", "s.encoding", "s.axis").alias("a"), F.concat_ws("/", "t.domain", "t.encoding", "t.axis").alias("b"),
        R.relation().alias("r"), R.proxy_differs().alias("p"))
    got = {(r.a, r.b): (r.r, r.p) for r in g.collect()}
    assert got["credit/explicit/sex", "credit/explicit/sex"] == ("own", None)
    assert got["hiring/proxy/sex", "credit/explicit/sex"][0] == "domain+encoding"
    assert got["credit/explicit/sex", "credit/explicit/intersection"][0] == "component"
    assert got["credit/explicit/age", "credit/explicit/sex"][0] == "off_axis"
    assert got["education/explicit/ethnicity", "credit/explicit/age"][0] == "unrelated"
    assert got["hiring/proxy/family_status", "hiring/explicit/family_status"] == ("encoding", True)


def test_private_fields_and_one_sided_records_are_refused(spark):
    from counterlens.operators import relations as R
    row = ("i", "sex", "explicit", "r", "t", "f", "m", None, "x", "y", "secret")
    df = spark.createDataFrame([row], "id string, axis string, encoding string, record_id string, template string, label_a string, label_b string, "
                                      "strong boolean, text_a string, text_b string, ethnicity string")
    assert "ethnicity" not in R.evaluation_examples(df, "strong").columns and "ethnicity" not in R.probe_pairs(df).columns
    with pytest.raises(Exception, match="quality flag"):
        R.evaluation_examples(df, "strong").collect()
    with pytest.raises(Exception, match="one label"):
        R.reward_gaps(spark.createDataFrame([("r", 1, 0.5)], "k string, y int, x double"), "k", [], "y", "x").collect()
