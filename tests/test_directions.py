"""Erasures of all folds against plain refits, edits against edited states, readings against their rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterlens.operators import edits as E
from counterlens.operators import relations as R
from counterlens.operators import transfer as T
from counterlens.operators.design import DESIGNS, INTERSECTION

RNG = np.random.default_rng(7)
D, LABELS = 9, 3


@pytest.fixture(scope="module")
def rows():
    n = 160
    fold, z = RNG.integers(0, 4, n), RNG.integers(0, 2, (n, LABELS))
    x = RNG.normal(size=(n, D)) @ RNG.normal(size=(D, D)) + 3.0
    x[:, 0] += 2 * z[:, 0]
    x[:, 1] += z[:, 0] * z[:, 1]
    return fold, z, x


@pytest.fixture
def states(spark, rows):
    fold, z, x = rows
    data = [(i, int(f), [float(v) for v in y], v.tolist()) for i, (f, y, v) in enumerate(zip(fold, z, x))]
    return spark.createDataFrame(data, "id long, fold int, z array<double>, state array<double>").repartition(5)


def plain_affine(x, z):
    """Least-change erasure with the pseudo-inverse instead of a whitening."""
    mean, cov = x.mean(0), np.cov(x.T, bias=True)
    cross = (x - mean).T @ (z - z.mean(0)) / len(x)
    inverse = np.linalg.pinv(cov)
    return mean, cross @ np.linalg.pinv(cross.T @ inverse @ cross) @ cross.T @ inverse


@pytest.mark.parametrize("block, task_bytes", [(256, 128 << 20), (4, 1)])
def test_every_fold_like_a_plain_refit(states, rows, monkeypatch, block, task_bytes):
    """One pass of moments, total minus fold; with small blocks the Gram matrix comes in several parts and passes."""
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "TASK_BYTES", task_bytes)
    fold, z, x = rows
    moments = E.fold_moments(states, "fold", "state", "z", 4)
    assert {r["part"] for r in moments.collect()} == {-1, *range(-(-D // block))}
    found = {(r["fold"], r["concept"], r["method"]): r for r in
             E.fold_erasers(E.left_out(moments, "fold"), "fold", {"first": 0, "second": 1}, LABELS, [0, 1, 2]).collect()}
    for f in range(4):
        train, labels = x[fold != f], z[fold != f]
        for name, at in (("first", 0), ("second", 1)):
            for method, columns in ((E.AFFINE, [at]), (E.AFFINE_CELLS, [0, 1, 2])):
                r = found[f, name, method]
                mean, matrix = plain_affine(train, labels[:, columns].astype(float))
                assert np.allclose(r["mean"], mean) and np.allclose(np.array(r["a"]).T @ np.array(r["b"]), matrix, atol=1e-8)
                done = train - (train - mean) @ matrix.T
                for c in columns:
                    assert np.allclose(done[labels[:, c] == 1].mean(0), done[labels[:, c] == 0].mean(0), atol=1e-8)
            u = np.array(found[f, name, E.DIFFMEAN]["a"][0])
            diff = train[labels[:, at] == 1].mean(0) - train[labels[:, at] == 0].mean(0)
            assert np.allclose(u, diff / np.linalg.norm(diff)) and found[f, name, E.NONE]["a"] == []


def test_scores_of_edits_are_scores_of_edited_states(states, rows):
    fold, z, x = rows
    head = RNG.normal(size=D)
    erasers = E.fold_erasers(E.left_out(E.fold_moments(states, "fold", "state", "z", 4), "fold"), "fold", {"first": 0}, LABELS, [0, 1, 2])
    scored = {(r["id"], r["edit"]): r["edited"] for r in E.score_edits(states, ["id"], "state", E.eraser_edits(erasers, head), head, "fold").collect()}
    for r in E.erased_states(states, "fold", "state", erasers, ["id"]).collect():
        assert scored[r["id"], f"{r['concept']}|{r['method']}"] == pytest.approx(float(head @ np.array(r["erased"])), abs=1e-8)
    vectors = RNG.normal(size=(3, D))
    edits = [E.projection("none", [], head), E.projection("plane", vectors, head, 0.5), E.projection("same", [*vectors, vectors[0] + vectors[1]], head, 0.5)]
    q = np.linalg.qr(vectors.T)[0]
    for r in E.score_edits(states, ["id"], "state", edits, head).collect():
        v = x[r["id"]]
        want = head @ v if r["edit"] == "none" else head @ (v - 0.5 * q @ (q.T @ v))
        assert r["edited"] == pytest.approx(float(want)) and r["reward"] == pytest.approx(float(head @ v))
    assert E.score_edits(states.limit(0), ["id"], "state", edits, head).count() == 0


def _units(spark, sources, templates=("v1", "v2"), named=lambda s: s[1] == "proxy"):
    rows = []
    for i, s in enumerate(sources):
        for k in range(24):
            v = np.zeros(6)
            v[i % 6] = 1.0
            folds = sorted({k % 4, (k // 4) % 4}) if named(s) else []
            rows.append(("/".join(s), folds, templates[k % len(templates)], (v + 0.01 * RNG.normal(size=6)).tolist()))
    return spark.createDataFrame(rows, "source string, name_folds array<int>, template string, diff array<double>")


def test_plan_of_readings(spark):
    sources = [(d, e, a) for d, x in DESIGNS.items() for e in x.clauses for a in x.marked_axes(e)]
    table = R.source_table(spark, DESIGNS)
    plan = [tuple(r) for r in T.reading_plan(table, T.unit_sums(_units(spark, sources)), 2).collect()]
    per = {}
    for target, reading, relation, mode, source, folds, template in plan:
        per.setdefault(target, {}).setdefault(reading, []).append((source, mode, folds, template))
    for s in sources:
        own = per["/".join(s)]
        assert {"/".join(x) for x in sources} <= set(own) and len(own["template"]) == 1
        assert ("own_seen" in own) == (s[1] == "proxy") and ("singles_joint" in own) == (s[2] == INTERSECTION)
        assert ("others" in own) == (s[2] == "sex")                                 # the one axis of all three domains
        assert own["random0"] == [("random0", T.EACH, False, False)]
    corner = {x for x, *_ in per["credit/proxy/intersection"]["singles_joint"]}
    assert corner == {"credit/proxy/sex", "credit/proxy/age", "credit/explicit/marital_status"}


def test_fits_leave_out_what_the_key_names(spark):
    sources = [("credit", "proxy", "sex"), ("credit", "explicit", "sex")]
    units = _units(spark, sources)
    sums = T.unit_sums(units)
    table = R.source_table(spark, DESIGNS).filter("domain = 'credit' AND axis = 'sex'")
    plan = T.reading_plan(table, sums)
    keys = spark.createDataFrame([("credit/proxy/sex", [0, 1], "v1"), ("credit/explicit/sex", [], "v2")], "target string, key_folds array<int>, key_template string")
    rows = units.collect()
    for r in T.fitted(plan, keys, sums).collect():
        ex = set(r["key_folds"]) if r["hold_folds"] else set()
        kept = [u["diff"] for u in rows if u["source"] == r["source"] and not ex & set(u["name_folds"]) and not (r["hold_template"] and u["template"] == r["key_template"])]
        mean = np.mean(kept, axis=0)
        assert r["n_fit"] == len(kept) and np.allclose(r["direction"], mean / np.linalg.norm(mean))
    every = spark.createDataFrame([("credit/proxy/sex", [0, 1, 2, 3], "v1")], keys.schema)
    with pytest.raises(Exception, match="no unit left to fit"):
        T.fitted(plan, every, sums).collect()


def test_readings_take_out_spans_and_means(spark):
    head = RNG.normal(size=6)
    u = [v / np.linalg.norm(v) for v in RNG.normal(size=(3, 6))]
    fits = [("t", "joint", "r", T.SPAN, s, True, False, [], "v1", v.tolist(), 5) for s, v in zip("abc", u)]
    fits += [("t", "mean", "r", T.MEAN, s, True, False, [], "v1", v.tolist(), 4) for s, v in zip("ab", u)]
    fits += [("t", "null", "r", T.EACH, "d", True, False, [], "v1", None, 3), ("t", "a", "r", T.EACH, "a", True, False, [], "v1", u[0].tolist(), 3)]
    fits = spark.createDataFrame(fits, "target string, reading string, relation string, mode string, source string, hold_folds boolean, hold_template boolean, "
                                       "key_folds array<int>, key_template string, direction array<double>, n_fit long")
    x = RNG.normal(size=(20, 6))
    rows = spark.createDataFrame([("t", [], "v1", i, v.tolist()) for i, v in enumerate(x)], "target string, key_folds array<int>, key_template string, id long, state array<double>")
    q, m = np.linalg.qr(np.array(u).T)[0], (u[0] + u[1]) / np.linalg.norm(u[0] + u[1])
    want = {"joint": lambda v: v - q @ (q.T @ v), "mean": lambda v: v - m * (m @ v), "null": lambda v: v, "a": lambda v: v - u[0] * (u[0] @ v)}
    found = T.read_rows(rows, T.key_tables(fits, head.tolist()), head.tolist(), ["id"]).collect()
    assert len(found) == 80
    for r in found:
        assert r["after"] == pytest.approx(float(head @ want[r["reading"]](x[r["id"]]))) and r["reward"] == pytest.approx(float(head @ x[r["id"]]))


def test_effects_are_summed_beside_their_records(spark):
    """Against plain loops: texts that are missing, doubled or without a vector, a key without readings, records cut by batches."""
    head, dirs, shifts = RNG.normal(size=5), RNG.normal(size=(3, 5)), RNG.normal(size=(4, 5))
    dirs /= np.linalg.norm(dirs, axis=1)[:, None]
    fits = [(t, name, "r", T.EACH, name, True, False, folds, "v1", u.tolist(), n + len(folds)) for t, folds in (("s", [0]), ("s", [0, 1]), ("t", []))
            for n, (name, u) in enumerate(zip("ab" if t == "s" else "c", dirs if t == "s" else dirs[2:]))]
    fits = spark.createDataFrame(fits, "target string, reading string, relation string, mode string, source string, hold_folds boolean, hold_template boolean, "
                                       "key_folds array<int>, key_template string, direction array<double>, n_fit long")
    pairs = [("s", "v1", 0, 1, 0.5), ("s", "v1", 2, 3, 0.25), ("t", "v1", 0, 2, 1.0)]
    sets = [[0], [0, 1], [1], []]
    rows = [(r, at, int(k)) for r in range(60) for at in range(4) for k in [RNG.integers(0, 3)] for _ in range(1 + (r % 7 == at)) if r % 5 != at + 1 or r % 3]
    rows = [(r, at | k << 7, None if r == 8 and at == 3 else RNG.normal(size=5).astype(np.float32).tolist()) for r, at, k in rows]

    def folds(codes):
        return np.where([True, True, False], codes >> 7, 3)

    tables, number = T.key_tables(fits, head.tolist()), {"s": "ab", "t": "c"}
    want, n_fit = {}, {}
    for r in range(60):
        for t, readings in number.items():
            found = {}
            for target, _, a, b, w in pairs:
                of = [[(c, v) for i, c, v in rows if i == r and c & 127 == at] for at in (a, b)]
                k = sets[of[0][0][0] >> 7] if of[0] and t == "s" else []
                if target != t or not of[0] or not of[1] or k == [1]:
                    continue
                for i, name in enumerate(readings):
                    u = dirs[i if t == "s" else 2]
                    for sign, own, others in ((w, of[0], of[1]), (-w, of[1], of[0])):
                        for c, v in own:
                            x = np.zeros(5) if v is None else np.array(v) + shifts[c & 127]
                            found.setdefault(name, []).append(sign * len(others) * np.array([head @ x, head @ (x - u * (u @ x))]))
                    n_fit.setdefault((t, name), set()).add(i + len(k))
            for name, each in found.items():
                e, f = np.sum(each, axis=0)
                want.setdefault((t, name), []).append((e, f, abs(e), abs(f), abs(f) - abs(e)))
    df = spark.createDataFrame(rows, "r long, c int, v array<float>").repartition(3, "r")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("1", "7", size):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = {(x.target, x.reading): x for x in T.effect_sums(df, "r", "c", "v", shifts, pairs, folds, sets, tables, head.tolist()).collect()}
            assert got.keys() == want.keys()
            for k, x in got.items():
                assert x.n == len(want[k]) and (x.n_fit_min, x.n_fit_max) == (min(n_fit[k]), max(n_fit[k])) and x.relation == "r"
                assert list(x[6:]) == pytest.approx(np.sum(want[k], axis=0).tolist())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_transfer_matrix_repeats_no_texts(spark):
    """Records, pairs and readings as rows give the same sums; only texts move, once, hashed once, and keys come from the names alone."""
    from counterlens.queries import directions as Q
    sf = "/root/testdata/sf0.001"
    plan = Q.j19(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "zip_with" not in plan and plan.count("concat_ws(|, tr,") == 1
    plain = Q._targets(Q.pair_rows(Q.domain_texts(spark, sf, False)))
    keys = {(r.target, tuple(r.key_folds), r.key_template) for r in T.hold_out_keys(plain).collect()}
    found = [(r.target, tuple(r.key_folds), r.key_template) for r in Q.coded_keys(spark, sf, False).collect()]
    assert len(found) == len(set(found)) and set(found) == keys
    _, fits, h = Q.readings(spark, sf)
    rows = Q._targets(Q.pair_rows(Q.domain_states(spark, sf, False))).select(*T.KEY, "record_id", "w", "state")
    effects = T.transfer_effects(T.read_rows(rows, T.key_tables(fits, h), h, [*T.KEY, "record_id", "w"]), "w")
    want = {(r.target, r.reading): r for r in effects.groupBy("target", "reading", "relation").agg(
        F.count(F.lit(1)).alias("n"), F.min("n_fit_min").alias("lo"), F.max("n_fit_max").alias("hi"), F.sum("effect").alias("effect"), F.sum("after").alias("after"),
        F.sum(F.abs("after") - F.abs("effect")).alias("change")).collect()}
    got = {(r.target, r.reading): r for r in Q.read_effects(spark, sf, fits, h).collect()}
    assert got.keys() == want.keys() and any(r.relation == "random" for r in got.values())
    for k, r in got.items():
        w = want[k]
        assert (r.relation, r.n, r.n_fit_min, r.n_fit_max) == (w.relation, w.n, w.lo, w.hi)
        assert (r.effect, r.after, r.change) == pytest.approx((w.effect, w.after, w.change), abs=1e-9)
