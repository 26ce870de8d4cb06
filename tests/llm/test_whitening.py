"""Whitening against numpy in double precision and exact integers."""

import numpy as np
import pytest

from counterlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, idx string, x string, mark string, part string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", "c", "c", "c") for i, v in rows], SCHEMA)


def plain(rows, components=4):
    kept = [(i, np.array(v, float)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    if not kept:
        return {}
    lengths = [len(v) for _, v in kept]
    width = min(set(lengths), key=lambda w: (-lengths.count(w), w))
    kept = [(i, np.floor(np.array(v, np.float32).astype(float) * 256).astype(int)) for i, v in kept if len(v) == width]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, width)
    return {"n": n, "explained": (e / np.trace(cov))[:k] if np.trace(cov) else None, "solid": e[:k] > 1e-9 * max(e[0], 1e-30),
            "rows": [(i, int(((n * x - total).astype(object) ** 2).sum()), (x - total / n) @ v[:, :k] / np.sqrt(np.maximum(e[:k], 1e-300)))
                     for i, x in kept]}


def check(spark, rows, partitions=5):
    found = whitening.whiten(frame(spark, rows).repartition(partitions)).collect()
    want = plain(rows)
    k = len(want["solid"])
    assert len(found) == k * len(want["rows"])
    for c in range(k):
        own = sorted((r for r in found if r["component"] == c + 1), key=lambda r: (repr(r["vec_id"]), r["deviation"], abs(r["whitened"] or 0)))
        exp = sorted(want["rows"], key=lambda r: (repr(r[0]), r[1], abs(r[2][c]) if want["solid"][c] else 0))
        assert [(r["vec_id"], int(r["deviation"]), r["n"]) for r in own] == [(i, d, want["n"]) for i, d, _ in exp]
        if not want["solid"][c]:
            assert all(r["whitened"] is None for r in own)
            continue
        a, b = np.array([r["whitened"] for r in own]), np.array([z[c] for _, _, z in exp])
        assert min(abs(a - b).max(), abs(a + b).max()) < 1e-8
        assert own[0]["explained"] == pytest.approx(want["explained"][c], rel=1e-9)
        assert own[0]["identity_error"] < 1e-9
    return found


@pytest.fixture
def small_blocks(monkeypatch):
    """Several blocks in both directions and several splits."""
    monkeypatch.setattr(whitening, "ROWS", 16)
    monkeypatch.setattr(whitening, "COLUMNS", 4)
    monkeypatch.setattr(whitening, "SPLIT", 2)


def test_whitening_in_blocks(spark, small_blocks):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 10)) @ np.diag(np.linspace(3, 0.3, 10))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(500 + i, base[7].tolist()) for i in range(60)]                       # one very common vector
    rows += [(None, base[3].tolist()), (None, base[4].tolist()), (1, base[5].tolist()), (1, base[5].tolist())]
    rows += [(900, None), (901, []), (902, [None] * 10), (903, [float("nan")] * 10), (904, [float("inf")] * 10), (905, [1.0] * 3),
             (906, [-0.0] * 10)]
    check(spark, rows)


def test_fewer_dimensions_than_components_and_no_spread(spark):
    found = check(spark, [(1, [1.0, 0.5]), (2, [2.0, -0.5]), (3, [0.0, 3.0])], 2)
    assert {r["component"] for r in found} == {1, 2}
    flat = check(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])], 2)
    assert {(r["whitened"], r["explained"], r["identity_error"]) for r in flat} == {(None, None, None)}


def test_huge_entries_stay_exact(spark):
    found = check(spark, [(1, [3.0e7, 1.0e7]), (2, [-2.0e7, 2.0e7]), (3, [1.0e7, 5.0e6])], 1)
    assert max(r["deviation"] for r in found) > 2 ** 63


def test_whitening_of_nothing(spark):
    for rows in ([], [(1, None), (2, [float("nan")])]):
        out = whitening.whiten(frame(spark, rows))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0
