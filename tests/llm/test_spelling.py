"""Spelling variants: the composition against all pairs, whole tables against a plain version."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from counterlens.llm import spelling
from test_corpus import frame, hard_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits(word, letters):
    out = {word[:i] + word[i + 1:] for i in range(len(word))}
    out |= {word[:i] + c + word[i + k:] for i in range(len(word) + 1) for c in letters for k in (0, 1)}
    return out - {word}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    front = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a != b and len(b) - len(a) < 2 and a[front + (len(a) == len(b)):] == b[front + 1:]


def words_of(rows, damage=97):
    count = Counter()
    for i, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0 and damage:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def plain(words):
    letters = sorted({c for w in words for c in w})
    near = {w: sorted(edits(w, letters) & words.keys() if len(w) < 99 else {o for o in words if one_edit(w, o)}) for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text(alphabet="abc", min_size=3, max_size=4), max_size=40))
def test_composition_accepts_the_near_pairs(words):
    longs, shorts = sorted(w for w in words if len(w) == 4), sorted(w for w in words if len(w) == 3)
    found = list(spelling.compose(longs, shorts))
    want = {(x, y) for x in longs for y in edits(x, "abc") & words if len(y) == 3 or x < y}
    assert len(found) == len(set(found)) and {p if len(p[0]) != len(p[1]) else tuple(sorted(p)) for p in found} == want


def test_acceptors_are_minimal():
    states = spelling.Acceptor()
    root = states.add(sorted({a + b + "ing" for a in "abcd" for b in "xyz"}))
    assert len(states.moves) == 6 and not states.final[root]
    assert states.add(["ing"]) == states.moves[states.moves[root]["a"]]["x"]
    assert states.add([]) == len(states.moves) - 1


@pytest.fixture(scope="module")
def rows():
    rows = hard_rows()
    family = ["colour"] * 40 + ["color"] * 90 + ["colours"] * 12 + ["colou"] * 3 + ["cölour"] * 5 + ["COLOR"] * 10 + ["colxr"] * 2 + ["aaaaa"] * 9
    family += ["aaaaaa"] * 4 + ["aaaaaaa"] * 20 + ["ties1"] * 3 + ["tiesaa"] * 6 + ["tiesab"] * 6 + ["tiesac"] * 3 + ["×÷×÷×"] * 4 + ["×÷×÷"] * 9
    rows += [(3000 + i, f"{w}, {w}-{w}" if i % 3 else w, "s", "en") for i, w in enumerate(family)]
    long = "a" * 30_000
    rows += [(4000, f"{long} {long} {long}, {long}a {long}a {long}a", "s", "en"), (4001, " ".join([long[:-1] + "b"] * 7), "s", "en")]
    return rows + [(None, "nullish nullish nullish nulish nulish nulish", "s", "en")] * 3


@pytest.mark.parametrize("group", [spelling.GROUP, 3])
def test_variants_of_a_whole_table(spark, rows, group, monkeypatch):
    """With small groups nearly all initial states go the way of the large ones."""
    if group == 3:
        rows = [r for r in rows if r[0] is None or r[0] < 4000]
    monkeypatch.setattr(spelling, "GROUP", group)
    words = words_of(rows)
    docs = frame(spark, rows).repartition(5)
    assert got(spelling.variants(spelling.vocabulary(docs, damage=97))) == plain(words)
    assert len(words) > 200 and any(form for _, form, *_ in plain(words))


def test_pairs_come_once(spark):
    words = {"abcde": 3, "abcdf": 9, "abbcde": 4, "xbcde": 30, "abcdef": 6, "bcdea": 3, "abcdé": 5, "abccde": 3, "abcdeabcde": 4, "abcdeabcdf": 8}
    df = spark.createDataFrame([*words.items(), (None, 5)], "word string, n long")
    pairs = [tuple(sorted(r[:2])) for r in spelling.near_words(df.filter("word is not null")).collect()]
    letters = sorted({c for w in words for c in w})
    assert len(pairs) == len(set(pairs)) and set(pairs) == {tuple(sorted((w, o))) for w in words for o in edits(w, letters) & words.keys()}
    assert got(spelling.variants(df)) == plain(words)


def test_undamaged_words(spark, rows):
    docs = frame(spark, rows[:40])
    assert {r["word"]: r["n"] for r in spelling.vocabulary(docs).collect()} == words_of(rows[:40], damage=None)


def test_variants_of_nothing(spark):
    assert got(spelling.variants(spelling.vocabulary(frame(spark, []), damage=97))) == []
    assert got(spelling.variants(spelling.vocabulary(frame(spark, [(1, None, "s", "en"), (2, "a b", "s", "en")])))) == []
