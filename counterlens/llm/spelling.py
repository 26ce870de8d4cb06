"""Spelling variants: words one edit apart, by composing the vocabulary's acceptor with an edit transducer and itself.

Two words within one edit, the longer of m code points, share their first ``m // 2`` code points or their last
``m - m // 2``. Each word is filed under both halves, for m its length and one more. What follows a half is the
language of the acceptor's state behind it, so each half is an initial state, and the vocabulary is dealt out by
initial states: forward and, for shared ends, backward. In each, a minimal acyclic acceptor of what is left of the words
is built (those of m code points and those of one less keep their own roots over common states) and composed with the
transducer that copies letters, replaces or deletes one, and copies on, and with the acceptor again. Composite states
are made as they are reached; those from which no common rest can be read are left out, and pairs are read off the
accepting paths. A deletion in a run of equal letters is only allowed at its last, so each pair is read once; a pair that
shares both halves counts in the forward partition alone.

Scale: word counts are partial sums; only words that occur often enough travel on, four times each. The tasks hold one
initial state's words at a time, at most ``GROUP``. Halves with more words have an exact way of their own, joins by what is left
after each letter is taken out, whose groups are bounded by the alphabet. Forms are followed by pointer doubling, whose
rounds are logarithmic in the longest chain, and a chain at least doubles its count with each step. Nothing is broadcast but
the list of halves with too many words (at most 4 / ``GROUP`` of the words).

Edge cases: null and empty texts have no words; a null id counts as an empty one where ids take part; repeated rows count
as often as they occur; words of any length, and letters beyond ASCII, are code points; equal counts go to the word that is
smaller by code points; an empty table gives an empty result; other columns are ignored. A row without a word is left out,
words given twice are one with their counts added.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterlens.llm.common import stored

LETTERS = "a-zÀ-ÿ"        # after lower-casing A-Z
SHORTEST, OFTEN, RATIO = 5, 3, 2    # code points and occurrences of a word; how much more frequent its form is
GROUP = 20_000                      # words that one task composes at a time
HALF = "m int, forward boolean, half string, rest string, n long"
PAIRS = "a string, b string, n_a long, n_b long"


# ---- words ---------------------------------------------------------------------------------------------------
def without(word: Column, at: Column) -> Column:
    """``word`` without the code point at ``at`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at.cast("int")), F.substring(word, at.cast("int") + 2, F.length(word)))


def vocabulary(docs: DataFrame, damage: int | None = None, shortest: int = SHORTEST, often: int = OFTEN) -> DataFrame:
    """word, n of all words of ``docs`` (doc_id, text) of at least ``shortest`` code points and ``often`` occurrences.

    With ``damage``, a run whose hash with its document's id is divisible by it loses one code point first, as a
    repeatable source of misspellings."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.regexp_extract_all(lower, F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))       # shorter ones stay too short
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("word"))
    if damage:
        h = F.crc32(F.concat("doc", F.lit(":"), "word").cast("binary"))
        hurt = without(F.col("word"), F.pmod(F.col("h"), F.length("word")))
        words = words.withColumn("h", h).withColumn("word", F.when(F.col("h") % damage == 0, hurt).otherwise(F.col("word")))
    words = words.filter(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= often)


# ---- one initial state ---------------------------------------------------------------------------------------
class Acceptor:
    """States of minimal acyclic acceptors; equal languages are one state, whichever root reaches it."""

    def __init__(self):
        self.moves: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.known: dict[tuple, int] = {}
        self.memo: dict[tuple[int, int], bool] = {}

    def _settle(self, moves: dict[str, int], final: bool) -> int:
        key = (final, *moves.items())
        if key not in self.known:
            self.known[key] = len(self.moves)
            self.moves.append(moves)
            self.final.append(final)
        return self.known[key]

    def add(self, words: list[str]) -> int:
        """The state that accepts exactly ``words`` (sorted, distinct)."""
        open_moves, ends, last = [{}], [False], ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            while len(open_moves) > same + 1:
                moves, final = open_moves.pop(), ends.pop()
                open_moves[-1][last[len(open_moves) - 1]] = self._settle(moves, final)
            for _ in range(len(word) - same):
                open_moves.append({})
                ends.append(False)
            ends[-1] = True
            last = word
        while len(open_moves) > 1:
            moves, final = open_moves.pop(), ends.pop()
            open_moves[-1][last[len(open_moves) - 1]] = self._settle(moves, final)
        return self._settle(open_moves[0], ends[0])

    def meet(self, p: int, q: int) -> bool:
        """Whether some rest is accepted from both states."""
        memo, todo = self.memo, [(p, q)]
        while todo:
            a, b = todo[-1]
            if a == b or (a, b) in memo:
                todo.pop()
                continue
            found = self.final[a] and self.final[b]
            if not found:
                for c, x in self.moves[a].items():
                    y = self.moves[b].get(c)
                    if y is None:
                        continue
                    found = True if x == y else memo.get((x, y))
                    if found is None:
                        todo.append((x, y))
                    if found is not False:
                        break
            if found is not None:
                memo[a, b] = found
                todo.pop()
        return p == q or memo[p, q]

    def shared(self, p: int, q: int, but: str | None = None) -> Iterator[str]:
        """Rests accepted from both states that do not begin with ``but``."""
        path: list[str] = []
        todo = [(0, "", p, q)]
        while todo:
            depth, letter, a, b = todo.pop()
            if depth:
                path[depth - 1:] = [letter]
            if self.final[a] and self.final[b]:
                yield "".join(path)
            for c, x in self.moves[a].items():
                y = self.moves[b].get(c)
                if y is not None and (depth or c != but) and self.meet(x, y):
                    todo.append((depth + 1, c, x, y))


def compose(long_rests: list[str], short_rests: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs that the composition accepts: two of ``long_rests`` by a replacement, or a long and a short one by a
    deletion. Both lists sorted and distinct, the short ones one code point shorter."""
    states = Acceptor()
    top = states.add(long_rests)
    moves, meet, shared = states.moves, states.meet, states.shared
    path: list[str] = []
    if len(long_rests) > 1:
        todo = [(0, "", top)]                                          # nothing edited yet: both read the same
        while todo:
            depth, letter, p = todo.pop()
            if depth:
                path[depth - 1:] = [letter]
            out = list(moves[p].items())
            for i, (c, x) in enumerate(out):
                for d, y in out[i + 1:]:
                    if meet(x, y):
                        before = "".join(path)
                        for rest in shared(x, y):
                            yield before + c + rest, before + d + rest
                todo.append((depth + 1, c, x))
    if long_rests and short_rests:
        low = states.add(short_rests)
        path.clear()
        both = [(0, "", top, low)]
        while both:
            depth, letter, p, q = both.pop()
            if depth:
                path[depth - 1:] = [letter]
            for c, x in moves[p].items():
                if meet(x, q):
                    before = "".join(path)
                    for rest in shared(x, q, but=c):
                        yield before + c + rest, before + rest
                y = moves[q].get(c)
                if y is not None:
                    both.append((depth + 1, c, x, y))


def _group_pairs(m: int, forward: bool, half: str, rows: list[tuple[str, int]]) -> Iterator[tuple[str, str, int, int]]:
    n = dict(rows)
    size = m - len(half)
    long_rests = sorted(r for r in n if len(r) == size)
    short_rests = sorted(r for r in n if len(r) == size - 1)
    whole = (lambda r: half + r) if forward else (lambda r: r[::-1] + half)
    for x, y in compose(long_rests, short_rests):
        a, b = whole(x), whole(y)
        if forward or len(x) == len(y) or a[:m // 2] != b[:m // 2]:          # else the forward partition has it
            yield a, b, n[x], n[y]


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by initial state; a state's rows may go over several batches."""
    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    out: list[tuple] = []
    for (m, forward, half), own in groupby(rows(), key=lambda r: r[:3]):
        own = [(rest, n) for *_, rest, n in own]
        if len(own) > 1:
            for pair in _group_pairs(m, forward, half, own):
                out.append(pair)
                if len(out) == 10_000:
                    yield _pair_batch(out)
                    out = []
    if out:
        yield _pair_batch(out)


def _pair_batch(out: list[tuple]) -> pa.RecordBatch:
    a, b, n_a, n_b = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64())],
                                      names=["a", "b", "n_a", "n_b"])


# ---- all initial states --------------------------------------------------------------------------------------
def halves(words: DataFrame) -> DataFrame:
    """Each word under its initial states: m, forward, half, rest, n."""
    def state(m: Column, forward: bool) -> Column:
        front, size = F.floor(m / 2).cast("int"), F.length("word")
        if forward:
            half, rest = F.substring("word", F.lit(1), front), F.substring("word", front + 1, size)
        else:
            half = F.substring("word", size - (m - front) + 1, m - front)
            rest = F.reverse(F.substring("word", F.lit(1), size - (m - front)))
        return F.struct(m.alias("m"), F.lit(forward).alias("forward"), half.alias("half"), rest.alias("rest"))

    m = F.length("word").cast("int")
    each = F.array(state(m, True), state(m, False), state(m + 1, True), state(m + 1, False))
    return words.select("n", F.explode(each).alias("s")).select("s.*", "n")


def _large_group_pairs(rows: DataFrame) -> DataFrame:
    """The pairs of ``rows`` (as ``halves``) by joins on what is left without one letter."""
    state = ["m", "forward", "half"]
    size = F.col("m") - F.length("half")
    longs, shorts = rows.filter(F.length("rest") == size), rows.filter(F.length("rest") == size - 1)
    at = longs.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("rest") - 1))).withColumn("left", without(F.col("rest"), F.col("at")))
    keys = [*state, "at", "left"]
    other = at.select(*keys, F.col("rest").alias("rest2"), F.col("n").alias("n2"))
    replaced = at.join(other, keys).filter(F.col("rest") < F.col("rest2")).select(*state, "rest", "n", "rest2", "n2")
    letter = lambda k: F.substring("rest", F.col("at") + k, F.lit(1))
    deleted = at.filter(letter(1) != letter(2)).drop("at").join(
        shorts.select(*state, F.col("rest").alias("left"), F.col("rest").alias("rest2"), F.col("n").alias("n2")), [*state, "left"])
    found = replaced.unionByName(deleted.select(*replaced.columns))
    whole = lambda r: F.when(F.col("forward"), F.concat("half", r)).otherwise(F.concat(F.reverse(r), F.col("half")))
    front = F.floor(F.col("m") / 2).cast("int")
    pairs = found.select("forward", front.alias("front"), whole(F.col("rest")).alias("a"), whole(F.col("rest2")).alias("b"),
                         F.col("n").alias("n_a"), F.col("n2").alias("n_b"))
    first = lambda c: F.substring(c, F.lit(1), F.col("front"))
    return pairs.filter(F.col("forward") | (F.length("a") == F.length("b")) | (first("a") != first("b"))).select("a", "b", "n_a", "n_b")


def near_words(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: every pair of ``words`` (word, n; stored) that differ by one code point, once."""
    state = ["m", "forward", "half"]
    rows = halves(words)
    large = stored(rows.groupBy(*state).count().filter(F.col("count") > GROUP).select(*state), "large")
    fits = rows.join(large, state, "left_anti").repartition(*state).sortWithinPartitions(*state)
    pairs = fits.select("m", "forward", "half", "rest", "n").mapInArrow(_compose, PAIRS)
    if large.isEmpty():
        return pairs
    return pairs.unionByName(_large_group_pairs(stored(rows.join(large, state), "large_rows")))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of every row of ``forms`` (word, form): the last of the chain, by pointer doubling."""
    step = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        step = stored(step.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"),
                                                              F.col("ahead").isNotNull().alias("moved")), "roots")
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        step = step.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words``: word, n. word, form, root, n, n_near, form_n of every word."""
    words = words.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    words = stored(words, "words")
    pairs = near_words(words).select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    each = words.join(near, "word", "left")
    strong = -F.col("best.less") >= ratio * F.col("n")
    each = each.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                       F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"))
    each = stored(each, "variants")
    roots = _roots(each.filter("form IS NOT NULL").select("word", "form"))
    return each.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
