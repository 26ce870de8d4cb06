"""Language by cross-parsing entropy.

For each language a suffix automaton holds a sample of its labelled text. A text is parsed greedily into the
longest matches with the sample; the better the sample knows the language, the fewer phrases are needed. The
language with the fewest phrases, weighted by the log of its sample's length, wins.

Training takes at most ``SAMPLE`` symbols per language, from at most ``ROWS`` labelled documents (smallest hash of
the id first) of 4 * SAMPLE characters each: these bounds are parameters of the training alone. Prediction reads whole texts. Parsing starts anew every ``BLOCK`` symbols, at
most one phrase more each, so many blocks are parsed side by side, one table lookup per symbol and language.

Scale: one pass over the texts, no shuffle of texts; the automata are bounded by SAMPLE times the number of
languages, also in scripts of many thousand letters (sparse moves), and travel with the tasks.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; letters that no sample has are one
symbol; equal phrase counts go to the language first in code-point order; repeated rows each get their row; a
null id is never held out; with no labelled text every document is ``und``; other columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterlens.llm.common import Carried

SAMPLE = 40_000
ROWS = 200
BLOCK = 256
GROUP = 1 << 19              # symbols parsed side by side
GAP, PAD = 0, 1              # symbols: any run of non-letters; end of a block
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents by id, kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """lang, text of at most ``rows`` training documents per language. Only ids are ranked; texts follow by a join
    with the few chosen ids."""
    training = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                           & ~held_out(F.col("doc_id")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (training.select("doc_id", "lang").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= rows)
              .select("doc_id", "lang", "r"))
    return training.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).select(
        "lang", "r", "doc_id", F.substring("text", 1, 4 * SAMPLE).alias("text"))


class Alphabet:
    """Symbols of lower-cased characters: gap, block end, unknown letter, then every letter of the texts, commonest first."""

    def __init__(self, texts: list[str]):
        seen = Counter()
        for t in texts:
            seen.update(t.lower())
        letters = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if c.isalpha()]
        self.size = 3 + len(letters)
        own = {c: 3 + i for i, c in enumerate(letters)}
        self.symbol = np.zeros(0x110000, np.min_scalar_type(self.size - 1))
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                self.symbol[code] = own.get(c.lower()[:1], 2)

    def read(self, text: str) -> np.ndarray:
        """Symbols of a text, runs of non-letters as one gap, none at either end."""
        s = self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        inside = s != GAP
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        s = s[keep]
        return s[:-1] if len(s) and s[-1] == GAP else s


class Moves(NamedTuple):
    """Moves of an automaton. That of ``state`` with ``symbol`` stands at ``base[state] + symbol`` if ``owner`` there is
    the state, else it is ``miss[symbol]``. A move is ``4 * next state + phrases that end``."""

    base: np.ndarray
    owner: np.ndarray
    to: np.ndarray
    miss: np.ndarray

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        at = self.base[state] + symbol
        return np.where(self.owner[at] == state, self.to[at], self.miss[symbol])


def automaton(sample: np.ndarray, alphabet: int) -> Moves:
    """The sample's suffix automaton; a symbol that does not continue the match ends the phrase and begins the next,
    one that the sample lacks is a phrase of its own. Its moves are as many as the sample's symbols, times three at
    most, whatever the size of the alphabet."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in sample.tolist():
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                split = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = split
                    p = link[p]
                link[q] = link[new] = split
        last = new
    root = np.zeros(alphabet, np.int64)
    for c, to in moves[0].items():
        root[c] = to
    miss = root * 4 + 1 + (root == 0)
    miss[PAD] = 1
    first = np.where(root > 0, root * 4, 1)                  # from the root a known symbol starts a phrase
    first[PAD] = 0
    # The root has a place for every symbol; then the states with most moves look for free places, and single moves fill up.
    size = alphabet + 2 * sum(map(len, moves))
    base, owner, to = np.zeros(len(moves), np.int32), np.full(size + alphabet, -1, np.int32), np.zeros(size + alphabet, np.int32)
    owner[:alphabet], to[:alphabet] = 0, first
    free = bytearray(b"\1") * (size + alphabet)
    free[:alphabet] = bytes(alphabet)
    rng = random.Random(1)
    for s in sorted((s for s in range(1, len(moves)) if len(moves[s]) > 1), key=lambda s: -len(moves[s])):
        at = rng.randrange(size)
        while not all(free[at + c] for c in moves[s]):
            at = rng.randrange(size)
        base[s] = at
        for c, t in moves[s].items():
            free[at + c], owner[at + c], to[at + c] = 0, s, t * 4
    ones = [(s, *next(iter(moves[s].items()))) for s in range(1, len(moves)) if len(moves[s]) == 1]
    if ones:
        s, c, t = np.array(ones).T
        places = np.flatnonzero(np.frombuffer(free, np.uint8)[:size])[:len(s)]
        base[s], owner[places], to[places] = places - c, s, t * 4
    return Moves(base, owner, to, miss.astype(np.int32))


class Parser:
    def __init__(self, alphabet: Alphabet, tables: dict[str, Moves], weights: dict[str, float]):
        self.alphabet, self.langs = alphabet, sorted(tables)
        self.tables = [tables[k] for k in self.langs]
        self.weights = np.array([weights[k] for k in self.langs])

    def phrases(self, symbols: list[np.ndarray]) -> np.ndarray:
        """Phrase counts, one row per text and one column per language."""
        n = np.array([-(-len(s) // BLOCK) for s in symbols])
        out = np.zeros((len(symbols), len(self.langs)))
        if not n.sum():
            return out
        grid = np.full((int(n.sum()), BLOCK + 1), PAD, self.alphabet.symbol.dtype)
        at = 0
        for s, k in zip(symbols, n):
            if k:
                flat = np.full(int(k) * BLOCK, PAD, grid.dtype)
                flat[:len(s)] = s
                grid[at:at + k, :BLOCK] = flat.reshape(int(k), BLOCK)
                at += int(k)
        columns = np.ascontiguousarray(grid.T).astype(np.int32)
        owner = np.repeat(np.arange(len(symbols)), n)
        for j, table in enumerate(self.tables):
            state = np.zeros(len(grid), np.int32)
            ended = np.zeros(len(grid), np.int32)
            for c in columns:
                v = table.step(state, c)
                ended += v & 3
                state = v >> 2
            out[:, j] = np.bincount(owner, weights=ended, minlength=len(symbols))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        symbols = [self.alphabet.read(t or "") for t in texts]
        cost = np.zeros((len(texts), len(self.langs)))
        at = 0
        while at < len(texts):                               # groups of about GROUP symbols, or one text in parts
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(symbols[stop]) <= GROUP):
                size += len(symbols[stop])
                stop += 1
            if stop == at + 1 and size > GROUP:
                whole = symbols[at]
                cost[at] = self.phrases([whole[i:i + GROUP] for i in range(0, len(whole), GROUP)]).sum(axis=0)
            else:
                cost[at:stop] = self.phrases(symbols[at:stop])
            at = stop
        cost *= self.weights
        langs, scores = [], []
        for s, row in zip(symbols, cost):
            if not len(s) or not len(row):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(row.argmin())
            rest = np.delete(row, best)
            langs.append(self.langs[best])
            scores.append(float(1 - row[best] / rest.min()) if len(rest) and rest.min() > 0 else 1.0)
        return langs, scores


def train(docs: DataFrame, sample: int = SAMPLE, rows: int = ROWS) -> Parser:
    """Automata from a bounded sample of labelled rows."""
    found: dict[str, list[tuple]] = {}
    for r in labelled_sample(docs, rows).collect():
        found.setdefault(r["lang"], []).append((r["r"], r["doc_id"], r["text"]))
    texts = {k: [t for _, _, t in sorted(v)] for k, v in found.items()}
    alphabet = Alphabet([t for v in texts.values() for t in v])
    tables, weights = {}, {}
    for lang, own in texts.items():
        share = max(1, sample // len(own))                   # first an even share of every document, then the rest
        parts = [alphabet.read(t) for t in own]
        taken = [p[:share] for p in parts] + [p[share:] for p in parts]
        joined = np.concatenate([np.append(p, GAP) for p in taken if len(p)] or [np.zeros(0, alphabet.symbol.dtype)])[:sample]
        if len(joined):
            tables[lang] = automaton(joined, alphabet.size)
            weights[lang] = math.log2(len(joined) + 1)
    return Parser(alphabet, tables, weights)


def predictions(docs: DataFrame, parser: Parser) -> DataFrame:
    """doc_id, held_out, lang_pred, score; one row per input row."""
    kept = Carried(docs.sparkSession, parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                langs, scores = kept.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()),
                                                  pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, parser: Parser, out: str) -> DataFrame:
    """``docs`` with the predicted language in column ``out``; all its own columns stay as they are."""
    kept = Carried(docs.sparkSession, parser)

    @F.pandas_udf("string")
    def predicted(texts):
        import pandas as pd

        return pd.Series([k for at in range(0, len(texts), 500) for k in kept.value.predict(list(texts[at:at + 500]))[0]],
                         index=texts.index, dtype=object)

    return docs.withColumn(out, predicted("text"))
