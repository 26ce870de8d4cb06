"""Encoding whole texts with the tokenizers library, piece by piece.

A byte-level tokenizer with its usual pattern splits its input before a single space between two characters that are
not white space, between a letter and a full stop or comma, and between a single line break and a letter. Without a
normaliser, and with added tokens that have none of these inside, a text's ids are the ids of its pieces between such
places, one after the other. Pieces are found and named (by a 128-bit hash) on the text's
bytes in numpy, and each task has the library encode each distinct piece once. A tokenizer of another kind encodes
whole texts. Ids are the same either way.

Edge cases: an empty text (null comes in as one) has no ids; rows of which two different pieces share a name are encoded whole;
a task forgets its pieces beyond ``PIECES`` of them; text that is one piece, however long, is encoded as it is.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from counterlens.llm.common import BASES, BYTE_VALUES, mix, powers, worker_cache

PIECES = 1_500_000           # distinct pieces a task keeps before it starts anew
LINE = 1000                  # pieces that the library encodes as one text
SPACE_SIGN = "\u0120"        # the byte-level sign of a space

_CODES = np.arange(256)
_BLANK = ((_CODES >= 9) & (_CODES <= 13)) | ((_CODES >= 28) & (_CODES <= 32))      # white space of one byte
_LETTER = ((_CODES | 32) >= 97) & ((_CODES | 32) <= 122)
_OTHER = np.isin(_CODES, (194, 225, 226, 227))               # lead bytes under which wider white space lies
_WIDE = [c.encode() for c in map(chr, range(128, 0x3001)) if c.isspace()]          # and of two or three


def splits_at_spaces(spec: dict) -> bool:
    pre = spec.get("pre_tokenizer") or {}
    plain = not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
    quiet = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"[\s.,]", t["content"])
                    for t in spec.get("added_tokens", []))
    return (plain and quiet and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True))
            and not pre.get("add_prefix_space", True))


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start bytes of all pieces: every non-empty row's start, and the spaces before which a text may be cut."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    at = np.flatnonzero(data == 32)
    at = at[~edge[at] & ~edge[at + 1]]                       # neither first nor last in its row
    at = at[~_BLANK[data[at - 1]] & ~_BLANK[data[at + 1]]]
    wide = (data[at - 1] >= 128) | (data[at + 1] >= 128)     # a neighbour of several bytes may be white space too
    if wide.any():
        unsafe = np.zeros(len(at), bool)
        for c in _WIDE:
            n = len(c)
            before, after = (at >= n) & wide, (at + n < len(data)) & wide
            for k in range(n):
                before[before] = data[at[before] - n + k] == c[k]
                after[after] = data[at[after] + 1 + k] == c[k]
            unsafe |= before | after
        at = at[~unsafe]
    mark = np.flatnonzero((data == 44) | (data == 46))
    mark = mark[~edge[mark]]
    accented = (data[mark - 1] >= 128) & ~edge[mark - 1] & (data[mark - 2] == 195) & ((data[mark - 1] | 32) != 183)
    mark = mark[_LETTER[data[mark - 1]] | accented]          # 195 leads the accented letters, and times and divide
    line = np.flatnonzero(data == 10)
    line = line[~edge[line] & ~edge[line + 1]]
    line = line[(data[line - 1] < 128) & ~_BLANK[data[line - 1]] & _LETTER[data[line + 1]]] + 1
    rows = offsets[:-1][np.diff(offsets) > 0]
    return np.sort(np.concatenate([rows, at, mark, line]))


def piece_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each piece; pieces follow one another without a gap."""
    lens = ends - starts
    first = starts - starts[0]
    inside = np.arange(len(data)) - np.repeat(first, lens)
    values = BYTE_VALUES[0][data] * powers(BASES[0], int(lens.max()))[inside]
    size = lens.astype(np.uint64)
    one = np.add.reduceat(values, first)
    values ^= values >> np.uint64(31)
    values *= np.uint64(BASES[1])
    return mix(one + size), mix(np.add.reduceat(values, first) + size)


class Encoder:
    """Ids of texts for the tokenizer in ``spec`` (the text of its .json file)."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")       # Spark's tasks already use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.by_piece = splits_at_spaces(json.loads(spec))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)       # tokens that begin with a space
        self.opens[[i for t, i in vocabulary.items() if t.startswith(SPACE_SIGN)]] = True
        self.line_break = vocabulary.get("\u010a", -1)                              # the byte-level sign of a line break
        self._reset()

    def _reset(self):
        self.name = np.empty(0, np.uint64)           # known pieces, sorted
        self.check = np.empty(0, np.uint64)
        self.number = np.empty(0, np.int64)
        self.ids = np.empty(1 << 16, np.uint32)
        self.used = self.count = 0
        self.first = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def _keep(self, ids: np.ndarray, lengths: np.ndarray):
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.count + len(lengths) > len(self.first):
            self.first, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.length))
        self.ids[self.used:self.used + len(ids)] = ids
        own = slice(self.count, self.count + len(lengths))
        self.first[own] = self.used + np.cumsum(lengths) - lengths
        self.length[own] = lengths
        self.used += len(ids)
        self.count += len(lengths)

    def _add_each(self, pieces: list[str]):
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        self._keep(np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64))

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encodes pieces and returns their numbers. Words are encoded many to a text: those after a space as they are,
        each begins where a token begins with a space; the others with line breaks between."""
        lens = ends - starts
        first = np.cumsum(lens) - lens
        flat = data[np.repeat(starts - first, lens) + np.arange(int(lens.sum()))]
        blank = np.add.reduceat(_BLANK[flat], first)
        clear = ~(np.add.reduceat(_OTHER[flat], first) > 0)
        spaced = (data[starts] == 32) & (blank == 1) & clear & (lens > 1)
        bare = (blank == 0) & clear
        rest = ~(spaced | bare)
        number = np.empty(len(starts), np.int64)
        number[np.concatenate([np.flatnonzero(spaced), np.flatnonzero(bare), np.flatnonzero(rest)])] = self.count + np.arange(len(starts))
        for kind, gap in ((spaced, b""), (bare, b"\n")):
            pieces = np.split(flat[np.repeat(kind, lens)], np.cumsum(lens[kind])[:-1]) if kind.any() else []
            words = [p.tobytes() for p in pieces]
            lines = [words[i:i + LINE] for i in range(0, len(words), LINE)]
            texts = [gap.join(x).decode() for x in lines]
            for own, e in zip(lines, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []):
                ids = np.array(e.ids, np.uint32)
                if gap:
                    breaks = ids == self.line_break
                    cut = np.cumsum(~breaks)[breaks]                   # ids of words before each break
                    ids = ids[~breaks]
                    size = np.diff(np.concatenate([[0], cut, [len(ids)]]))
                else:
                    at = np.flatnonzero(self.opens[ids])
                    size = np.diff(np.append(at, len(ids)))
                if len(size) == len(own) and (size > 0).all() and int(size.sum()) == len(ids):
                    self._keep(ids, size)
                else:
                    self._add_each([w.decode() for w in own])
        if rest.any():
            self._add_each([data[a:b].tobytes().decode() for a, b in zip(starts[rest], ends[rest])])
        return number

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return piece_starts(data, offsets)

    def _places(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Number and row of every piece, in order; None where two different pieces have one name."""
        if self.count > PIECES:
            self._reset()
        starts = self._starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        name, check = piece_names(data, starts, ends)
        kinds, one, back = np.unique(name, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.name, kinds), max(len(self.name) - 1, 0))
        known = self.name[at] == kinds if len(self.name) else np.zeros(len(kinds), bool)
        number = np.empty(len(kinds), np.int64)
        number[known] = self.number[at[known]]
        if (check[one][back] != check).any() or (known.any() and (self.check[at[known]] != check[one[known]]).any()):
            return None                          # one in 2 ** 64 for each pair: the rows are encoded whole
        if not known.all():
            new = one[~known]
            number[~known] = self._learn(data, starts[new], ends[new])
            place = np.searchsorted(self.name, kinds[~known])          # one array after the other: they may be large
            self.name = np.insert(self.name, place, kinds[~known])
            self.check = np.insert(self.check, place, check[new])
            self.number = np.insert(self.number, place, number[~known])
        return number[back], np.searchsorted(offsets, starts, "right") - 1

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets, offsets[1:])]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows one after the other, and how many each row has."""
        if not self.by_piece:
            return self._whole(data, offsets)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        found = self._places(data, offsets)
        if found is None:
            return self._whole(data, offsets)
        place, row = found
        lens = self.length[place]
        ends = np.cumsum(lens)
        ids = self.ids[np.repeat(self.first[place] - (ends - lens), lens) + np.arange(int(lens.sum()))]
        return ids, np.bincount(row, weights=lens, minlength=len(offsets) - 1).astype(np.int64)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not self.by_piece or not len(data):
            return self.encode(data, offsets)[1]
        found = self._places(data, offsets)
        if found is None:
            return self._whole(data, offsets)[1]
        place, row = found
        return np.bincount(row, weights=self.length[place], minlength=len(offsets) - 1).astype(np.int64)


def encoder(spec: str) -> Encoder:
    """The worker's encoder for this tokenizer, kept across tasks."""
    cache = worker_cache("tokens")
    if cache.get("spec") != spec:
        cache["spec"], cache["encoder"] = spec, Encoder(spec)
    return cache["encoder"]
