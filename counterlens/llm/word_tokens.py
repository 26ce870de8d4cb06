"""Ids of whole texts for a tokenizer that drops white space and ends every word: word by word, each distinct one once.

Where a tokenizer folds white space to one space, lower-cases character by character and drops the spaces when it cuts
words, a text's ids are the ids of its runs between ASCII spaces, tabs and line ends, one after the other: nothing
that composes, matches or merges reaches over such a place, and added tokens (exact strings without white space) do
not either. Between a letter of A-Z and a full stop or comma its pattern always cuts. A
tokenizer of another kind encodes whole texts.
"""

from __future__ import annotations

import json
import re

import numpy as np

from counterlens.llm.common import LOWER, worker_cache
from counterlens.llm.tokens import LINE, Encoder

_CODES = np.arange(256)
_LETTER = ((_CODES | 32) >= 97) & ((_CODES | 32) <= 122)
_MARK = (_CODES == 44) | (_CODES == 46)
_SPACES = np.where(np.isin(_CODES, (9, 10, 13)), 32, _CODES).astype(np.uint8)
_LOWER = LOWER[_SPACES]
ADDED = b"<|"
NORMAL = [("NFC", None), ("Replace", {"Regex": "\\s+"}), ("Lowercase", None)]
BATCH = 20_000                       # words handed to the library at once


def drops_space(spec: dict) -> bool:
    """Whether the rules above hold for the tokenizer in ``spec``."""
    normal = [(n.get("type"), n.get("pattern")) for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = not spec.get("truncation") and not spec.get("padding") and normal == NORMAL
    quiet = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") or re.search(r"\s", t["content"])
                    or ADDED.decode() not in t["content"]
                    for t in spec.get("added_tokens", []))
    split = (len(cuts) == 2 and cuts[0].get("type") == "Split" and cuts[0].get("invert") and cuts[0].get("behavior") == "Removed"
             and r"[^\s\p{L}\p{N}]+" in cuts[0]["pattern"].get("Regex", "") and cuts[1].get("type") == "ByteLevel"
             and not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex", True))
    return plain and quiet and split and bool((spec.get("model") or {}).get("end_of_word_suffix"))


class WordEncoder(Encoder):
    """As ``Encoder``; a piece is a word with the white space before it, or the stops behind one."""

    def __init__(self, spec: str):
        super().__init__(spec)
        known = json.loads(spec)
        self.by_piece = drops_space(known)
        vocabulary, end = self.tokenizer.get_vocab(with_added_tokens=True), (known.get("model") or {}).get("end_of_word_suffix")
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if end and t.endswith(end)]] = True

    def _folded(self, data: np.ndarray) -> np.ndarray:
        """Spaces for all white space at which is cut, lower case for A-Z; the library does both, but looks for added
        tokens first, all of which have ``ADDED`` inside."""
        if not self.by_piece:
            return data
        return (_SPACES if ((data[:-1] == ADDED[0]) & (data[1:] == ADDED[1])).any() else _LOWER)[data]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return super().encode(self._folded(data), offsets)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return super().counts(self._folded(data), offsets)

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        gap = data == 32
        starts = np.append(False, (gap[1:] & ~gap[:-1]) | (_MARK[data[1:]] & _LETTER[data[:-1]]))
        starts[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(starts)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encodes pieces and returns their numbers. Words of letters alone are encoded many to a text: each ends where
        a token with the word end does."""
        raw = data.tobytes()
        words = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
        words = [w.strip(" ") for w in words]
        plain = np.fromiter((w.isalpha() for w in words), bool, len(words))
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        number = np.empty(len(words), np.int64)
        number[order] = self.count + np.arange(len(words))
        own = [words[i] for i in np.flatnonzero(plain).tolist()]
        lines = [own[i:i + LINE] for i in range(0, len(own), LINE)]
        found = self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False) if lines else []
        for line, e in zip(lines, found):
            ids = np.array(e.ids, np.uint32)
            at = np.flatnonzero(self.closes[ids])
            if len(at) == len(line) and at[-1] == len(ids) - 1:          # every word has one end at least, so each has one
                self._keep(ids, np.diff(at, prepend=-1))
            else:
                self._add_each(line)
        rest = [words[i] for i in np.flatnonzero(~plain).tolist()]
        for at in range(0, len(rest), BATCH):
            self._add_each(rest[at:at + BATCH])
        return number


def word_encoder(spec: str) -> WordEncoder:
    """The worker's encoder for this tokenizer, kept across tasks."""
    cache = worker_cache("words")
    if cache.get("word-spec") != spec:
        cache["word-spec"], cache["word-encoder"] = spec, WordEncoder(spec)
    return cache["word-encoder"]
