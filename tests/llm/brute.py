"""Plain versions of the corpus queries, for small tables. ``docs`` is a list of (doc_id, text, source, lang)."""

import collections
import hashlib
import re
import zlib

import numpy as np
import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def id_order(i):
    return (i is not None, i or 0)


def targets(docs, weights=(5, 2, 1), share=1.5, most=2.0):
    """Source targets by resharing the excess again and again."""
    size = collections.Counter()
    for _, text, source, _ in docs:
        size[source] += len(SPACE.findall(text or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left = {}, share * sum(size.values())
    while True:
        rest = [s for s in order if s not in full]
        level = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if level[s] > most * size[s]]
        if not over:
            return size, {**full, **level}
        for s in over:
            full[s] = most * size[s]
            left -= full[s]


def nearest_total(sizes, target):
    """How near to ``target`` whole copies plus a subset of one more copy each can come."""
    base = int(target / sum(sizes)) * sum(sizes) if sum(sizes) else 0
    sums = {base}
    for x in sizes:
        sums |= {v + x for v in sums if v <= target + max(sizes)}
    return min(abs(v - target) for v in sums)


def window_repeats(docs, width=20):
    seen, out = {}, {}
    for i, text in sorted({(d[0], d[1] or "") for d in docs}, key=lambda d: id_order(d[0])):
        words = SPACE.findall(text)
        gone = [False] * len(words)
        for s in range(len(words) - width + 1):
            if seen.setdefault(tuple(words[s:s + width]), (i, s)) != (i, s):
                gone[s:s + width] = [True] * width
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[i, text] = (len(words), sum(gone), sha(kept.encode()))
    return sorted(((d[0], *out[d[0], d[1] or ""]) for d in docs), key=repr)


def byte_repeats(docs, length=200):
    count = collections.Counter()
    raw = [(d[0], (d[1] or "").encode()) for d in docs]
    for _, b in raw:
        count.update(b[s:s + length] for s in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return sorted(out, key=repr)


def licenses(docs):
    out = []
    for i, text, *_ in docs:
        words = ALNUM.findall((text or "").translate(LOWER))
        places, labels = [], set()
        for phrase, label in PHRASES.items():
            own = phrase.split()
            found = [s for s in range(len(words) - len(own) + 1) if words[s:s + len(own)] == own]
            places += found
            labels |= {label} if found else set()
        out.append((i, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    return sorted(out, key=repr)


def fingerprint(text):
    words = SPACE.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[s:s + 4]) for s in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs, distance=4):
    fps = [fingerprint(d[1]) for d in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for k, d in enumerate(docs):
        if d[0] is not None:
            least[find(k)] = min(d[0], least.get(find(k), d[0]))
    return sorted(((d[0], f"{fps[k]:016x}", least.get(find(k))) for k, d in enumerate(docs)), key=repr)


def contamination(docs, items, size=10):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        for s in range(max(1, len(words) - size + 1) if words else 0):
            windows[tuple(words[s:s + size])].add("" if item is None else str(item))
    out = []
    for i, text, *_ in docs:
        words = ALNUM.findall((text or "").translate(LOWER))
        hit, found = [0] * len(words), set()
        for n in {len(w) for w in windows}:
            for s in range(len(words) - n + 1):
                if tuple(words[s:s + n]) in windows:
                    found |= windows[tuple(words[s:s + n])]
                    hit[s:s + n] = [1] * n
        out.append((i, len(words), sum(hit), len(found), sha(",".join(sorted(found)).encode())))
    return sorted(out, key=repr)


def token_ids(docs, tokenizer):
    return [e.ids for e in tokenizer.encode_batch([d[1] or "" for d in docs], add_special_tokens=False)]


def huffman_rows(docs, tokenizer, end_id):
    rows = [(d[0], np.array([*ids, end_id], "<u4").tobytes()) for d, ids in zip(docs, token_ids(docs, tokenizer))]
    rows.sort(key=lambda r: (*id_order(r[0]), zlib.crc32(r[1])))
    out, at = [], 0
    for i, raw in rows:
        out.append((i, at, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    return sorted(out, key=repr)


def phrases(text, sample):
    """Greedy longest matches of ``text`` in ``sample``."""
    n, at = 0, 0
    while at < len(text):
        stop = at + 1
        while stop <= len(text) and text[at:stop] in sample:
            stop += 1
        at = max(at + 1, stop - 1)
        n += 1
    return n


def neighbours(rows, k=20):
    ok = [(i, np.array(v, float)) for i, v in rows
          if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    sizes = collections.Counter(len(v) for _, v in ok)
    common = min(sizes, key=lambda n: (-sizes[n], n)) if sizes else 0
    ok = [(i, v) for i, v in ok if len(v) == common]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            found = sorted((-float(np.einsum("i,i->", v, q)), j) for j, v in ok if j != i)[:k]
            out[i] = [(j, -s) for s, j in found]
    return out
