"""Plain, slow versions of the operators' contracts, for comparison."""
import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({c: chr(c + 32) for c in range(0x41, 0x5B)})


def lower(s):
    return s.translate(_LOWER)


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    hit = set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def decontaminate(docs, items, window=13):
    wins = {}
    for item, text in items:
        w = ITEM_WORD.findall(lower(text or ""))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i:i + window]), set()).add(item)
    sizes = {len(x) for x in wins}
    out = {}
    for doc, text in docs:
        w = ITEM_WORD.findall(lower(text or ""))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                k = tuple(w[i:i + n])
                if k in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[k]
        names = sorted(str(x) for x in found if x is not None)
        out[doc] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def simhash(text, size=4):
    w = WORD.findall(lower(text or ""))
    grams = [" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1) if w else 0)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(prints, distance=4):
    """prints: (doc_id, fingerprint) pairs -> {doc_id: smallest reachable}."""
    by = {}
    for d, f in prints:
        by.setdefault(f, []).append(d)
    fs = list(by)
    up = {f: f for f in fs}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= distance:
                up[root(a)] = root(b)
    low = {}
    for f in fs:
        r = root(f)
        low[r] = min([low.get(r, 1 << 62), *by[f]])
    return {d: low[root(f)] for d, f in prints}
