"""Plain versions of the digest contracts, for comparison."""

import hashlib
import re
import zlib
from collections import defaultdict

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def components(docs, k=5, percent=75):
    """{index: (n_shingles, component)} of (doc_id, text) rows, by all pairs that share a shingle."""
    sets = []
    for _, t in docs:
        w = SPACED.findall(lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    seen = set()
    for own in by.values():
        for a in range(len(own)):
            for b in range(a):
                p = (own[b], own[a])
                if p in seen:
                    continue
                seen.add(p)
                i = len(sets[p[0]] & sets[p[1]])
                if 100 * i >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - i):
                    root[find(p[0])] = find(p[1])
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)]


def contamination(docs, items, k=13):
    windows = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall(lower(t))
        n = min(k, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    sizes = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w = ALNUM.findall(lower(t))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    found |= own
                    hit.update(range(i, i + n))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def licenses(docs):
    out = []
    for d, t in docs:
        w = ALNUM.findall(lower(t))
        at = [(i, x) for x, p in PHRASES.items() for i in range(len(w)) if w[i : i + len(p)] == p]
        out.append((d, len(w), len(at), min([i for i, _ in at], default=None), max([i for i, _ in at], default=None), ",".join(sorted({x for _, x in at}))))
    return out


def media(docs):
    out = []
    for d, t in docs:
        b = (t or "").encode()
        p = b.ljust(max(1, -(-len(b) // 192)) * 192, b" ")
        out.append((d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    return out
