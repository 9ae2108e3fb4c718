"""Plain restatements of the contracts, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def quality(text):
    t = text or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = list(zip(w, w[1:], w[2:]))
    n, cover = Counter(grams), set()
    for k, g in enumerate(grams):
        if n[g] > 1:
            cover |= {k, k + 1, k + 2}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def substrings(docs, width=13):
    ws, first = [(i, WORD.findall(t or "")) for i, t in docs], {}
    for i, w in sorted(((i, w) for i, w in ws if i is not None), key=lambda x: x[0]):
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = []
    for i, w in ws:
        gone = set()
        if i is not None:
            for k in range(len(w) - width + 1):
                if first[tuple(w[k : k + width])] < i:
                    gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def hits(docs, bench, width=13):
    windows = defaultdict(set)
    for item, t in bench:
        w = ALNUM.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k : k + width])].add(item)
    out = []
    for i, t in docs:
        w, hit, items = ALNUM.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= got
        out.append((i, len(w), len(hit), sorted(items)))
    return out


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near(docs, k, percent):
    sets = [(i, shingles(t, k)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)
