"""Plain restatements of the operators' contracts."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def covered(units, window, count, key):
    mask = [0] * len(units)
    for i in range(len(units) - window + 1):
        if count[key(units[i : i + window])] > 1:
            mask[i : i + window] = [1] * window
    return mask


def phrases(rows, window=35):
    count = Counter(tuple(w[i : i + window]) for _, t in rows for w in [words(t)] for i in range(len(w) - window + 1))
    out = []
    for d, t in rows:
        w = words(t)
        m = covered(w, window, count, tuple)
        kept = " ".join(x for x, y in zip(w, m) if not y)
        out.append((d, len(w), sum(m), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def substrings(rows, window=400):
    count = Counter(b[i : i + window] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - window + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        m = bytes(covered(b, window, count, bytes))
        out.append((d, len(b), sum(m), len(re.findall(b"\x01+", m)), hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest()))
    return out


def groups(ids, links):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near(rows, n=3, percent=85):
    sets = {}
    for d, t in rows:
        w = words(t, lower=True)
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    holds, links = defaultdict(list), []
    for d in sorted(sets):
        shared = Counter(e for s in sets[d] for e in holds[s])
        links += [(e, d) for e, x in shared.items() if 100 * x >= percent * (len(sets[d]) + len(sets[e]) - x)]
        for s in sets[d]:
            holds[s].append(d)
    part = groups(sets, links)
    return [(d, len(s), part[d], part[d] == d) for d, s in sets.items()]
