"""Plain-Python versions of what the text operators compute."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


def stats(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def links(rows, threshold=0.8):
    """rows: (id, text); per position the number of other rows at the threshold, and the least id of the component."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().split()
        k = min(5, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    count = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                count[a] += 1
                count[b] += 1
                parent[find(a)] = find(b)
    members = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        members[find(i)].append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return count, [least[find(i)] for i in range(len(rows))]


def decon_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def decontaminate(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = decon_words(text)
        for i in range(max(1, len(w) - 7)) if w and item is not None else ():
            windows[tuple(w[i : i + 8])].add(item)
    out = set()
    for doc, text in docs:
        w, hit, found = decon_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.add((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(found) >= 2))
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Shares by weight; the excess over the caps shared again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, done, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(done.values())
        part = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > most * sizes[s]]
        if not over:
            return done | part
        for s in over:
            done[s] = most * sizes[s]
            open_.discard(s)
    return done
