"""Plain versions of the operators, one row and one word at a time."""

import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


class Groups:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def substring_dedup(rows, window=50):
    """[(doc_id, words kept, words)] of [(doc_id, text)]."""
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            if doc is not None:
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone |= set(range(i, i + window))
        out.append((doc, " ".join(x for i, x in enumerate(w) if i not in gone), len(w)))
    return out


def grams(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def jaccard_groups(rows, similarity=0.8):
    """{place of row: (least place of its group, links)}; texts without words link to nothing."""
    sets = [grams(t) for _, t in rows]
    groups, links = Groups(range(len(rows))), Counter()
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                groups.join(a, b)
    return {i: (groups.root(i), links[i]) for i in range(len(rows))}


def simhash_line(line, hash_of):
    w = set(words(line.lower()))
    bits = np.zeros(64, int)
    for x in w:
        h = hash_of(x)
        bits += [(h >> b) & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if bits[b] > len(w) / 2)


def line_dedup(rows, hash_of, bits=3, similarity=0.9):
    """{(doc_id, text): numbers of the lines that go}."""
    occurrences, sims = [], {}
    for doc, text in dict.fromkeys(rows):
        for n, line in enumerate((text or "").split("\n")):
            key = " ".join(words(line.lower()))
            if key:
                occurrences.append(((doc is None, doc if doc is not None else 0, n), (doc, text), n, key))
                sims.setdefault(key, simhash_line(line, hash_of))
    keys = list(sims)
    groups = Groups(range(len(keys)))
    for a in range(len(keys)):
        for b in range(a):
            if bin(sims[keys[a]] ^ sims[keys[b]]).count("1") <= bits:
                longest = max(len(keys[a]), len(keys[b]))
                if distance(keys[a], keys[b]) <= int((1 - similarity) * longest + 1e-9):
                    groups.join(a, b)
    root = {k: groups.root(i) for i, k in enumerate(keys)}
    seen, gone = set(), {r: [] for r in rows}
    for _, row, n, key in sorted(occurrences, key=lambda o: o[0]):
        if root[key] in seen:
            gone[row].append(n)
        seen.add(root[key])
    return gone


def targets(sizes, share=1.5, weights=(3, 1, 2), most=2.0):
    """{source: target} of {source: size} by sharing what is above the caps again and again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > most * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / w for s in open_}
        fixed |= {s: most * sizes[s] for s in over}
