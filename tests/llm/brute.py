"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def low(text):
    return (text or "").translate(UPPER)


def suffix_dedup(rows, length=400):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])[:len(gone)]).sum())
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def quality_base(text):
    t, w = text or "", words(text)
    seen, again = set(), 0
    for line in t.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    c = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(inside)


def mix_targets(sizes, weights=(5, 2, 1), most=3):
    """sizes by source in order; shares by weight, the excess over the caps shared again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        room = total - sum(capped.values())
        share = {s: room * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}


def simhash(text, n=4):
    w = words(low(text))
    grams = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingles(text, n=5):
    w = words(low(text))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near_components(prints, radius=4):
    """Least id reachable for each (id, fingerprint)."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(prints):
        least[find(i)].append(d)
    return [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(prints))]


def tree_scores(train, texts, depth=4):
    """Context-tree weighting with trees of dictionaries."""
    n, nodes, below = defaultdict(lambda: [0, 0]), set(), defaultdict(list)

    def events(t):
        b = b"\xff" * depth + low(t).encode() + b"\xff"
        for i in range(depth, len(b)):
            node = 1
            for j in range(7, -1, -1):
                yield b[i - depth:i], node, b[i] >> j & 1
                node = node * 2 + (b[i] >> j & 1)

    for t in texts:
        nodes.update((ctx[depth - d:], node) for ctx, node, _ in events(t) for d in range(depth + 1))
    for t in train:
        for ctx, node, bit in events(t):
            for d in range(depth + 1):
                n[(ctx[depth - d:], node)][bit] += 1
    for ctx, node in nodes:
        if ctx:
            below[(ctx[1:], node)].append((ctx, node))
    weighted, share = {}, {}
    for k in sorted(nodes, key=lambda k: -len(k[0])):
        a, b = n[k]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        rest = sum(weighted[x] for x in below[k])
        if len(k[0]) == depth:
            weighted[k], share[k] = own, 1.0
        else:
            weighted[k] = np.logaddexp(own, rest) - math.log(2)
            share[k] = 1 / (1 + math.exp(min(rest - own, 700)))
    out = []
    for t in texts:
        total = 0.0
        for ctx, node, bit in events(t):
            p = None
            for d in range(depth, -1, -1):
                k = (ctx[depth - d:], node)
                own = (n[k][bit] + 0.5) / (sum(n[k]) + 1)
                p = own if p is None else share[k] * own + (1 - share[k]) * p
            total += math.log10(p)
        out.append(total)
    return out
