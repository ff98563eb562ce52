"""Plain Python forms of the operators, for small fixtures."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def corpus(seed=0, n=60):
    """(doc_id, text): prose, exact and near copies, shared lines, odd texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    line = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    common = line(14)
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.2:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.45:
            words = (rng.choice(rows)[1] or "x").split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        else:
            text = "\n".join([line(rng.randint(3, 40)) for _ in range(rng.randint(1, 4))] + [common] * (kind > 0.8))
        rows.append((i * 3, text))
    odd = [None, "", " \n\t ", "one", "One", "a b c", "A B  c", "é" * 80, "x" * 300, "x" * 120 + "y", "a b c d e " * 30, "\x00\x01 nul \x00" * 20]
    return rows + [(1000 + i, t) for i, t in enumerate(odd)]


def components(rows, num=75, den=100):
    sets = {}
    for i, t in rows:
        w = lowered(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def suffixes(rows, size=50):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if seen.setdefault(b[p : p + size], i) < i:
                gone[p : p + size] = b"\1" * size
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out[i] = (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


def rules(t):
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def lines(rows, least):
    seqs = [(i, (t or "").split("\n")) for i, t in sorted(rows, key=lambda r: r[0])]
    seen, gone = set(), set()
    for i, ls in seqs:
        for a in range(len(ls)):
            words = 0
            for b in range(a + 1, len(ls) + 1):
                words += len(WORD.findall(ls[b - 1]))
                key = tuple(ls[a:b])
                if key in seen:
                    if words >= least:
                        gone.update((i, x) for x in range(a, b))
                else:
                    seen.add(key)
    return gone


def leaks(rows, items, threshold=0.75):
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    out = {}
    for i, t in rows:
        w = lowered(t)
        for j, s in items:
            v = lowered(s)
            if not v or not w or (len(v) < 5) > (len(w) >= len(v)):
                continue
            best, n = 0.0, min(len(v), len(w))
            for a in range(len(w) - n + 1):
                x, y = grams(w[a : a + n]), grams(v)
                both = sum((x & y).values())
                best = max(best, both / (sum(x.values()) + sum(y.values()) - both))
            if best >= threshold:
                out[(i, j)] = best
    return out


def kneser_ney(rows, order, discounts_of):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    text = lambda t: ["<s>"] * (order - 1) + lowered(t) + ["</s>"]
    grams = {n: Counter() for n in range(1, order + 1)}
    for i, t in rows:
        if not held(i):
            w = text(t)
            for k in range(order - 1, len(w)):
                for n in grams:
                    grams[n][tuple(w[k - n + 1 : k + 1])] += 1
    total, known = sum(grams[1].values()), len(grams[1])
    adjusted = {order: grams[order]}
    for n in range(order - 1, 0, -1):
        adjusted[n] = Counter(g[1:] for g in adjusted[n + 1])
        for g in adjusted[n]:
            if g[0] == "<s>":
                adjusted[n][g] = grams[n][g]
    cut, context = {}, {}
    for n, c in adjusted.items():
        k = Counter(c.values())
        cut[n] = discounts_of(k[1], k[2], k[3], k[4])
        context[n] = defaultdict(lambda: [0, 0, 0, 0])
        for g, a in c.items():
            context[n][g[:-1]][0] += a
            context[n][g[:-1]][min(a, 3)] += 1

    def p(h, w):
        n = len(h) + 1
        low = 1 / (known + 1) if n == 1 else p(h[1:], w)
        if h not in context[n]:
            return low
        a, (t, *kinds) = adjusted[n].get((*h, w), 0), context[n][h]
        d = cut[n][min(a, 3) - 1] if a else 0
        return max(a - d, 0) / t + sum(x * y for x, y in zip(cut[n], kinds, strict=True)) / t * low

    out = {}
    for i, t in rows:
        w = text(t)
        own = w[order - 1 :]
        out[i] = (held(i), len(own), sum((x,) in grams[1] for x in own), total, sum(math.log10((grams[1][(x,)] + 0.5) / (total + 0.5 * (known + 1))) for x in own), sum(math.log10(p(tuple(w[k : k + order - 1]), w[k + order - 1])) for k in range(len(own))))
    return out, p, [g[0] for g in grams[1]]
