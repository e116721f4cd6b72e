"""Plain versions of the operators, to hold results against."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def repeated_bytes(docs, length=100):
    """docs: (id, text) in order. {id: (bytes, removed, spans, sha256)}; also the kept bytes."""
    seen, out, kept_of = {}, {}, {}
    for i, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen and seen[w] != (i, s):
                gone[s : s + length] = b"\1" * length
            seen.setdefault(w, (i, s))
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i], kept_of[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()), kept
    return out, kept_of


def shingle_set(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return set() if not w else {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(docs, n, percent):
    """{id: (size, component)}."""
    sets = {i: shingle_set(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i in sorted(sets):
        common = collections.Counter()
        for g in sets[i]:
            common.update(holders[g])
            holders[g].append(i)
        for j, c in common.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def kneser_ney(docs, held):
    """{id: (tokens, known, base, score)} of docs {id: text}; trained on those that held(id) rejects."""
    texts = {i: [*WORD.findall((t or "").translate(LOWER)), "\0"] for i, t in docs.items()}
    train = [i for i in texts if not held(i)]
    c = collections.Counter(w for i in train for w in texts[i])
    n, v = sum(c.values()), len(c)
    pairs = collections.Counter(p for i in train for p in zip(["\1", *texts[i]], texts[i], strict=False))
    total, kinds, cont = collections.Counter(), collections.Counter(), collections.Counter()
    for (a, b), x in pairs.items():
        total[a] += x
        kinds[a, min(x, 3)] += 1
        cont[b] += 1

    def discounts(counts):
        k = [sum(1 for x in counts if x == i) for i in (1, 2, 3, 4)]
        if min(k[:3]) <= 0:
            return [0, 0.5, 0.75, 0.9] if k[0] else [0, 0, 0, 0]
        y = k[0] / (k[0] + 2 * k[1])
        return [0] + [min(max(i - (i + 1) * y * k[i] / k[i - 1], 0), i) for i in (1, 2, 3)]

    d, e = discounts(pairs.values()), discounts(cont.values())
    mass = sum(e[min(x, 3)] for x in cont.values())

    def low(w):
        return (max(cont[w] - e[min(cont[w], 3)], 0) + mass / (v + 1)) / len(pairs) if pairs else 1 / (v + 1)

    def p(a, b):
        if not total[a]:
            return low(b)
        x = pairs[a, b]
        return (max(x - d[min(x, 3)], 0) + sum(d[k] * kinds[a, k] for k in (1, 2, 3)) * low(b)) / total[a]

    out = {}
    for i, w in texts.items():
        out[i] = (len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(a, b)) for a, b in zip(["\1", *w], w, strict=False)))
    return out, n


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n
