"""Plain versions of the operators' contracts, one document or one pair after another."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from math import log10

import xxhash


def words(text):
    return (text or "").encode().split()


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(rows, radius=2):
    fps = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, f"{f:016x}", least.get(root(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def without_repeats(rows, window=50):
    first = {}
    for d, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            first[k] = min(d, first.get(k, d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < d:
                gone[p:p + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repetition(text, least=8):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered words, longest repeat."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if x.encode().split()]

    def covered(size):
        seen = Counter(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
        at = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                at.update(range(i, i + size))
        return len(at)

    longest = 0
    while longest < len(w) - 1 and covered(longest + 1):
        longest += 1
    return (len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), covered(3), covered(least), longest)


def secrets(text):
    text = text or ""
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ("assign", "access", "hex")
    joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*(sum(k == i for _, k, _ in spans) for i in range(3)), hashlib.sha256(joined.encode()).hexdigest(), joined)


class KneserNey:
    """Bigram model with plain dictionaries."""

    def __init__(self, rows):
        self.pairs, self.words = Counter(), Counter()
        for d, t in rows:
            if d is not None and zlib.crc32(str(d).encode()) % 10:
                s = [" start", *(x.decode() for x in (t or "").encode().lower().split()), " end"]
                self.words.update(s[1:])
                self.pairs.update(zip(s, s[1:]))
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.after = {}
        self.before = Counter(b for _, b in self.pairs)
        for (a, _), c in self.pairs.items():
            self.after.setdefault(a, []).append(c)
        self.d1, self.d0 = self.cut(self.pairs.values()), self.cut(self.before.values())

    @staticmethod
    def cut(counts):
        n1, n2, n3, n4 = (sum(c == k for c in counts) for k in (1, 2, 3, 4))
        if not (n1 and n2 and n3):
            return (0.5, 1.0, 1.5)
        y = n1 / (n1 + 2 * n2)
        return tuple(min(float(k), max(0.0, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))

    @staticmethod
    def less(c, d):
        return c - d[min(c, 3) - 1] if c else 0.0

    def lower(self, b):
        total = sum(self.before.values())
        if not total:
            return 1.0 / (self.v + 1)
        rest = sum(self.d0[min(c, 3) - 1] for c in self.before.values()) / total
        return self.less(self.before[b], self.d0) / total + rest / (self.v + 1)

    def p(self, a, b):
        seen = self.after.get(a)
        if not seen:
            return self.lower(b)
        return self.less(self.pairs[a, b], self.d1) / sum(seen) + sum(self.d1[min(c, 3) - 1] for c in seen) / sum(seen) * self.lower(b)

    def score(self, text):
        s = [" start", *(x.decode() for x in (text or "").encode().lower().split()), " end"]
        base = sum(log10((self.words[x] + 0.1) / (self.n + 0.1 * (self.v + 1))) for x in s[1:])
        return len(s) - 1, sum(self.words[x] > 0 for x in s[1:]), base, sum(log10(self.p(a, b)) for a, b in zip(s, s[1:]))
