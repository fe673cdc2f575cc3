"""Brute-force versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter
from itertools import combinations

import regex

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


# Letters, digits and marks of Unicode; in scripts without blanks each character with its marks.
ALONE = (r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F"
         r"\U0001B000-\U0001B16F\U00020000-\U0003FFFF")
UNICODE = regex.compile(rf"(?V1)[[{ALONE}]&&[\p{{L}}\p{{N}}]]\p{{M}}*|(?:[[\p{{L}}\p{{N}}]--[{ALONE}]]\p{{M}}*)+")


def unicode_words(text):
    return UNICODE.findall((text or "").translate(FOLD))


def without_repeats(rows, length=100):
    """{(id, text): (bytes, removed, spans, kept)} by looking at every string."""
    def place(i, p):
        return (-(1 << 63) if i is None else i, p)

    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(first.get(s, place(i, p)), place(i, p))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < place(i, p):
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i, t] = len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)
    return out


def shingles(text, width=5):
    w = unicode_words(text)
    return Counter(tuple(w[j : j + width]) for j in range(max(len(w) - width + 1, 1 if w else 0)))


def probability_jaccard(a, b):
    every = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in every) for d in a if d in b)


def near_classes(rows, threshold=0.8):
    """{position: smallest id of its class}, comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in combinations(range(len(rows)), 2):
        if sets[x] and sets[x].keys() & sets[y].keys() and find(x) != find(y) and probability_jaccard(sets[x], sets[y]) >= threshold:
            parent[find(y)] = find(x)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return {k: low.get(find(k)) if sets[k] else rows[k][0] for k in range(len(rows))}


def contamination(text, items, width=10):
    """(words, hit words, sorted items with an occurrence, longest verbatim match)."""
    w, hit, found, longest = words(text), set(), set(), 0
    for i, t in items:
        v = words(t)
        n = min(len(v), width)
        for a in range(len(v) - n + 1 if v else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[a : a + n]:
                    hit |= set(range(p, p + n))
                    found.add("" if i is None else str(i))
                    m = n
                    while a + m < len(v) and p + m < len(w) and v[a + m] == w[p + m]:
                        m += 1
                    longest = max(longest, m)
    return len(w), len(hit), sorted(found), longest


def digest(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()
