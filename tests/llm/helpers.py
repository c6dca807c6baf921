"""Brute-force versions and awkward documents for the tests."""

import hashlib
import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")

#: doc_id, text, source, lang, n_chars and columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, score double, size long, component_id string, kept string, shard string"


def awkward():
    """Nulls everywhere, empty and long texts, ties, repeats, odd white space."""
    long_text = " ".join(f"word{i % 977}" for i in range(30_000))
    texts = [(0, "the cat sat on the mat and the dog lay by the door of the house"), (1, None), (2, ""), (3, "   \t\n "), (4, "one"), (None, "the cat sat on the mat and the dog lay by the door of the house"), (5, long_text), (6, long_text), (7, "ÄÖÜ é ﷽ 漢字   x\u000b y" * 9), (4, "one"), (8, "a" * 500), (9, "aaaa " * 80), (None, None)]
    return [(i, t, None if k % 3 == 0 else f"src{k % 2}", None if k % 4 == 0 else "en", None, float(k), k, "x", "y", "z") for k, (i, t) in enumerate(texts)]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text, k=2):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows, k=2, percent=80):
    """{doc_id: least doc_id} by trying all pairs."""
    sets = {i: shingle_set(t, k) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def brute_repeats(rows, width=50):
    """{doc_id: (bytes, removed, spans, digest)} for distinct non-null ids."""
    data = sorted((i, (t or "").encode()) for i, t in rows)
    first = {}
    for i, b in data:
        for s in range(len(b) - width + 1):
            first.setdefault(b[s : s + width], i)
    out = {}
    for i, b in data:
        gone = [False] * len(b)
        for s in range(len(b) - width + 1):
            if first[b[s : s + width]] < i:
                gone[s : s + width] = [True] * width
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def near_copies(n=120, words=90, seed=5):
    """A family of texts with few to many changed words, some exact copies, and others."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [r.choice(vocabulary) for _ in range(words)]
    rows = []
    for i in range(n):
        w = list(base) if i % 3 else [r.choice(vocabulary) for _ in range(words)]
        for _ in range(r.choice([0, 0, 1, 2, 4, 6, 8, 10])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, " ".join(w)))
    return rows
