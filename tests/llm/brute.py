"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

from gridspark.llm import licenses

SPLIT = re.compile(rb"[\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, n):
    w = [x for x in SPLIT.split((text or "").encode().translate(LOWER)) if x]
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows, n, percent):
    """{doc_id: (set size, smallest reachable doc_id)} for rows with distinct ids."""
    sets = {d: shingles(t, n) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeats(texts, length):
    """(bytes, removed, spans, sha256 of the rest) of each text."""
    texts = [(t or "").encode() for t in texts]
    count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def notices(text, items):
    """(first, last word, template number) of the notices in a text, by the words of every template at every
    place; of those that overlap the one with the best score stays."""
    at = {}
    for p, w in enumerate(licenses.tokens(text or "")):
        at.setdefault(w, []).append(p)
    found = [(-score, -same, first, last, i) for i, t in enumerate(items) for score, same, first, last in t.notices(at)]
    taken = []
    for _, _, first, last, i in sorted(found):
        if all(b < first or a > last for a, b, _ in taken):
            taken.append((first, last, i))
    return sorted(taken)
