"""Plain versions of what the operators compute."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, width):
    ws = words(text)
    if not ws:
        return set()
    return {tuple(ws[k : k + width]) for k in range(max(1, len(ws) - width + 1))}


def near_duplicate_classes(texts, width=5, percent=80):
    """{id: smallest id reachable} over all pairs."""
    sets = {k: shingles(t, width) for k, t in texts.items()}
    up = {k: k for k in texts}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: root(k) for k in texts}
