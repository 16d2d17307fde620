"""Plain versions of the operators, for small tables."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def passages(rows, window):
    """(doc_id, words, which go), for rows of (doc_id, text)."""
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    last = float("inf")
    least = {}
    for d, ws in words:
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i : i + window])
            least[key] = min(least.get(key, last), last if d is None else d)
    found = []
    for d, ws in words:
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            if least[tuple(ws[i : i + window])] < (last if d is None else d):
                gone[i : i + window] = [True] * window
        found.append((d, ws, gone))
    return found


def shingles(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = WORD.findall(lower)
    if not ws:
        return set()
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} or {tuple(ws)}


def components(rows, k, percent):
    """doc_id to the least doc_id reachable."""
    sets = [(d, shingles(t, k)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {d: root(d) for d in parent}
