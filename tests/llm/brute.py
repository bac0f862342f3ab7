"""Plain restatements of the operators' results, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def near_duplicates(rows, percent, k):
    """rows: (doc_id, text) -> sorted (doc_id, n_shingles, component_id, kept)."""
    sets = []
    for doc_id, text in rows:
        w = (text or "").encode().translate(LOWER).split()
        sets.append((doc_id, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    nodes: dict = defaultdict(set)
    for doc_id, _ in sets:
        if doc_id is not None:
            nodes[doc_id].add(doc_id)
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t) and nodes[a] is not nodes[b]:
                joined = nodes[a] | nodes[b]
                for x in joined:
                    nodes[x] = joined
    out = []
    for a, s in sets:
        c = a if a is None else min(nodes[a])
        out.append((a, len(s), c, c == a))
    return sorted(out, key=str)


def without_repeats(rows, window):
    """rows: (doc_id, text) -> sorted (doc_id, n_words, n_removed, kept_sha256)."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    count = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def contamination(rows, items, window):
    """-> sorted (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    find = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    words = lambda s: find((s or "").encode().translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k : k + window])].add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w, ids = words(t), set()
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    ids |= found
                    hit[k : k + n] = [True] * n
        out.append((i, len(w), sum(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


def best_fit(lengths, capacity):
    """Remaining capacities of best-fit decreasing, piece after piece."""
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(bins) if r >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)
