"""The operators' contracts in plain Python, over whole small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from hashlib import sha256

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def near_groups(rows, k, percent=80):
    """{doc_id: (set size, smallest id of the component)} of distinct ids."""
    sets = {}
    for i, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    at = defaultdict(set)
    for i in ids:
        for s in sets[i]:
            at[s].add(i)
    for a in ids:
        for b in {x for s in sets[a] for x in at[s] if x > a}:
            n = len(sets[a] & sets[b])
            if 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def without_repeats(rows, width=20):
    """{doc_id: (n_words, n_removed, kept text)} of distinct ids."""
    first, gone, texts = {}, defaultdict(set), {}
    for i, t in sorted(rows):
        w = texts[i] = words(t)
        for j in range(len(w) - width + 1):
            if first.setdefault(tuple(w[j : j + width]), (i, j)) != (i, j):
                gone[i].update(range(j, j + width))
    return {
        i: (len(w), len(gone[i]), " ".join(x for j, x in enumerate(w) if j not in gone[i])) for i, w in texts.items()
    }


def base_quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed"""
    w = words(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered), failed


SECRETS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def base_secrets(text):
    """Spans (kind, start, end) by start, then kind."""
    found = [
        (m.start(), rank, kind, m.end())
        for rank, (kind, pattern, group, least) in enumerate(SECRETS)
        for m in pattern.finditer(text or "")
        if len(m[group]) >= least
    ]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def digest(spans):
    return sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
