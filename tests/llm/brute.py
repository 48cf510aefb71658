"""What the operators that compare rows should give, in the plainest way."""

import hashlib
import re
from collections import defaultdict

import xxhash


def groups(nodes, links):
    """Least node that each node reaches."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_dedup(docs, least):
    """Texts without each line that lies in a run of ``least`` words that stood earlier."""
    lines = {k: [(i, line) for i, line in enumerate((t or "").split("\n")) if line.split()] for k, t in docs}
    runs = defaultdict(list)
    for k in lines:
        for a in range(len(lines[k])):
            for b in range(a, len(lines[k])):
                part = lines[k][a : b + 1]
                if sum(len(x.split()) for _, x in part) >= least:
                    runs[tuple(x.strip() for _, x in part)].append((k, a, b))
    gone = defaultdict(set)
    for places in runs.values():
        for k, a, b in sorted(places)[1:]:
            gone[k] |= set(range(lines[k][a][0], lines[k][b][0] + 1))
    return {k: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) for k, t in docs}


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_windows(items, size=13):
    """Items of each window."""
    windows = defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        for k in range(max(len(w) - size, 0) + 1 if w else 0):
            windows[tuple(w[k : k + size])].add(str(i))
    return windows


def plain_contamination(text, windows):
    doc, hit, named = plain_words(text), set(), set()
    for n in {len(w) for w in windows}:
        for a in range(len(doc) - n + 1):
            if found := windows.get(tuple(doc[a : a + n])):
                hit |= set(range(a, a + n))
                named |= found
    return len(doc), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(doc)


def plain_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
