"""The results of the registered queries from their definitions, in plain Python on small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def shingles(text, k=5):
    words = WORD.findall((text or "").translate(FOLD))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def roots_of(edges, ids):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_groups(docs):
    """docs: [(doc_id, text)] -> {doc_id: (n_shingles, component_id, kept)}, all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = defaultdict(int)
    for members in holders.values():
        for n, a in enumerate(members):
            for b in members[n + 1 :]:
                common[a, b] += 1
    edges = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    roots = roots_of(edges, list(sets))
    return {i: (len(sets[i]), roots[i], roots[i] == i) for i in sets}


def without_repeats(docs, width=20):
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: (d[0], d[1] or "")):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for p in range(len(words) - width + 1):
            window = tuple(words[p : p + width])
            if window in seen:
                gone[p : p + width] = [True] * width
            seen.add(window)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[i] = (len(words), sum(gone), sha(" ".join(kept)))
    return out


def edited(docs):
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for n, (i, text) in enumerate(order):
        text, after = text or "", order[(n + 1) % len(order)][1] or ""
        half = len(text) // 2
        out[i] = (len(text), sha(text[: len(text) - half] + after[:half]))
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def line_links(lines, threshold=2, edit_chars=6):
    """{line: lines within so many edits and one for each full edit_chars characters of the shorter one}"""
    lines = sorted(lines, key=len)
    links = {line: set() for line in lines}
    counts = {line: Counter(line) for line in lines}
    for n, a in enumerate(lines):
        allowed = min(threshold, len(a) // edit_chars)
        thirds = [a[i * len(a) // (allowed + 1) : (i + 1) * len(a) // (allowed + 1)] for i in range(allowed + 1)]
        for b in lines[n + 1 :] if allowed else ():
            if len(b) - len(a) > allowed:
                break
            if any(t in b for t in thirds) and (counts[a] - counts[b]).total() <= allowed and distance(a, b) <= allowed:
                links[a].add(b)
                links[b].add(a)
    return links
