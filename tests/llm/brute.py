"""Slow, plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text):
    words = spaced(lower(text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(docs, num=85):
    """doc_id -> (n_shingles, component_id) over all pairs that share a shingle; num: the least similarity in hundredths."""
    sets = {d: shingle_set(t) for d, t in docs}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    share = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            share[x].append(d)
    both = Counter()
    for ds in share.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1:]:
                both[min(a, b), max(a, b)] += 1
    for (a, b), n in both.items():
        if 100 * n >= num * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def letters(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def contamination(docs, items, width=13):
    """doc_id -> (n_words, n_hit, sorted item ids)."""
    holds = defaultdict(set)
    for i, t in items:
        w = letters(t)
        if w:
            for k in range(max(1, len(w) - width + 1)):
                holds[tuple(w[k:k + width])].add(str(i))
    sizes = {len(k) for k in holds}
    out = {}
    for d, t in docs:
        w, hit, found = letters(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                got = holds.get(tuple(w[k:k + n]))
                if got:
                    found |= got
                    hit |= set(range(k, k + n))
        out[d] = (len(w), len(hit), sorted(found))
    return out


def repeats(docs, length=200):
    """Row index -> (n_bytes, n_removed, n_spans, sha256 of the rest)."""
    bodies = [(t or "").encode() for _, t in docs]
    seen = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        rest = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def lines(docs, least=8):
    """doc_id -> (text that stays, n_lines, n_same, n_near); docs in order of doc_id."""
    seen, pieces, out = {}, defaultdict(list), {}
    for d, t in docs:
        stay, same, near = [], 0, 0
        parts = t.split("\n")
        for line in parts:
            w = tuple(spaced(line))
            if not w:
                stay.append(line)
                continue
            if w in seen:
                same += 1
                continue
            seen[w] = True
            found = False
            if len(w) >= least:
                halves = {(s, m, w[:m // 2] if s == "p" else w[len(w) - (m - m // 2):]) for m in (len(w), len(w) - 1) for s in "ps"}
                found = any(edit_distance(w, x) <= 1 for h in halves for x in pieces[h] if abs(len(x) - len(w)) < 2)
                for h in halves:
                    pieces[h].append(w)
            near += found
            if not found:
                stay.append(line)
        out[d] = ("\n".join(stay), len(parts), same, near)
    return out
