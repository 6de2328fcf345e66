"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def shingle_sets(rows, n):
    out = []
    for key, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", lower_ascii(text or ""))
        k = min(n, len(words))
        out.append((key, {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()))
    return out


def components(rows, n, percent=80):
    """{doc_id: (n_shingles, component_id)} for distinct ids, by an inverted index over all shingles."""
    sets = shingle_sets(rows, n)
    parent = {k: k for k, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    of = {}
    for k, s in sets:
        for x in s:
            of.setdefault(x, []).append(k)
    by = dict(sets)
    done = set()
    for group in of.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                if (a, b) not in done:
                    done.add((a, b))
                    both = len(by[a] & by[b])
                    if 100 * both >= percent * (len(by[a]) + len(by[b]) - both):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets}


def remove_repeats(rows, length):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)}: bytes inside a string of that length that starts anywhere else."""
    seen = {}
    data = [(k, (t or "").encode()) for k, t in rows]
    for _, b in data:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def contamination(docs, items, n=13):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for key, text in items:
        w = word.findall(lower_ascii(text or ""))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(key)
    sizes = {len(w) for w in windows}
    out = []
    for key, text in docs:
        w = word.findall(lower_ascii(text or ""))
        hit, found = set(), set()
        for s in sizes:
            for i in range(len(w) - s + 1):
                if (of := windows.get(tuple(w[i : i + s]))) is not None:
                    hit.update(range(i, i + s))
                    found |= of
        ids = ",".join(sorted(map(str, found)))
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out
