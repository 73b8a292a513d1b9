"""Brute force for the operators, in plain Python."""

from __future__ import annotations

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"
#: A table whose other columns have names that operators use themselves.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, words string, line string, digest string, score double, ids string, count int, label string, node string, n_lines int"


def words(text, pattern=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"):
    return re.findall(pattern, (text or "").translate(LOWER))


def shingles(text):
    w = words(text, r"[^\x20\x09-\x0D]+")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows, percent=75):
    """{doc_id: smallest doc_id reachable} by all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in rows}


def windows(text, size=10):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def decontaminated(docs, items, size=10):
    """{doc_id: (n_words, n_hit, ids)}"""
    own = [(str(i), g) for i, t in items for g in windows(t, size)]
    out = {}
    for d, text in docs:
        w, hit, ids = words(text), set(), set()
        for i, g in own:
            for at in range(len(w) - len(g) + 1):
                if tuple(w[at : at + len(g)]) == g:
                    hit |= set(range(at, at + len(g)))
                    ids.add(i)
        out[d] = (len(w), len(hit), sorted(ids))
    return out


def line_deduped(docs, min_docs=10):
    """[(doc_id, text, n_lines, n_dropped)], each row a document"""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = {}
    for n, (_, text) in enumerate(docs):
        for k in {key(x) for x in (text or "").split("\n")}:
            seen.setdefault(k, set()).add(n)
    common = {k for k, v in seen.items() if k and len(v) >= min_docs}
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in common]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
