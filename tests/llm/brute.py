"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fold(text):
    return (text or "").translate(LOWER)


def near_duplicates(docs):
    """[(doc_id, text)] -> {doc_id: (n_shingles, component_id, kept)}"""
    sets = {}
    for i, t in docs:
        w = BLANK.findall(fold(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            same = len(x & y)
            if same and 100 * same >= 75 * (len(x) + len(y) - same):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def decontamination(docs, items):
    found = {}
    windows = {}
    for i, t in items:
        w = PLAIN.findall(fold(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(n, {}).setdefault(tuple(w[k : k + n]), set()).add(i)
    for i, t in docs:
        w, hit, names = PLAIN.findall(fold(t)), set(), set()
        for n, known in windows.items():
            for k in range(len(w) - n + 1):
                if (who := known.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    names |= {x for x in who if x is not None}
        found[i] = (len(w), len(hit), len(names), sha(",".join(sorted(map(str, names)))), bool(hit))
    return found


def substrings(docs):
    first, words, found = {}, {i: BLANK.findall(t or "") for i, t in docs}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        found[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return found


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def targets(sizes):
    """{source: words} -> {source: target}: dealing out the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, rest, out = set(order), 1.5 * sum(sizes.values()), {}
    while left:
        total = sum(weight[s] for s in left)
        now = {s: rest * weight[s] / total for s in left}
        over = {s for s in left if now[s] > 2 * sizes[s]}
        if not over:
            return out | now
        for s in over:
            out[s] = 2.0 * sizes[s]
            rest -= out[s]
        left -= over
    return out


def top_k(vectors, k=5):
    """[(vec_id, [int])] -> {query_id: [(vec_id, score)]}"""
    out = {}
    for q, v in vectors:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def crc(text):
    return zlib.crc32((text or "").encode())


def line_score(line, templates, df, n):
    """TF-IDF cosine of a line to each template, by definition."""
    import math

    words = lambda t: Counter(PLAIN.findall(fold(t)))
    terms = {w for ts in templates.values() for t in ts for w in words(t)}
    weight = lambda w: math.log((1 + n) / (1 + (df.get(w, 0) if w in terms else 1))) + 1
    vec = lambda t: {w: c * weight(w) for w, c in words(t).items()}
    own, best = vec(line), ("", 0.0)
    norm = math.sqrt(sum(x * x for x in own.values()))
    for name in sorted(templates):
        for t in templates[name]:
            other = vec(t)
            cosine = sum(x * other.get(w, 0) for w, x in own.items()) / norm / math.sqrt(sum(x * x for x in other.values())) if norm else 0
            if cosine > best[1] + 1e-12:
                best = (name, cosine)
    return best


def unit_score(unit, templates, df, n):
    """TF-IDF cosine of a unit to each template, by definition; every word weighs by its documents."""
    import math

    words = lambda t: Counter(PLAIN.findall(fold(t)))
    vec = lambda t: {w: c * (math.log((1 + n) / (1 + df.get(w, 0))) + 1) for w, c in words(t).items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    own, best = vec(unit), ("", 0.0)
    for name in sorted(templates):
        for t in templates[name]:
            other = vec(t)
            cosine = sum(x * other.get(w, 0) for w, x in own.items()) / length(own) / length(other)
            if cosine > best[1] + 1e-12:
                best = (name, cosine)
    return best
