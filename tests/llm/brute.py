"""Plain single-process versions of the corpus queries, written from their definitions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return _WORD.findall(text or "")


def decontaminate(docs, items, window=13):
    """docs: (id, text); items: (item_id, text) -> rows of op1"""
    index = defaultdict(set)
    for item, text in items:
        w = _ALNUM.findall((text or "").translate(_UPPER))
        for s in range(max(len(w) - window, 0) + 1 if w else 0):
            index[tuple(w[s: s + window])].add(str(item))
    lengths = {len(k) for k in index}
    out = []
    for i, text in docs:
        w = _ALNUM.findall((text or "").translate(_UPPER))
        hit, found = set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if got := index.get(tuple(w[p: p + n])):
                    hit.update(range(p, p + n))
                    found |= got
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def targets(sizes, weights=(5, 2, 1), cap=3):
    """sizes: source -> words; the iterative definition"""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, left, open_ = {}, sum(sizes.values()), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] > cap * sizes[s] * total]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = float(cap * sizes[s])
            open_.remove(s)
        left -= sum(cap * sizes[s] for s in over)
    return target


def near_groups(docs, k=3, percent=85):
    """docs: (id, text) -> id -> (set size, component); quadratic over texts that share a shingle"""
    sets = {}
    for i, text in docs:
        w = words((text or "").translate(_UPPER))
        n = min(k, len(w))
        sets[i] = {tuple(w[p: p + n]) for p in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    shared = Counter((a, b) for h in holders.values() for x, a in enumerate(h) for b in h[x + 1:])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def substrings(docs, window=50):
    first = {}
    split = [(i, words(t)) for i, t in docs]
    for i, w in split:
        for p in range(len(w) - window + 1):
            key = tuple(w[p: p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p: p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def lines(docs, least=10):
    holders = defaultdict(set)
    split = [(i, (t or "").split("\n")) for i, t in docs]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(_UPPER)
    for i, rows in split:
        for line in rows:
            holders[key(line)].add(i)
    out = []
    for i, rows in split:
        kept = [x for x in rows if len(key(x)) < least or len(holders[key(x)]) < 2 or i == min(holders[key(x)])]
        out.append((i, len(rows), len(rows) - len(kept), sha("\n".join(kept))))
    return out


_PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def _luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - (9 if d > 4 else 0)
    return total % 10 == 0


def pii(text):
    """Base spans (start, kind number, end) of a text."""
    out = []
    for k, (kind, pattern) in enumerate(_PII):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                  "card": 14 <= len(digits) <= 19 and _luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(words(line))
        seen.add(line)
    grams = Counter(tuple(w[p: p + 5]) for p in range(len(w) - 4))
    covered = set()
    for p in range(len(w) - 4):
        if grams[tuple(w[p: p + 5])] > 1:
            covered.update(range(p, p + 5))
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def crc(text):
    return zlib.crc32((text or "").encode())


def hilbert_neighbours(n_axes, bits, index):
    """Whether ``index`` (cell -> position) is a Hilbert curve: a bijection whose steps move one axis by one."""
    cells = sorted(index, key=index.get)
    steps = [sum(abs(a - b) for a, b in zip(x, y)) for x, y in zip(cells, cells[1:])]
    return sorted(index.values()) == list(range(2 ** (bits * n_axes))) and set(steps) == {1}
