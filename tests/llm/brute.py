"""Plain Python versions of the digests, written from their definitions."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import xxhash

SPACES = " \t\n\r\x0b\x0c"


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACES:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] if word else out


def cover(n, starts, window):
    gone = [False] * n
    for s in starts:
        gone[s : s + window] = [True] * window
    return gone


def repeats(units_by_doc, window):
    """Flags of removed units, document by document."""
    seen = Counter(tuple(u[i : i + window]) if not isinstance(u, bytes) else u[i : i + window] for u in units_by_doc for i in range(len(u) - window + 1))
    out = []
    for u in units_by_doc:
        starts = [i for i in range(len(u) - window + 1) if seen[u[i : i + window] if isinstance(u, bytes) else tuple(u[i : i + window])] > 1]
        out.append(cover(len(u), starts, window))
    return out


def op7(rows, window=400):
    data = [(d, (t or "").encode()) for d, t in rows]
    out = []
    for (d, b), gone in zip(data, repeats([b for _, b in data], window)):
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def op4(rows, window=35):
    data = [(d, words_of(t)) for d, t in rows]
    out = []
    for (d, w), gone in zip(data, repeats([w for _, w in data], window)):
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def longest_paths(rows, window=35):
    """By distinct word sequence: edges of the longest unbranched path of repeated windows that it touches."""
    texts = {tuple(words_of(t)) for _, t in rows}
    grams = {w: [w[i : i + window] for i in range(len(w) - window + 1)] for w in texts}
    seen = Counter(g for own in grams.values() for g in own)
    edges = {g for g, n in seen.items() if n > 1}
    out, into = {}, {}
    for g in edges:
        out.setdefault(g[:-1], []).append(g)
        into.setdefault(g[1:], []).append(g)
    after = {into[n][0]: out[n][0] for n in out if len(out[n]) == 1 and len(into.get(n, ())) == 1 and out[n] != into[n]}
    before = {b: a for a, b in after.items()}
    size = {}
    for g in edges:
        if g not in size:
            path, x = [g], g
            while x in after and after[x] != g:
                x = after[x]
                path.append(x)
            x = g
            while x in before and len(set(path)) == len(path) and before[x] not in path[:1] and before[x] not in path:
                x = before[x]
                path.append(x)
            size |= dict.fromkeys(path, len(path))
    return {w: max((size[g] for g in own if g in edges), default=None) for w, own in grams.items()}


def simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words_of(low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def five_words(text):
    w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_firsts(rows, similarity=0.8):
    """The rows that stay of components of texts with similar sets of five-word shingles."""
    sets = [five_words(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or 5 * both >= 5 * similarity * (len(a) + len(sets[j]) - both) - 1e-9:
                root[find(i)] = find(j)
    least = {}
    for i, (d, t) in enumerate(rows):
        r = find(i)
        if r not in least or (d is None, d or 0) < (least[r][0] is None, least[r][0] or 0):
            least[r] = (d, t)
    return list(least.values())


def op1(rows):
    fps = [simhash(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)]


def corpus(seed=5, n=60):
    """Small texts with exact and near copies, shared passages, long periods and odd cases."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    passage = [" ".join(word() for _ in range(rng.randint(40, 140))) for _ in range(4)]
    rows = []
    for i in range(n):
        text = " ".join(word() for _ in range(rng.randint(0, 200)))
        kind = rng.random()
        if kind < 0.25:
            text = text[: rng.randint(0, 50)] + " " + rng.choice(passage) + "\n" + text
        elif kind < 0.4 and rows:
            text = rng.choice(rows)[1] or ""
        elif kind < 0.55 and rows:
            w = (rng.choice(rows)[1] or "x").split(" ")
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "And " * 300), (n + 4, "One"), (None, passage[0]), (3, rows[3][1]), (5, "same id, other text")]
    return rows
