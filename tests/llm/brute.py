"""Plain versions of the corpus operators, one document after the other."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().translate(LOWER))


def shingles(text: str | None) -> Counter:
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    joint = sum((a | b).values())
    return shared / joint if joint else 0.0


def components(nodes: list, links: list[tuple]) -> dict:
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near_duplicates(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    bags = [(d, shingles(t)) for d, t in rows]
    links = [(bags[i][0], bags[j][0]) for i in range(len(bags)) for j in range(i) if similarity(bags[i][1], bags[j][1]) >= 0.8]
    return components([d for d, _ in rows], links)


def repeated_bytes(texts: list[str | None], length: int) -> list[list[bool]]:
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def repeated_digest(text: str | None, gone: list[bool]) -> tuple[int, int, int, str]:
    raw = (text or "").encode()
    runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
    return len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()


def contamination(docs: list[str | None], items: list[tuple[str, str | None]], n: int = 10) -> list[tuple[int, int, list[str]]]:
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1) if size else ():
            windows[tuple(w[i : i + size])].add(item)
    out = []
    for text in docs:
        w = words(text)
        hit, found = [False] * len(w), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit[i : i + size] = [True] * size
                    found |= windows[tuple(w[i : i + size])]
        out.append((len(w), sum(hit), sorted(found)))
    return out


def cosine_links(rows: list[tuple], threshold: float) -> dict:
    """(id, vector, label): {id: (links, component)}; ids differ."""
    import math

    def good(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = []
    count = Counter()
    for i, (a, v, x) in enumerate(rows):
        for b, w, y in rows[:i]:
            if good(v, x) and good(w, y) and x == y and len(v) == len(w):
                c = math.fsum(p * q for p, q in zip(v, w, strict=True)) / math.sqrt(math.fsum(p * p for p in v)) / math.sqrt(math.fsum(q * q for q in w))
                if c >= threshold:
                    links.append((a, b))
                    count[a] += 1
                    count[b] += 1
    root = components([r[0] for r in rows], links)
    return {r[0]: (count[r[0]], root[r[0]]) for r in rows}
