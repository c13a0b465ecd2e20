"""Plain Python versions of the operators, quadratic where that is simplest."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def reachable(ids: list, links: set[tuple]) -> dict:
    """The smallest id reachable from each id."""
    label = {i: i for i in ids}
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            return label


def fingerprint(text: str | None, shingle: int) -> int:
    words = WORDS(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(rows: list[tuple], shingle: int = 4, max_bits: int = 4) -> dict:
    prints = [(i, fingerprint(t, shingle)) for i, t in rows if i is not None]
    links = {(a, b) for a, x in prints for b, y in prints if a < b and (x ^ y).bit_count() <= max_bits}
    return reachable([i for i, _ in prints], links)


def repeated_words(rows: list[tuple], window: int) -> list[tuple]:
    split = [(i, WORDS(t or "")) for i, t in rows]
    seen = Counter(tuple(w[a : a + window]) for _, w in split for a in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = {p for a in range(len(w) - window + 1) if seen[tuple(w[a : a + window])] > 1 for p in range(a, a + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return out


def earlier_bytes(rows: list[tuple], length: int) -> list[tuple]:
    """A null id is neither smaller nor larger than any."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    first: dict[bytes, int] = {}
    for i, b in raw:
        for a in range(len(b) - length + 1 if i is not None else 0):
            s = b[a : a + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for a in range(len(b) - length + 1 if i is not None else 0):
            if first[b[a : a + length]] < i:
                gone[a : a + length] = True
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(x for p, x in enumerate(b) if not gone[p])
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def cosine_links(rows: list[tuple], threshold: float) -> list[tuple]:
    """``id, links, component`` of each row; a vector that is no use links with nothing."""
    good = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    dims = max((len(v) for _, v in rows if good(v)), default=0)
    unit = [np.pad(np.array(v, float), (0, dims - len(v))) if good(v) and i is not None else None for i, v in rows]
    n, links = [0] * len(rows), set()
    for a, x in enumerate(unit):
        for b, y in enumerate(unit):
            if a < b and x is not None and y is not None and float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))) >= threshold:
                n[a], n[b] = n[a] + 1, n[b] + 1
                links.add((rows[a][0], rows[b][0]))
    label = reachable([i for i, _ in rows if i is not None], links)
    return [(i, k, label.get(i)) for (i, _), k in zip(rows, n)]


def best_products(rows: list[tuple], every: int, k: int, scale: int) -> set[tuple]:
    good = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    ints = [(i, np.floor(scale * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and good(v)]
    out = set()
    for q, x in ints:
        if q % every == 0:
            ranked = sorted((-int(x @ y), i) for i, y in ints if i != q)[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(ranked, 1)}
    return out


def bins_of_best_fit(lengths: list[int], capacity: int) -> list[int]:
    """Remaining capacities after best-fit decreasing, item by item over all open bins."""
    left: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [(x, i) for i, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(capacity - n)
    return sorted(left)
