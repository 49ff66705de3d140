"""Whole batches of texts as flat numpy arrays: folded letters, words, lines, hashes.

Nothing here touches Spark. A batch is one array of code points with offsets, so that every step is a
vector operation over all texts of an Arrow batch. Hashes are 64 bit, fixed across machines and runs.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

U = np.uint64
P1, P2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(1)
def alnum() -> np.ndarray:
    """For each code point, whether it is a letter or a digit in the Unicode sense."""
    return np.fromiter((chr(i).isalnum() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the offsets of each (one more than texts)."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return data, offsets


def lowered(texts: list[str | None]) -> list[str]:
    return ["" if t is None else t.lower() for t in texts]


@lru_cache(2)
def _powers(n: int, p: int) -> np.ndarray:
    out = np.full(n, U(p))
    out[0] = U(1)
    return np.multiply.accumulate(out)


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of code points: a polynomial over the ring of 64-bit integers, from
    prefix sums, with the length folded in. Empty spans hash to a fixed value."""
    if not len(starts):
        return np.empty(0, U)
    n = 1 << max(10, (len(cp) + 1).bit_length())
    v = mix(cp.astype(U) + P1)
    prefix = np.zeros(len(cp) + 1, U)
    np.cumsum(v * _powers(n, int(P1))[: len(cp)], out=prefix[1:])
    inverse = _powers(n, pow(int(P1), -1, 1 << 64))
    h = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix(h ^ ((ends - starts).astype(U) * P2))


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the maximal runs of letters and digits of the lower-cased texts, and how many lie
    before each text (one more than texts)."""
    low = lowered(texts)
    cp, off = points(low)
    ok = np.zeros(len(cp) + 2, bool)
    ok[1:-1] = alnum()[cp]
    edge = ok[1:] != ok[:-1]
    breaks = off[1:-1]
    both = breaks[(breaks > 0) & (breaks < len(cp))]
    both = both[ok[both] & ok[both + 1]]  # a run that would go on into the next text ends there
    starts = np.flatnonzero(edge & ok[1:])
    ends = np.flatnonzero(edge & ok[:-1])
    if len(both):
        both = np.unique(both)
        starts, ends = np.sort(np.concatenate([starts, both])), np.sort(np.concatenate([ends, both]))
    return span_hashes(cp, starts, ends), np.searchsorted(starts, off)


def shingles(texts: list[str | None], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the runs of ``k`` consecutive words of each text, and their offsets."""
    w, off = words(texts)
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, U), np.zeros(len(texts) + 1, np.int64)
    h = np.zeros(n, U)
    for i in range(k):
        h = mix(h * P1 + w[i : i + n])
    doc = np.searchsorted(off, np.arange(n), side="right") - 1
    inside = np.arange(n) + k <= off[doc + 1]
    h, doc = h[inside], doc[inside]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[first], doc[first]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def lines(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every line of every text that has letters or digits, folded to these in lower case.

    Returns (folded code points of all texts, text of each line, number of the line, bounds): line i
    is ``points[bounds[i]:bounds[i + 1]]``.
    """
    low = lowered(texts)
    cp, off = points(low)
    keep = alnum()[cp]
    newline = cp == 10
    doc = np.repeat(np.arange(len(texts)), np.diff(off))
    upto = np.cumsum(newline)
    before = np.concatenate([[0], upto])[off[:-1]]
    kept = np.flatnonzero(keep)
    kdoc = doc[kept]
    kline = upto[kept] - before[kdoc]
    folded = cp[kept]
    if not len(folded):
        return folded, kdoc, kline, np.zeros(1, np.int64)
    new = np.ones(len(folded), bool)
    new[1:] = (kdoc[1:] != kdoc[:-1]) | (kline[1:] != kline[:-1])
    at = np.flatnonzero(new)
    return folded, kdoc[at], kline[at], np.append(at, len(folded))


def window_hashes(cp: np.ndarray, width: int = 16) -> np.ndarray:
    """Rolling hash at each position over the last ``width`` code points (fewer at the start)."""
    v = mix(cp.astype(U) + P2)
    h = v.copy()
    for i in range(1, min(width, len(cp))):
        h[i:] += v[:-i] << U(i)
    return mix(h)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
