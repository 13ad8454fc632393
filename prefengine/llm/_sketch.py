"""Order-sensitive min-hash sketches of folded texts, computed for many texts at once with numpy."""

from __future__ import annotations

import numpy as np

_A, _B, _G = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(33)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> _S)) * _A
    h = (h ^ (h >> _S)) * _B
    return h ^ (h >> _S)


def kmer_hashes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every k-mer, its text's number, its place), of all texts one after another."""
    size = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = codes[:n].copy()
    for i in range(1, k):
        h *= _G
        h += codes[i:n + i]
    owner = np.repeat(np.arange(len(texts)), size)[:n]
    place = np.arange(n) - (np.cumsum(size) - size)[owner]
    inside = place <= (size - k)[owner]
    return mix(h[inside]), owner[inside], place[inside]


def order_sketches(texts: list[str], k: int, length: int, sketches: int, bottom: int, ordered: int | None = None) -> np.ndarray:
    """One row of ``sketches`` keys per text (folded, at least ``k + length`` characters each).

    Each k-mer is labelled with its occurrence number, so repeats count.  Of each text the ``bottom`` k-mers of lowest
    hash are kept; every sketch takes the ``length`` of them that are lowest under its own permutation and hashes them
    in the order in which they stand in the text.  Two texts get equal keys with a probability that rises with their
    edit similarity; an equal key needs ``length`` common k-mers in the same order.  Where whole blocks move, that order
    changes though little was edited: only the first ``ordered`` sketches (all by default) keep the text order, the rest
    hash the same choice of k-mers in the order of their hashes.
    """
    out = np.zeros((len(texts), sketches), np.uint64)
    by_size = np.argsort([len(t) for t in texts], kind="stable")
    at = 0
    while at < len(by_size):  # texts of about one length share a matrix
        first = len(texts[by_size[at]])
        end = at
        most = max(1, 2_000_000 // first)  # a matrix holds about so many k-mers at most, or one text
        while end < len(by_size) and end - at < most and len(texts[by_size[end]]) <= max(first * 5 // 4, first + 8):
            end += 1
        some = by_size[at:end]
        out[some] = _sketch_block([texts[i] for i in some], k, length, sketches, bottom, sketches if ordered is None else ordered)
        at = end
    return out


def _sketch_block(texts: list[str], k: int, length: int, sketches: int, bottom: int, ordered: int) -> np.ndarray:
    h, owner, place = kmer_hashes(texts, k)
    width = int(place.max()) + 1
    grid = np.full((len(texts), width), _TOP, np.uint64)
    grid[owner, place] = h
    keep = min(bottom, width)
    if keep < width:  # lowest hashes first; all occurrences of a k-mer stand together
        where = np.argpartition(grid, keep - 1, axis=1)[:, :keep]
        where.sort(axis=1)
        low = np.take_along_axis(grid, where, 1)
    else:
        low = grid
    order = np.argsort(low, axis=1, kind="stable")  # by hash, equal ones in text order
    ranked = np.take_along_axis(low, order, 1)
    same = np.zeros(low.shape, np.uint64)
    for j in np.flatnonzero((ranked[:, 1:] == ranked[:, :-1]).any(axis=0)) + 1:
        equal = ranked[:, j] == ranked[:, j - 1]
        same[equal, j] = same[equal, j - 1] + np.uint64(1)
    labelled = np.empty(low.shape, np.uint64)
    np.put_along_axis(labelled, order, mix(ranked + same * _G), 1)
    gone = low == _TOP
    bits = np.uint64((1 << max(1, int(keep - 1).bit_length())) - 1)
    column = np.arange(keep, dtype=np.uint64)
    keys = np.zeros((len(texts), sketches), np.uint64)
    rows = np.arange(len(texts))
    few = min(length, keep)
    seen = np.empty(low.shape, np.uint64)
    for s in range(sketches):
        # a permutation of already mixed values; its low bits hold the column, which is the order in the text
        np.bitwise_xor(labelled, mix(np.array([s + 1], np.uint64))[0], out=seen)
        seen *= _A
        seen |= bits
        seen[gone] = _TOP
        seen ^= bits ^ column
        seen.partition(few - 1, axis=1) if few < keep else None
        pick = np.sort((seen[:, :few] & bits).astype(np.int64), axis=1)
        chosen = low[rows[:, None], pick]
        if s >= ordered:
            chosen.sort(axis=1)
        key = np.full(len(texts), s + 1, np.uint64)
        for j in range(few):
            key = mix(key * _G + chosen[:, j])
        keys[:, s] = key
    return keys
