"""Word shingles of whole texts as 64-bit hashes, a block of documents at a time."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit hangs on every input bit."""
    h = (h ^ (h >> np.uint64(32))) * _B
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(32))


_powers = np.cumprod(np.full(1 << 12, _A, dtype=np.uint64), dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if n > _powers.size:
        _powers = np.cumprod(np.full(1 << int(n).bit_length(), _A, dtype=np.uint64), dtype=np.uint64)
    return _powers


_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and each text's number of words.

    A word is a run of bytes other than blank and tab .. return; A-Z count as a-z.
    """
    joined = b" " + b" ".join(texts).lower() + b" "
    code = np.frombuffer(joined, np.uint8)
    blank = _IS_BLANK[code]
    edge = np.flatnonzero(blank)
    begin, end = edge[:-1] + 1, edge[1:]
    keep = end > begin
    begin, end = begin[keep], end[keep]
    bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(begin, bounds))
    if not begin.size:
        return np.zeros(0, np.uint64), counts
    size = end - begin
    table = _power_table(int(size.max()) + 1)
    place = np.arange(code.size, dtype=np.int32) - np.repeat(np.r_[0, begin], np.diff(np.r_[0, begin, code.size])).astype(np.int32)
    np.minimum(place, table.size - 1, out=place)
    value = (code.astype(np.uint64) + _ONE) * table[place]
    value[blank] = 0
    return mix(np.add.reduceat(value, begin) + size.astype(np.uint64)), counts


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Of each text the distinct hashes, sorted, of its runs of ``words`` words (of all its words where it has fewer)."""
    h, counts = word_hashes(texts)
    if h.size >= words:
        n = h.size - words + 1
        s = np.zeros(n, np.uint64)
        for k in range(words):
            s = s * _A + h[k : k + n]
        s = mix(s)
    else:
        s = np.zeros(0, np.uint64)
    out, at = [], 0
    for c in counts.tolist():
        if c >= words:
            out.append(np.unique(s[at : at + c - words + 1]))
        elif c:
            whole = np.uint64(c)
            for x in h[at : at + c]:
                with np.errstate(over="ignore"):
                    whole = whole * _B + x
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out
