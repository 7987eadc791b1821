"""Word shingles of whole texts as 64-bit hashes, in numpy.

Words are the runs of bytes other than ASCII white space; five of them in a row make a shingle.  A text
of one to four words has one shingle of all its words; a text without words has none.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 2 * BLOCK:
            _powers[name] = have
    return have


def _block_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the words in ``data``; it begins and ends between words."""
    gap = SPACE[data]
    change = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts = change[gap[change - 1]] if len(change) else change
    ends = change[gap[change]] if len(change) else change
    if len(data) and not gap[0]:
        starts = np.concatenate([[0], starts])
    if len(data) and not gap[-1]:
        ends = np.concatenate([ends, [len(data)]])
    if not len(starts):
        return np.empty(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _table("up", BASE, len(data))[: len(data)], out=sums[1:])
    back = _table("down", pow(BASE, -1, 1 << 64), len(data))
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """One hash per word, a block of text at a time (blocks are cut at white space)."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= BLOCK:
        return _block_hashes(data)
    out, at = [], 0
    while at < len(data):
        end, width = min(at + BLOCK, len(data)), BLOCK
        while end < len(data):
            gaps = np.flatnonzero(SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            width *= 2
            end = min(at + width, len(data))
        out.append(_block_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """One hash per shingle position."""
    w = word_hashes(text)
    if not len(w):
        return w
    size = min(words, len(w))
    n = len(w) - size + 1
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = (h * np.uint64(0xD6E8FEB86659FD93)) ^ w[i : i + n]
        h ^= h >> np.uint64(32)
    return mix(h, size)
