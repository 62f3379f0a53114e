"""Words of a text as bytes, and 64-bit hashes of word n-grams computed with numpy inside a task.

Both word rules work on UTF-8 bytes: every separator is ASCII, so no character is ever cut.
"""

from __future__ import annotations

import numpy as np

_M = np.uint64
_BLOCK = 1 << 16  # words hashed at a time, so that memory stays bounded for any length of text
_BASE = 0x9E3779B97F4A7C55

#: Letters A-Z become a-z, digits and bytes beyond ASCII stay, everything else separates.
_ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def space_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`; with `lower`, A-Z as a-z.  Null has none."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def alnum_words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z as a-z.  Null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_ALNUM).split()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finisher that spreads every bit of a 64-bit value."""
    x = x ^ (x >> _M(30))
    x = x * _M(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _M(27))
    x = x * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _M(0x9E3779B97F4A7C15))
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POW[i] = np.multiply.accumulate(p)
    return _POW[0][:n], _POW[1]


def gram_hashes(words: list[bytes], k: int) -> np.ndarray:
    """One hash for each run of k words, in order; depends on nothing but those words."""
    n = len(words)
    if n < k:
        return np.empty(0, np.uint64)
    parts = []
    for at in range(0, n - k + 1, _BLOCK):
        some = words[at:at + _BLOCK + k - 1]
        buf = np.frombuffer(b" ".join(some), np.uint8)
        ends = np.append(np.flatnonzero(buf == 32), len(buf))  # a word holds no space
        up, down = _powers(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * up[:len(buf)], out=sums[1:])
        first = np.concatenate(([0], ends[:len(some) - k] + 1))
        parts.append(mix((sums[ends[k - 1:]] - sums[first]) * down[first]))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each window of w hashes, the position of its leftmost smallest hash (with repeats, not decreasing)."""
    if len(hashes) < w:
        return np.empty(0, np.int64)
    value, place, size = hashes, np.arange(len(hashes)), 1
    while size < w:  # windows of twice the size from two that overlap or touch
        step = min(size, w - size)
        right = value[step:] < value[:-step]
        place = np.where(right, place[step:], place[:-step])
        value = np.minimum(value[step:], value[:-step])
        size += step
    return place


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.astype(np.uint64).view(np.int64)
