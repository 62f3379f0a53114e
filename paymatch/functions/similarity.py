"""Sequence ratio of two strings, batched through Arrow.  Spark pairs the strings; Python only scores them."""

from __future__ import annotations

import sys
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ship the helpers with the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SEEN: dict = {}
_SEEN_LIMIT = 1 << 18


def ratio(a: str, b: str) -> float:
    """Argument order matters: the matching blocks are searched along the first string."""
    key = (a, b)
    r = _SEEN.get(key)
    if r is None:
        if len(_SEEN) >= _SEEN_LIMIT:
            _SEEN.clear()
        r = _SEEN[key] = SequenceMatcher(None, a, b).ratio()
    return r


#: From this length of the second text on, SequenceMatcher leaves out its frequent characters; it is left the long texts of either side.
_LONG = 200
_CHUNK = 4096
#: Pairs of documents whose lines are assigned together.
_PAIRS = 512


def _codes(texts: list[str], sizes: np.ndarray) -> np.ndarray:
    """One column of character codes a text."""
    width = int(sizes.max())
    return np.frombuffer("".join([t.ljust(width) for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), width).T


def _cut(codes: np.ndarray, columns: np.ndarray, start: np.ndarray, stop: np.ndarray, blank: int) -> np.ndarray:
    """Of some columns the codes from start to stop, filled up with `blank`."""
    rows = np.arange(int((stop - start).max()))[:, None] + start
    return np.where(rows < stop, codes[np.minimum(rows, len(codes) - 1), columns], codes.dtype.type(blank))


def _longest_blocks(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per column the size of the longest block of codes in both, and where it ends in either: the first one in `a`, then in `b`."""
    n = a.shape[1]
    run, best, end = np.zeros((len(b) + 1, n), np.uint8), np.zeros(n, np.uint16), np.zeros(n, np.int64)
    early = (255 - np.arange(len(b), dtype=np.uint16))[:, None]
    for i, row in enumerate(a):
        # the run that ends here is one longer than the one that ended a character before in both texts
        grown = run[:-1] + np.uint8(1)
        grown *= b == row
        run[1:] = grown
        most = (grown * np.uint16(256) + early).max(axis=0)
        longer = (most >> 8) > (best >> 8)
        best[longer], end[longer] = most[longer], i
    return (best >> 8).astype(np.int64), end, 255 - (best & 255).astype(np.int64)


def matched_characters(left: list[str], right: list[str]) -> np.ndarray:
    """How many characters SequenceMatcher matches in each pair of texts, none empty and all under `_LONG` characters.

    It takes the longest block, then the same left and right of it; here all pairs go on together, level by level, as table rows.
    """
    sizes, n = [np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right)], len(left)
    a, b = (_codes(x, size) for x, size in zip((left, right), sizes))
    blanks = (254, 255) if max(a.max(), b.max()) < 254 else (0x110000, 0x110001)
    a, b = (x.astype(np.uint8 if blanks[0] == 254 else np.uint32) for x in (a, b))
    total, zero = np.zeros(n, np.int64), np.zeros(n, np.int64)
    todo = np.stack([np.arange(n), zero, sizes[0], zero, sizes[1]])
    while todo.shape[1]:
        todo = todo[:, np.argsort(todo[4] - todo[3], kind="stable")]
        rest = []
        for k in range(0, todo.shape[1], _CHUNK):
            owner, a0, a1, b0, b1 = todo[:, k:k + _CHUNK]
            size, ae, be = _longest_blocks(_cut(a, owner, a0, a1, blanks[0]), _cut(b, owner, b0, b1, blanks[1]))
            total += np.bincount(owner, size, n).astype(np.int64)
            sides = np.concatenate([np.stack([owner, a0, a0 + ae + 1 - size, b0, b0 + be + 1 - size]), np.stack([owner, a0 + ae + 1, a1, b0 + be + 1, b1])], axis=1)
            rest.append(sides[:, np.concatenate([size, size]) * (sides[2] > sides[1]) * (sides[4] > sides[3]) > 0])
        todo = np.concatenate(rest, axis=1)
    return total


def ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """`ratio` of many pairs."""
    found = {p: 2.0 if p[0] == p[1] else 0.0 for p in pairs}  # replaced below where neither text is empty
    both = [p for p in found if p[0] and p[1]]
    short = sorted((p for p in both if max(map(len, p)) < _LONG), key=lambda p: len(p[0]))
    for k in range(0, len(short), _CHUNK):
        part = short[k:k + _CHUNK]
        found.update(zip(part, (2.0 * matched_characters([x for x, _ in part], [y for _, y in part])).tolist()))
    for p in both:
        if max(map(len, p)) >= _LONG:
            found[p] = 2.0 * sum(m.size for m in SequenceMatcher(None, *p).get_matching_blocks())
    return [found[p] / (len(p[0]) + len(p[1]) or 2) for p in pairs]


def remember(pairs: list[tuple[str, str]]) -> None:
    """Work out the ratios of many pairs at once, for `ratio` to find them."""
    new = [p for p in dict.fromkeys(pairs) if p not in _SEEN]
    if len(_SEEN) + len(new) > _SEEN_LIMIT:
        _SEEN.clear()
    _SEEN.update(zip(new, ratios(new)))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ratios([*zip(a, b)]), dtype="float64")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def ratio_matrix(left: pd.Series, right: pd.Series) -> pd.Series:
    """Row-major ratios of every left text against every right text of one (invoice, order) pair."""
    found = iter(ratios([(x, y) for xs, ys in zip(left, right) for x in xs for y in ys]))
    return pd.Series([[next(found) for _ in range(len(xs) * len(ys))] for xs, ys in zip(left, right)], dtype=object)


@lru_cache(maxsize=1 << 14)
def _counts(text: str) -> np.ndarray:
    """How often each character occurs, characters folded to 64 bins."""
    return np.bincount(np.frombuffer(text.encode("utf-32-le"), np.uint32) & 63, minlength=64).astype(np.int16)


@lru_cache(maxsize=1 << 14)
def _places(text: str) -> dict[str, int]:
    """For each character the bit set of its places."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by the bit-parallel rule over the places of `b`."""
    places, row, full = _places(b), (1 << len(b)) - 1, (1 << len(b)) - 1
    for c in a:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


@lru_cache(maxsize=1 << 14)
def _words(text: str) -> frozenset[str]:
    return frozenset(text.split(" ")) - {""}


def _overlap(a: str, b: str) -> float:
    x, y = _words(a), _words(b)
    common = len(x & y)
    return common / (len(x) + len(y) - common) if x and y else 0.0


def _nearness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smaller over larger number where the right one is positive, else 0; a missing left number counts as equal."""
    usable = right > 0
    y = np.where(usable, right, 1.0)
    x = np.where(np.isnan(left), y, left)
    return np.where(usable, np.minimum(x, y) / np.maximum(x, y), 0.0)


def best_lines(left, left_texts, left_quantity, left_price, right, right_texts, right_skus, right_quantity, right_price, least: float) -> list[list[float]]:
    """Greedy assignment of the lines of one pair: for each left line the place of its best free right line (-1: none) and the score.

    Lines have a key, an upper-case text, a quantity and a price.  The score is (.4 where the text holds the sku + similarity * .35
    + nearness of quantities * .15 + of prices * .10), similarity half token overlap, half sequence ratio of the keys, 0 where a
    text is blank; the first right line wins ties, and a line under `least` leaves its best one free.  Ratios are
    bounded first: by common characters, then by the longest common subsequence, since the matching blocks are one.  The
    exact ratio is worked out only where a bound reaches the best exact score.  Every step of the score grows with the ratio in
    floating point too, so bounds hold to the last bit.
    """
    return _assigned(left, right, _bounded(left, left_texts, left_quantity, left_price, right, right_texts, right_skus, right_quantity, right_price), least)


def _bounded(*row) -> tuple[np.ndarray, ...] | None:
    return _tables(*[[x] for x in row])[0]


def _tables(left, left_texts, left_quantity, left_price, right, right_texts, right_skus, right_quantity, right_price) -> list[tuple[np.ndarray, ...] | None]:
    """For each pair the parts of the scores of all its lines but the ratios, and the most each score can be; the pairs' tables are
    worked out as one row of cells."""
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right))
    cells = n * m
    ends = np.cumsum(cells)
    if not cells.sum():
        return [None] * len(cells)
    pair = np.repeat(np.arange(len(cells)), cells)
    place = np.arange(len(pair)) - (ends - cells)[pair]
    i, j = (np.cumsum(n) - n)[pair] + place // m[pair], (np.cumsum(m) - m)[pair] + place % m[pair]
    each = lambda f, x, y: np.array([f(a, b) for xs, ys in zip(x, y) for a in xs for b in ys])
    flat = lambda x: np.concatenate([np.asarray(v, np.float64) for v in x])
    lines = lambda x, f: [f(v) for vs in x for v in vs]
    sku = each(lambda t, s: 0.4 if s and t and s in t else 0.0, left_texts, right_skus)
    blank = each(lambda t, s: not (s and t), left_texts, right_texts)
    overlap = each(_overlap, left, right)
    quantity, price = (_nearness(flat(x)[i], flat(y)[j]) for x, y in ((left_quantity, right_quantity), (left_price, right_price)))
    sizes = np.array(lines(left, len))[i] + np.array(lines(right, len))[j]
    same = np.minimum(np.stack(lines(left, _counts))[i], np.stack(lines(right, _counts))[j]).sum(axis=1, dtype=np.int64)
    bounds = np.where(sizes > 0, 2.0 * same / np.maximum(sizes, 1), 1.0)
    most = sku + np.where(blank, 0.0, overlap * 0.5 + bounds * 0.5) * 0.35
    most = most + quantity * 0.15
    most = most + price * 0.10
    parts = (sku, blank, overlap, quantity, price, sizes, most)
    return [tuple(x[e - c:e].reshape(-1, w) for x in parts) if c else None for e, c, w in zip(ends.tolist(), cells.tolist(), m.tolist())]


def _likely(left, right, table: tuple[np.ndarray, ...] | None) -> list[tuple[str, str]]:
    """The keys of each line and the one it can be most similar to, whose ratio the assignment asks for first."""
    if table is None:
        return []
    blank, most = table[1], table[-1]
    return [(left[i], right[j]) for i, j in enumerate(most.argmax(axis=1).tolist()) if not blank[i, j] and left[i] != right[j]]


def _assigned(left, right, table: tuple[np.ndarray, ...] | None, least: float) -> list[list[float]]:
    n, m = len(left), len(right)
    if table is None:
        return [[-1.0, 0.0]] * n
    sku, blank, overlap, quantity, price, sizes, most = table

    def score(i: int, j: int, r: float) -> float:
        s = sku[i, j] + (0.0 if blank[i, j] else overlap[i, j] * 0.5 + r * 0.5) * 0.35
        return s + quantity[i, j] * 0.15 + price[i, j] * 0.10

    free, out = np.ones(m, bool), []
    for i in range(n):
        best, at = -1.0, -1
        row = most[i]
        for j in np.argsort(-row, kind="stable").tolist():
            if not free[j]:
                continue
            if row[j] < best:
                break
            if row[j] == best and j > at:
                continue
            if blank[i, j]:
                s = score(i, j, 0.0)
            elif left[i] == right[j]:
                s = score(i, j, 1.0)
            else:
                if at >= 0:
                    s = score(i, j, 2.0 * common_subsequence(left[i], right[j]) / sizes[i, j])
                    if s < best or (s == best and j > at):
                        continue
                s = score(i, j, ratio(left[i], right[j]))
            if s > best or (s == best and j < at):
                best, at = s, j
        if at >= 0 and best >= least:
            free[at] = False
        out.append([float(at), float(max(best, 0.0))])
    return out


def line_assigner(least: float):
    """Arrow function that gives `best_lines` of each pair."""
    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def assign(left: pd.Series, left_texts: pd.Series, left_quantity: pd.Series, left_price: pd.Series, right: pd.Series, right_texts: pd.Series,
               right_skus: pd.Series, right_quantity: pd.Series, right_price: pd.Series) -> pd.Series:
        rows = (left, left_texts, left_quantity, left_price, right, right_texts, right_skus, right_quantity, right_price)
        out = []
        for k in range(0, len(left), _PAIRS):
            part = [x.iloc[k:k + _PAIRS].tolist() for x in rows]
            tables = _tables(*part)
            remember([p for x, y, table in zip(part[0], part[4], tables) for p in _likely(x, y, table)])
            out += [_assigned(x, y, table, least) for x, y, table in zip(part[0], part[4], tables)]
        return pd.Series(out, dtype=object)

    return assign
