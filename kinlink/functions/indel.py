"""String similarity by longest common subsequences (Indel), as Arrow UDFs: Spark has no such function.

ratio is 100 * 2 * LCS / (length + length), 100 for two empty strings. The LCS of one pair is had by the bit-parallel
recurrence of Hyyro (2004) on Python's integers. The token variants are ratios of sorted tokens.

Batches are scored many pairs at once, a lane a pair: LCS by its table's diagonals, best windows by the braid that holds
the LCS of one text with all substrings of the other (Tiskin 2008). Texts of a block are padded by what matches nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package


def lcs(a: str, b: str) -> int:
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    if a == b:
        return 100.0
    return 200.0 * lcs(a, b) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and not (left and right):
        return 100.0
    one, two = f"{common} {left}".strip(), f"{common} {right}".strip()
    best = ratio(one, two)
    return max(best, ratio(common, one), ratio(common, two)) if common else best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string against windows of its length in the longer, and those cut off at its ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, chars, best = len(a), set(a), 0.0
    for k in range(1 - n, len(b)):
        lo, hi = max(0, k), min(len(b), k + n)
        # a window that does not end, or at the far end begin, in a character of a is no better than a shorter one
        if (b[hi - 1] if hi < len(b) or k <= 0 else b[lo]) not in chars:
            continue
        if 200.0 * min(n, hi - lo) / (n + hi - lo) > best:
            best = max(best, ratio(a, b[lo:hi]))
            if best == 100.0:
                break
    if len(b) == n:  # either may be the shorter
        for k in range(1, n):
            best = max(best, ratio(b, a[k:]), ratio(b, a[: n - k]))
    return best


LANES, CELLS = 1024, 1 << 16  # pairs of a block, and at most so many of its characters on one side


class _Texts:
    """Texts as numbers from 2 on, one behind the other; 0 and 1 are what matches nothing on either side."""

    def __init__(self, texts: list[str]):
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if flat.size and flat.max() > 253:
            flat = np.unique(flat, return_inverse=True)[1]
        self.codes = np.append(flat + 2, 0).astype(np.uint8 if not flat.size or flat.max() <= 253 else np.uint32)
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.cumsum(self.size) - self.size

    def grid(self, which: np.ndarray, n: int, pad: int) -> np.ndarray:
        """The first n characters of some texts, a column a text."""
        at = np.arange(n)[:, None]
        found = self.codes[np.minimum(self.begin[which] + at, len(self.codes) - 1)]
        found[at >= self.size[which]] = pad
        return found


def _blocks(n: np.ndarray, m: np.ndarray, step: int) -> Iterator[np.ndarray]:
    """Places of pairs of about the same lengths; n of one block are alike but for less than step."""
    bucket = (n + step - 1) // step
    order = np.lexsort((m, bucket))
    bucket, m = bucket[order], m[order]
    at = 0
    while at < len(order):
        most = max(1, min(LANES, CELLS // max(1, int(bucket[at]) * step)))
        end = min(at + most, int(np.searchsorted(bucket, bucket[at], "right")))
        end = at + int(np.searchsorted(m[at:end], 2 * m[at] + 16, "right"))
        yield order[at:end]
        at = end


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """LCS of the columns of two grids, of which a has at most 255 rows."""
    n, m, lanes = len(a), len(b), a.shape[1]
    b = b[::-1].copy()
    last, before, now = (np.zeros((n + 1, lanes), np.uint8) for _ in range(3))
    equal = np.empty((n, lanes), np.bool_)
    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1), min(n, d + 1)
        same, cell = equal[: hi - lo], now[lo + 1 : hi + 1]
        np.equal(a[lo:hi], b[m - 1 - d + lo : m - 1 - d + hi], out=same)
        np.add(before[lo:hi], same.view(np.uint8), out=cell)
        np.maximum(cell, last[lo:hi], out=cell)
        np.maximum(cell, last[lo + 1 : hi + 1], out=cell)
        last, before, now = now, last, before
    return last[n]


def _lengths(texts: _Texts, ia: np.ndarray, ib: np.ndarray, hide=None) -> np.ndarray:
    """LCS of pairs of texts. hide: takes a block's places and grids and puts 0 or 1 for characters that are left out."""
    swap = texts.size[ia] > texts.size[ib]
    short, long = np.where(swap, ib, ia), np.where(swap, ia, ib)
    n, m = texts.size[short], texts.size[long]
    out = np.zeros(len(ia), np.int64)
    for block in _blocks(n, m, 4):
        most = int(n[block].max())
        if not most:
            continue
        a, b = texts.grid(short[block], most, 0), texts.grid(long[block], int(m[block].max()), 1)
        if hide:
            hide(block, swap[block], a, b)
        if most > 255:
            out[block] = [lcs("".join(map(chr, x)), "".join(map(chr, y))) for x, y in zip(a.T.tolist(), b.T.tolist())]
        else:
            out[block] = _common(a, b)
    return out


def _ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the strands that leave at the foot of the braid of each two columns have begun: at the left side's foot 0, at the first column len(a)."""
    n, m, lanes = len(a), len(b), a.shape[1]
    kind = np.uint8 if n + m <= 255 else np.uint16 if n + m <= 65535 else np.uint32
    b = b[::-1].copy()
    h = np.repeat(np.arange(n - 1, -1, -1, dtype=kind)[:, None], lanes, 1)
    v = np.repeat(np.arange(n + m - 1, n - 1, -1, dtype=kind)[:, None], lanes, 1)
    differ, over, down = np.empty((n, lanes), np.bool_), np.empty((n, lanes), kind), np.empty((n, lanes), kind)
    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1), min(n, d + 1)
        rows, columns = slice(lo, hi), slice(m - 1 - d + lo, m - 1 - d + hi)
        left, top, x, y, z = h[rows], v[columns], over[: hi - lo], down[: hi - lo], differ[: hi - lo]
        np.not_equal(a[rows], b[columns], out=z)
        np.maximum(left, top, out=x)
        np.subtract(x, left, out=x)
        np.multiply(x, z.view(np.uint8), out=x)  # strands cross once, and never where characters are equal
        np.add(left, x, out=y)
        np.subtract(top, x, out=left)
        top[:] = y
    return v[::-1]


def _best_windows(texts: _Texts, short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """The best ratio of each shorter text against the windows of the longer; none is empty."""
    n, m = texts.size[short], texts.size[long]
    out = np.zeros(len(short))
    for block in _blocks(n, m, 1):
        size, most, own = int(n[block[0]]), int(m[block].max()), m[block]
        ends = _ends(texts.grid(short[block], size, 0), texts.grid(long[block], most, 1))
        free = np.cumsum(ends[: size - 1] < size, axis=0, dtype=ends.dtype)  # windows cut off at the left; the longer text has at least size characters
        best = (200.0 * free / (size + np.arange(1, size))[:, None]).max(axis=0, initial=0.0)
        found = np.array([np.add.reduce((ends[lo : lo + size] < size + lo).view(np.uint8), axis=0, dtype=ends.dtype) for lo in range(most)])
        inner = int(own[0]) - size + 1  # own rises, so these windows are whole in all pairs
        full, cut = found[:inner].max(axis=0), found[inner:]
        inside = own - np.arange(inner, most)[:, None]
        best = np.maximum(best, np.where(inside > 0, 200.0 * cut / (size + np.clip(inside, 1, size)), 0.0).max(axis=0, initial=0.0))
        out[block] = np.maximum(best, 200.0 * full / (2 * size))
    return out


def _partials(texts: _Texts, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    swap = texts.size[ia] > texts.size[ib]
    short, long = np.where(swap, ib, ia), np.where(swap, ia, ib)
    n, m = texts.size[short], texts.size[long]
    out = np.where(m == 0, 100.0, 0.0)
    some, even = np.flatnonzero(n), np.flatnonzero((n > 0) & (n == m))  # of one length, either may be the shorter
    out[some] = _best_windows(texts, short[some], long[some])
    out[even] = np.maximum(out[even], _best_windows(texts, long[even], short[even]))
    return out


def _ratios(texts: _Texts, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    total = texts.size[ia] + texts.size[ib]
    return np.where(total == 0, 100.0, 200.0 * _lengths(texts, ia, ib) / np.maximum(total, 1))


def _set_ratios(given: list[str], ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """token_set_ratio of pairs of given texts. Both sides' sorted tokens, each behind a space, are compared without the common
    ones; these stand first in both texts of the scorer, so they add their own length to the LCS."""
    parts = [sorted(set(t.split())) for t in given]
    count = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = list(chain.from_iterable(parts))
    whole = [" ".join(("", *p)) for p in parts]
    texts = _Texts(whole)
    known = pa.array(flat, pa.string()).dictionary_encode().indices.to_numpy()
    width = np.fromiter(map(len, flat), np.int64, len(flat)) + 1
    first, of = np.cumsum(count) - count, np.repeat(np.arange(len(parts)), count)
    place = np.arange(len(flat)) - first[of]
    out = np.zeros(len(ia))
    wide = int(count.max(initial=0))
    if wide > 32:  # texts of very many words one by one
        many = np.flatnonzero((count[ia] > 32) | (count[ib] > 32))
        out[many] = [token_set_ratio(given[i], given[j]) for i, j in zip(ia[many].tolist(), ib[many].tolist())]
        rest = np.flatnonzero((count[ia] <= 32) & (count[ib] <= 32))
        wide = 32
    else:
        rest = np.arange(len(ia))
    rest = rest[(count[ia[rest]] > 0) & (count[ib[rest]] > 0)]
    inside = place < wide
    token, long = np.full((len(parts), wide), -1, np.int64), np.zeros((len(parts), wide), np.int64)
    token[of[inside], place[inside]], long[of[inside], place[inside]] = known[inside], width[inside]
    x, y = ia[rest], ib[rest]
    left, right = token[x], token[y]
    both, both_y = np.zeros(left.shape, np.bool_), np.zeros(right.shape, np.bool_)
    for k in range(wide):
        same = (left == right[:, k : k + 1]) & (left >= 0)
        both |= same
        both_y[:, k] = same.any(axis=1)
    common = np.where(both, long[x], 0).sum(axis=1)
    a, b = texts.size[x] - common, texts.size[y] - common
    result = np.where((common > 0) & ((a == 0) | (b == 0)), 100.0, 0.0)
    open_ = np.flatnonzero(result == 0.0)
    number = np.repeat(place, width).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    number = np.append(number, 0)  # which token of its text a character is of

    def hide(block: np.ndarray, swap: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        at = open_[block]
        hit = np.flatnonzero(common[at])
        at, turned = at[hit], swap[hit][:, None]
        sides = (np.where(turned, both_y[at], both[at]), np.where(swap[hit], y[at], x[at]), one, 0), (np.where(turned, both[at], both_y[at]), np.where(swap[hit], x[at], y[at]), two, 1)
        for gone, text, grid, pad in sides:
            if len(at):
                chars = number[np.minimum(texts.begin[text] + np.arange(len(grid))[:, None], len(number) - 1)]
                part = grid[:, hit]
                part[gone[np.arange(len(at)), np.minimum(chars, wide - 1)]] = pad
                grid[:, hit] = part

    found = _lengths(texts, x[open_], y[open_], hide)
    a, b, c = a[open_], b[open_], np.maximum(common[open_] - 1, 0)  # a and b with the space before each token, c without the first
    apart = (common[open_] == 0).astype(np.int64)
    best = 200.0 * (c + found - apart) / (2 * c + a + b - 2 * apart)
    shared = np.maximum(200.0 * c / (2 * c + a), 200.0 * c / (2 * c + b))
    result[open_] = np.where(apart == 1, best, np.maximum(best, shared))
    out[rest] = result
    return out


KINDS = {
    "ratio": lambda texts, ia, ib: _ratios(_Texts(texts), ia, ib),
    "token_sort_ratio": lambda texts, ia, ib: _ratios(_Texts([" ".join(sorted(t.split())) for t in texts]), ia, ib),
    "token_set_ratio": _set_ratios,
    "partial_ratio": lambda texts, ia, ib: _partials(_Texts(texts), ia, ib),
}


def many(name: str, a: pa.Array, b: pa.Array) -> np.ndarray:
    """A scorer on two arrays of texts, nulls being empty; each two different texts are compared once."""
    coded = pa.concat_arrays([a, b]).fill_null("").dictionary_encode()
    texts, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
    pairs, inverse = np.unique(index[: len(a)] * len(texts) + index[len(a) :], return_inverse=True)
    return KINDS[name](texts, *np.divmod(pairs, max(1, len(texts))))[inverse]


def partial_ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """partial_ratio of many pairs."""
    return many("partial_ratio", *(pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1))).tolist()


def _scorer(name: str):
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(many(name, a, b).astype(np.float32), pa.float32())

    return score


def scored(name: str, a: Column, b: Column) -> Column:
    """float32 score of two columns by ratio, token_sort_ratio, token_set_ratio or partial_ratio."""
    return F.arrow_udf(_scorer(name), "float")(a, b)
