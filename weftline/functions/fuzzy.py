"""String similarity on a scale of 0 to 100, from longest common subsequences."""

from __future__ import annotations

from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distances of the windows that are measured one after the other, those between them only where they can be better.
_STRIDES = (8, 2, 1)


@lru_cache(maxsize=256)
def _places(a: str) -> dict[str, int]:
    """Characters with the bits of their places."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    return where


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    if not a or not b:
        return 0
    if a == b:
        return len(a)
    row = full = (1 << len(a)) - 1
    for m in map(_places(a).get, b, repeat(0)):
        hit = row & m
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; 100 for two empty strings."""
    return 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def _at_edge(short: str, long: str, least: int) -> list[int]:
    """Common subsequence of ``short`` with the first ``least``, ``least`` + 1 ... characters of ``long``, as many as ``short`` has."""
    n, out = len(short), []
    get = _places(short).get
    row = full = (1 << n) - 1
    for m in map(get, long[: least - 1], repeat(0)):
        hit = row & m
        row = (row + hit | row - hit) & full
    for m in map(get, long[least - 1 : n], repeat(0)):
        hit = row & m
        row = (row + hit | row - hit) & full
        out.append(n - row.bit_count())
    return out


def _in_lanes(short: str, long: str, first: int, stride: int, count: int) -> list[int]:
    """Common subsequence of ``short`` with the windows of its length that begin at every ``stride``-th place from ``first`` on.

    Each window has a lane of a long number, wide enough for the shorter
    string and a carry, and a step takes the next character of every window.
    """
    n = len(short)
    width = n // 8 + 1  # bytes of a lane
    none = bytes(width)
    masks = {c: m.to_bytes(width, "little") for c, m in _places(short).items()}
    chars = [int.from_bytes(b"".join([masks.get(c, none) for c in long[first + r : first + stride * (count - 1) + n : stride]]), "little") for r in range(min(stride, n))]
    row = full = int.from_bytes(((1 << n) - 1).to_bytes(width, "little") * count, "little")
    for j in range(n):
        r = j % stride
        hit = row & chars[r]
        row = (row + hit | row - hit) & full
        chars[r] >>= 8 * width
    left = np.bitwise_count(np.frombuffer(row.to_bytes(width * count, "little"), np.uint8)).reshape(count, width).sum(axis=1)
    return (n - left.astype(int)).tolist()


def _best_window(short: str, long: str, common: int, target: int | None = None) -> tuple[int, int]:
    """(common characters, sum of lengths) of the window of ``long`` that is most like ``short``; (0, 1) where none does.

    Windows are as long as the shorter string, or shorter at the edges. With a
    ``target`` only those count whose ratio reaches it, and only whole numbers tell them apart.
    A window one place on has at most one common character more or less, so
    most windows between two that are measured need not be.
    """
    n, total = len(short), len(long)
    best = (0, 1)
    #: a window is better if its common characters times ``den`` are more than ``num`` times the sum of lengths, less ``slack``
    num, den, slack = (0, 1, 0) if target is None else (target, 200, 1)

    def better(found: int, size: int) -> None:
        nonlocal best, num, den
        if found * den > num * size - slack:
            best = (found, size)
            num, den = (found, size) if target is None else (200 * found // size + 1, 200)

    if common * den <= num * (n + common) - slack:  # no window has more in common than the whole strings
        return best
    least = max(1, min(n, (num * n - slack) // max(1, den - num)))
    ends = []
    for a, b in ((short, long), (short[::-1], long[::-1])):
        edge = _at_edge(a, b, least)
        ends.append(edge[-1])
        for s, found in enumerate(edge, n + least):
            if found * den > num * s - slack:
                better(found, s)
    last = total - n
    spans = [[(0, ends[0]), (last, ends[1])]]  # places in order with what they have in common; windows between two may be better
    for stride in _STRIDES if n >= 3 * _STRIDES[0] and last > 2 * _STRIDES[0] else (1,):
        runs: list[list] = []  # bound, and places
        for points in spans:
            run = None
            for (i, x), (j, y) in zip(points, points[1:]):
                bound = min(common, n, (x + y + j - i) // 2)
                if j - i < 2 or bound * den <= num * 2 * n - slack:
                    run = None
                elif run:
                    run[0] = max(run[0], bound)
                    run[1].append((j, y))
                else:
                    runs.append(run := [bound, [(i, x), (j, y)]])
        spans = []
        for bound, known in sorted(runs, key=lambda r: -r[0]):
            if bound * den <= num * 2 * n - slack:
                break
            at = range(known[0][0] + stride, known[-1][0], stride)
            if not at:
                spans.append(known)
                continue
            found = _in_lanes(short, long, at[0], stride, len(at))
            better(max(found), 2 * n)
            spans.append([known[0], *zip(at, found), known[-1]])
    return best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one, windows over its edges included."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    found, size = _best_window(short, long, lcs_length(short, long))
    return 200.0 * found / size


def _sorted_words(words: list[str] | set[str]) -> str:
    return " ".join(sorted(words))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_sorted_words(a.split()), _sorted_words(b.split()))


def token_set_ratio(a: str, b: str, least: int = 0) -> float:
    """The best of the common words against each side, and of both sides; 100 if one side's words are all common.

    Where both sides cannot reach ``least``, the common words against each side are enough.
    """
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = x & y, x - y, y - x
    if both and (not only_a or not only_b):
        return 100.0
    left, right = _sorted_words(only_a), _sorted_words(only_b)
    # common words come first on both sides, so what follows them is compared alone
    same = len(_sorted_words(both)) + 1 if both else 0
    best = 200.0 * (same - 1) / (2 * same - 1 + min(len(left), len(right))) if both else 0.0
    size = 2 * same + len(left) + len(right)
    if 200 * (same + min(len(left), len(right))) >= least * size:
        best = max(best, 200.0 * (same + lcs_length(left, right)) / size)
    return best


def best_score(a: str, b: str, enough: int = 101, floor: int = 0, worth: int = 0) -> int:
    """The largest of the four ratios, each cut to a whole number.

    The others are left out once one is ``enough``, and any that cannot be
    larger. A result below ``floor`` says only that no ratio reaches it; one
    that does, and is below ``worth``, that none reaches that.
    """
    if not a and not b:
        return 100
    common = lcs_length(a, b)
    best = int(200.0 * common / (len(a) + len(b)))

    def least() -> int:
        return max(best + 1, floor if best < floor else worth)

    if best >= enough:
        return best
    x, y = _sorted_words(a.split()), _sorted_words(b.split())
    if 200 * min(len(x), len(y)) >= least() * (len(x) + len(y)) and (x, y) != (a, b):
        best = max(best, int(ratio(x, y)))
        if best >= enough:
            return best
    if (x, y) != (a, b) or " " in a or " " in b:  # of single words it is the ratio
        best = max(best, int(token_set_ratio(a, b, least())))
    if best >= enough or not common:
        return best
    short, long = sorted((a, b), key=len)
    if short in long:
        return 100
    found, size = _best_window(short, long, common, least())
    return max(best, 200 * found // size)


@F.pandas_udf(T.IntegerType())
def best_score_col(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else best_score(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")
