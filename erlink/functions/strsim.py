"""String scorers on Python's long integers, run in one Arrow UDF that returns all of them.

``ratio`` is 200 * LCS / (len + len); the LCS length comes from the bit-parallel
recurrence, one long-integer step per character.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    mask = (1 << len(a)) - 1
    row = mask
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & mask
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer, windows cut off at the ends included."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 100.0
    n, best = len(short), 0.0
    for start in range(1 - n, len(long)):
        window = long[max(start, 0) : start + n]
        if 200.0 * min(n, len(window)) / (n + len(window)) > best:
            best = max(best, ratio(short, window))
    if len(a) == len(b):
        for start in range(1 - n, n):
            window = short[max(start, 0) : start + n]
            if 200.0 * min(n, len(window)) / (n + len(window)) > best:
                best = max(best, ratio(long, window))
    return best


def _sorted(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_sorted(a), _sorted(b))


def _sets(a: str, b: str) -> tuple[list[str], list[str], list[str]]:
    x, y = set(a.split()), set(b.split())
    return sorted(x & y), sorted(x - y), sorted(y - x)


def token_set_ratio(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, left, right = _sets(a, b)
    if both and (not left or not right):
        return 100.0
    base, one, two = (" ".join(t) for t in (both, both + left, both + right))
    best = ratio(one, two)
    return max(best, ratio(base, one), ratio(base, two)) if both else best


def partial_token_ratio(a: str, b: str) -> float:
    both, left, right = _sets(a, b)
    if both:
        return 100.0
    return max(partial_ratio(_sorted(a), _sorted(b)), partial_ratio(" ".join(left), " ".join(right)))


def wratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    plain = ratio(a, b)
    if spread < 1.5:
        return max(plain, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if spread < 8.0 else 0.6
    return max(plain, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def qratio(a: str, b: str) -> float:
    return ratio(a, b) if a and b else 0.0


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                left.append(ch)
                break
    if not left:
        return 0.0
    right = [ch for ch, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    score = jaro(a, b)
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return score + 0.1 * prefix * (1 - score) if score > 0.7 else score


_SCORERS = {"ratio": ratio, "partial": partial_ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "wratio": wratio, "qratio": qratio, "jaro": jaro_winkler}


@lru_cache(maxsize=100_000)
def all_scores(a: str, b: str) -> tuple[float, ...]:
    return tuple(f(a, b) for f in _SCORERS.values())


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in _SCORERS]))
def string_scores(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([all_scores(x or "", y or "") for x, y in zip(a, b)], columns=list(_SCORERS))


@F.pandas_udf(T.DoubleType())
def ratio_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def token_sort_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_sort_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def jaro_winkler_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x or "", y or "") for x, y in zip(a, b)], dtype="float64")
