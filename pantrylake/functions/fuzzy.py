"""String scorers that Spark lacks, from their published definitions, as Arrow-batched functions.

The longest common subsequence is computed over whole words of bits (Hyyrö's form: a row of the table is one integer),
and a batch scores each distinct pair once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        met = row & places.get(y, 0)
        row = (row + met) | (row - met)
    return len(a) - (row & full).bit_count()


def indel(a: str, b: str) -> float:
    """100 * 2 * LCS / (len(a) + len(b)); two empty strings are alike."""
    return 100.0 * 2 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best of three comparisons over shared words and rests; 100 if one word set contains the other, 0 without words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (not x - y or not y - x):
        return 100.0
    one, two = (" ".join(filter(None, [both, " ".join(sorted(r))])) for r in (x - y, y - x))
    return max(indel(both, one) if both else 0.0, indel(both, two) if both else 0.0, indel(one, two))


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter string with a part of the longer one of at most its length (cut off at the ends)."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    parts = {b[max(0, i) : i + len(a)] for i in range(1 - len(a), len(b))}
    best = max(indel(a, p) for p in parts)
    if len(a) == len(b):
        best = max(best, max(indel(b, a[max(0, i) : i + len(b)]) for i in range(1 - len(b), len(a))))
    return best


def partial_token(a: str, b: str) -> float:
    """Partial ratio of sorted words or of words that only one side has; 100 if any word is shared."""
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return max(partial(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial(" ".join(sorted(x - y)), " ".join(sorted(y - x))))


def weighted(a: str, b: str) -> float:
    """The weighted blend of all ratios: word ratios count 0.95; from one and a half times the length on, partial ratios
    count too, by 0.9, or by 0.6 over eight times."""
    if not a or not b:
        return 0.0
    times = max(len(a), len(b)) / min(len(a), len(b))
    whole = indel(a, b)
    if times < 1.5:
        return max(whole, 0.95 * max(token_sort(a, b), token_set(a, b)))
    scale = 0.9 if times <= 8 else 0.6
    return max(whole, scale * partial(a, b), 0.95 * scale * partial_token(a, b))


def plain(a: str) -> str:
    """Lower case, other characters than letters and digits as blanks, none at the ends."""
    return "".join(c if c.isalnum() else " " for c in a).lower().strip()


def sequence(a: str, b: str) -> float:
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


def scorer(rule):
    """A column function from a rule over two strings; null on either side gives 0."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple, float] = {}
        out = []
        for pair in zip(a, b):
            if pair not in known:
                known[pair] = rule(*pair) if pair[0] is not None and pair[1] is not None else 0.0
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return score
