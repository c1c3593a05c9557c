"""String similarity from 0 to 100, after folding case and punctuation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def folded(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", " ")))


def edit_ratio(a: Column, b: Column) -> Column:
    """100 * (1 - Levenshtein distance / longer length) of folded texts; 0 if either is empty."""
    return folded_ratio(folded(a), folded(b))


def folded_ratio(a: Column, b: Column) -> Column:
    """``edit_ratio`` of texts that are folded already."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), (1 - F.levenshtein(a, b) / longer) * 100).otherwise(0.0)


def _fold(s: str) -> str:
    return re.sub(r"[\W_]", " ", s).lower().strip()


def _common(a, b) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a, b) -> float:
    """100 * 2 * common subsequence / both lengths."""
    return 200.0 * _common(a, b) / (len(a) + len(b)) if len(a) + len(b) else 0.0


def _partial(a: str, b: str) -> float:
    """The best ratio of the shorter text with a part of the longer one of its length or less."""
    short, long_ = sorted((a, b), key=len)
    n = len(short)
    if not n:
        return 0.0
    return max(indel_ratio(short, long_[max(0, i) : i + n]) for i in range(1 - n, len(long_)))


def _token_ratios(a: str, b: str, ratio) -> float:
    x, y = a.split(), b.split()
    both, only_x, only_y = sorted({*x} & {*y}), sorted({*x} - {*y}), sorted({*y} - {*x})
    by_order = ratio(" ".join(sorted(x)), " ".join(sorted(y)))
    if both and (not only_x or not only_y):
        return 100.0
    shared = " ".join(both)
    left, right = " ".join([*both, *only_x]), " ".join([*both, *only_y])
    pairs = [(left, right), *([(shared, left), (shared, right)] if both else [])]
    return max(by_order, *[ratio(p, q) for p, q in pairs])


def weighted_ratio(a: str | None, b: str | None) -> float:
    """The largest of the plain ratio and, at 95 %, those of sorted and of shared words; where one text is at least 1.5
    times as long as the other, of partial ratios instead, at 90 % (60 % from 8 times on) each."""
    a, b = _fold(a or ""), _fold(b or "")
    if not a or not b:
        return 0.0
    times = max(len(a), len(b)) / min(len(a), len(b))
    plain = indel_ratio(a, b)
    if times < 1.5:
        return max(plain, 0.95 * _token_ratios(a, b, indel_ratio))
    scale = 0.9 if times <= 8 else 0.6
    return max(plain, scale * _partial(a, b), 0.95 * scale * _token_ratios(a, b, _partial))


@F.pandas_udf(T.DoubleType())
def weighted_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_ratio(x, y) for x, y in zip(a, b)], dtype=float)
