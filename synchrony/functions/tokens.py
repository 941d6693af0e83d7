"""Scalar text functions: normalised words, token sets, similarities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_word(w: Column) -> Column:
    return F.regexp_replace(F.lower(w), "[^a-z0-9]", "")


def token_set(text: Column, least: int = 3) -> Column:
    """Distinct normalised words of at least so many characters, sorted; null and 'nan' give the empty set. A text is
    lowered once and its pattern tried on distinct words only."""
    words = F.transform(F.array_distinct(F.split(F.trim(F.lower(text)), r"\s+")), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    return F.when(text.isNull() | (F.lower(text) == "nan"), F.array().cast("array<string>")).otherwise(F.sort_array(F.array_distinct(F.filter(words, lambda w: F.length(w) >= least))))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def jaccard_distance(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) == 0, 0.0).otherwise(1 - jaccard(a, b))


def indel_ratio(a: Column, b: Column) -> Column:
    """2 LCS / (len a + len b), by a row-wise dynamic programme over arrays; 1 if both are empty."""

    def row(prev: Column, x: Column) -> Column:
        start = F.array(F.lit(0))

        def cell(acc: Column, j: Column) -> Column:
            diagonal = F.element_at(prev, j)
            best = F.when(F.substring(b, j, 1) == x, diagonal + 1).otherwise(F.greatest(F.element_at(prev, j + 1), F.element_at(acc, -1)))
            return F.concat(acc, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), start, cell)

    first = F.array_repeat(F.lit(0), F.length(b) + 1)
    lcs = F.element_at(F.aggregate(F.split(a, ""), first, row), -1)
    empty = (F.length(a) == 0) | (F.length(b) == 0)
    return F.when((F.length(a) == 0) & (F.length(b) == 0), 1.0).when(empty, 0.0).otherwise(2 * lcs / (F.length(a) + F.length(b)))


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """False only where the characters that either text lacks in the other keep the ratio under the threshold: a bound
    that stays in the JVM and spares most distances."""
    inside = lambda x, y: F.length(x) - F.length(F.call_function("translate", x, y, F.lit("")))
    return 2 * F.least(inside(a, b), inside(b, a)) >= threshold * (F.length(a) + F.length(b)) - 1e-9


def letters(a: Column) -> Column:
    """A bit for each character that is in a text, in a long; characters can share a bit."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)
    return F.aggregate(F.filter(F.split(a, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(bit(c)))


def letters_may_reach(letters_a: Column, length_a: Column, letters_b: Column, length_b: Column, threshold: float) -> Column:
    """A bound under ``may_reach`` from bits and lengths that are worked out once a text: each bit that the other text lacks
    is at least one character that it lacks, so what this drops, ``may_reach`` would drop."""
    inside = lambda n, x, y: n - F.bit_count(x.bitwiseAND(F.bitwise_not(y)))
    return 2 * F.least(inside(length_a, letters_a, letters_b), inside(length_b, letters_b, letters_a)) >= threshold * (length_a + length_b) - 1e-9


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit per character of ``a``."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & masks.get(x, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * _lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)], dtype=float)


def indel_ratio_arrow(a: Column | str, b: Column | str) -> Column:
    """The same ratio on Arrow batches; faster for long tokens. Marked as not deterministic, or a condition on it is pushed
    below it and works it out a second time."""
    return F.pandas_udf(_ratios, "double").asNondeterministic()(a, b)


def set_ratio(a: str, b: str) -> float:
    """Token-set ratio, 0 to 100: the best of three ratios between the shared words and the shared words with either
    rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    pairs = [(one, two)] + ([(both, one), (both, two)] if both else [])
    return max(100 * ratio(p, q) for p, q in pairs)


def _set_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a.fillna("").str.lower(), b.fillna("").str.lower()):
        out.append(100.0 if x and y and (x in y or y in x) else set_ratio(x, y))
    return pd.Series(out, dtype=float)


def token_set_ratio(a: Column | str, b: Column | str) -> Column:
    """Token-set ratio, 0 to 100; a text that is part of the other counts as 100."""
    return F.pandas_udf(_set_ratios, "double")(a, b)
