"""Pieces of SQL for similarity of texts, written apart from the Spark operators that they check."""

from __future__ import annotations


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two columns: a row of the table per character of ``a``."""
    y = f"list_transform(string_split({b}, ''), lambda ch: unicode(ch))"
    cell = f"list_append(acc, CASE WHEN {y}[j[1]] = x[1] THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], acc[-1]) END)"
    row = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda i: [CAST(i AS INT)]), lambda acc, j: {cell}, [0])"
    start = f"list_transform(range(0, length({b}) + 1), lambda i: 0)"
    return f"list_reduce(list_transform(string_split({a}, ''), lambda ch: [unicode(ch)]), lambda prev, x: {row}, {start})[-1]"


def ratio(a: str, b: str) -> str:
    """Indel ratio of two columns; 1 if both are empty."""
    n = f"(length({a}) + length({b}))"
    return f"CASE WHEN {n} = 0 THEN 1e0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0e0 ELSE 2 * {lcs(a, b)} / {n} END"


def may_reach(a: str, b: str, threshold: float) -> str:
    """False only if the characters that both lack in the other keep the ratio under the threshold."""
    common = f"least(length({a}) - length(translate({a}, {b}, '')), length({b}) - length(translate({b}, {a}, '')))"
    return f"2 * {common} >= {threshold}e0 * (length({a}) + length({b}))"


def similar(candidates: str, threshold: float, above: str) -> str:
    """Of a table of candidates (a, b) the distinct pairs with ratio ``above`` (> or >=) the threshold."""
    return f"(SELECT a, b, r FROM (SELECT a, b, CASE WHEN {may_reach('a', 'b', threshold)} THEN {ratio('a', 'b')} ELSE 0e0 END AS r FROM (SELECT DISTINCT a, b FROM {candidates})) WHERE r {above} {threshold}e0)"
