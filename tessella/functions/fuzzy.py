"""String similarity that Spark has no functions for."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def matching_ratio(candidate: pd.Series, query: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's ratio 2M/T; it depends on the order of its arguments."""
    matcher, last, out = SequenceMatcher(), None, []
    for c, q in zip(candidate, query):
        if q != last:
            matcher.set_seq2(q)
            last = q
        matcher.set_seq1(c)
        out.append(matcher.ratio())
    return pd.Series(out)


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len(a) + len(b)): the normalised insert-delete similarity."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    state = (1 << len(a)) - 1
    for c in b:
        u = state & masks.get(c, 0)
        state = state + u | state - u
    common = len(a) - (state & (1 << len(a)) - 1).bit_count()
    return 200.0 * common / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string against windows of the longer one."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    windows = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    return max(indel_ratio(short, w) for w in windows)


def _sorted_words(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_ratio(a: str, b: str, compare=indel_ratio) -> float:
    """The best of sorted words, and of common words against each side's words."""
    one, two = set(a.split()), set(b.split())
    common, left, right = (" ".join(sorted(s)) for s in (one & two, one - two, two - one))
    if common and (not left or not right):
        return 100.0
    best = compare(_sorted_words(a), _sorted_words(b))
    if compare is partial_ratio and common:
        return 100.0
    with_left, with_right = f"{common} {left}".strip(), f"{common} {right}".strip()
    pairs = [(with_left, with_right)] + ([(common, with_left), (common, with_right)] if common else [])
    return max([best, *(compare(x, y) for x, y in pairs)])


def weighted_ratio(a: str, b: str) -> float:
    """The publicly documented weighting of full, partial and token ratios."""
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    best = indel_ratio(a, b)
    if spread < 1.5:
        return max(best, 0.95 * token_ratio(a, b))
    scale = 0.9 if spread <= 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * token_ratio(a, b, partial_ratio))


def _bound(a: str, b: str) -> float:
    """No ratio of the strings, whole or partial (at 0.9), is higher, judged by their common characters."""
    if not a or not b:
        return 100.0
    common = sum(min(a.count(c), b.count(c)) for c in set(a))
    # Windows of the longer string may be as short as what is common.
    return max(200.0 * common / (len(a) + len(b)), 0.9 * 200.0 * common / (min(len(a), len(b)) + max(1, common)))


def best_possible(a: str, b: str) -> float:
    """No :func:`weighted_ratio` of the strings is higher: bounds of the strings, their words, and their sets of words."""
    one, two = set(a.split()), set(b.split())
    if one & two:
        return 100.0
    return max(_bound(a, b), _bound(" ".join(a.split()), " ".join(b.split())), _bound(" ".join(sorted(one)), " ".join(sorted(two))))


def link_score(query: Column, choice: Column, least: float) -> Column:
    """The weighted ratio; 0 where it can't reach ``least``."""

    @F.pandas_udf(DoubleType())
    def score(queries: pd.Series, choices: pd.Series) -> pd.Series:
        return pd.Series([weighted_ratio(q, c) if best_possible(q, c) >= least else 0.0 for q, c in zip(queries, choices)], dtype=float)

    return score(query, choice)
