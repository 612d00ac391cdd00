"""Fuzzy string similarity, 0 to 100, as Arrow-batched functions over pairs of columns.

ratio is the Indel similarity 100 * 2 * LCS / (len a + len b). partial_ratio is the best ratio of the shorter string
with a window of its length in the longer one. token_set_ratio compares the shared words with either side's words. The
scores follow these definitions; no library was at hand to compare them with.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio_of(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * _common(a, b) / (len(a) + len(b))


@lru_cache(maxsize=100_000)
def partial_ratio_of(a: str, b: str) -> float:
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    return max(ratio_of(a, b[i : i + len(a)]) for i in range(len(b) - len(a) + 1))


@lru_cache(maxsize=100_000)
def token_set_ratio_of(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (f"{both} {' '.join(sorted(z - (x & y)))}".strip() for z in (x, y))
    if both and (both == left or both == right):
        return 100.0
    return max(ratio_of(both, left) if both else 0.0, ratio_of(both, right) if both else 0.0, ratio_of(left, right))


def token_sort_ratio_of(a: str, b: str) -> float:
    return ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


@lru_cache(maxsize=100_000)
def weighted_ratio_of(a: str, b: str) -> float:
    """The largest of plain and token scores, these weighed by 0.95; for lengths apart by half or more of partial
    scores, weighed by 0.9, and by 0.6 from a factor of eight on."""
    if not a or not b:
        return 0.0
    long, short = max(len(a), len(b)), min(len(a), len(b))
    scores = [ratio_of(a, b)]
    if long < 1.5 * short:
        scores += [0.95 * token_sort_ratio_of(a, b), 0.95 * token_set_ratio_of(a, b)]
    else:
        scale = 0.9 if long <= 8 * short else 0.6
        x, y = set(a.split()), set(b.split())
        part = 100.0 if x & y else partial_ratio_of(" ".join(sorted(x - y)), " ".join(sorted(y - x)))
        sort = partial_ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
        scores += [scale * partial_ratio_of(a, b), 0.95 * scale * sort, 0.95 * scale * part]
    return max(scores)


def near_terms(x: Column, words: list[str], cutoff: float, spare_below: int, top: int = 8, needle: int = 200) -> Column:
    """Listed words that a text contains; where there are fewer than `spare_below`, also the `top` with the largest
    weighted ratio to its first `needle` characters that reach the cutoff. Sorted."""

    def of(text: str) -> list[str]:
        hits = {w for w in words if w in text}
        if len(hits) < spare_below:
            best = sorted(((-weighted_ratio_of(text[:needle], w), i, w) for i, w in enumerate(words)))[:top]
            hits |= {w for s, _, w in best if -s >= cutoff}
        return sorted(hits)

    def run(s: pd.Series) -> pd.Series:
        return s.fillna("").map(of)

    return F.pandas_udf(run, "array<string>")(x)


def closest(x: Column, words: list[str], score, cutoff: float, top: int) -> Column:
    """array of struct(pos, word, score) of the `top` listed words that score best with a text, the cutoff at least, best
    first, then in listed order. A text meets the list inside one call; repeated texts of a batch are scored once, null
    ones not at all."""

    def of(text: str) -> list[dict]:
        best = sorted((-score(w, text), i) for i, w in enumerate(words))[:top]
        return [{"pos": i, "word": words[i], "score": -s} for s, i in best if -s >= cutoff]

    def run(s: pd.Series) -> pd.Series:
        known = {t: of(t) for t in s.dropna().unique()}
        return pd.Series([[] if t is None else known[t] for t in s])

    return F.pandas_udf(run, "array<struct<pos: int, word: string, score: double>>")(x)


def closest_piece(x: Column, pattern: str, words: list[str], score, cutoff: float) -> Column:
    """The listed word that comes closest to the first piece of a text, in lower case, that reaches the cutoff with any;
    pieces stand between what the pattern matches. Null without one."""

    def of(text: str) -> str | None:
        for piece in re.split(pattern, text.lower()):
            best = max(((score(w, piece.strip()), -i) for i, w in enumerate(words)), default=(0.0, 0)) if piece.strip() else (0.0, 0)
            if best[0] >= cutoff:
                return words[-best[1]]
        return None

    def run(s: pd.Series) -> pd.Series:
        known = {t: of(t) for t in s.dropna().unique()}
        return s.map(lambda t: None if t is None else known[t])

    return F.pandas_udf(run, "string")(x)


def _udf(score):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")


def partial_ratio(a: Column, b: Column) -> Column:
    """Not marked as deterministic, so that a filter on it stays above a distinct and pairs are scored once."""
    return _udf(partial_ratio_of).asNondeterministic()(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    return _udf(token_set_ratio_of)(a, b)


def ratio(a: Column, b: Column) -> Column:
    return _udf(ratio_of)(a, b)


def alignment_of(a: str, b: str) -> int:
    """Optimal string alignment distance: insertions, deletions, substitutions and swaps of neighbours count one each, and
    nothing is changed twice ("ca" and "abc" are 3 apart). A bit for each character of a, by Hyyrö's recurrences."""
    if not a:
        return len(b)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, last, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down, zero, before = full, 0, 0, 0
    for c in b:
        hit = masks.get(c, 0)
        swap = ((~zero & hit) << 1) & before
        zero = ((((hit & up) + up) ^ up) | hit | down | swap) & full
        right, left = (down | ~(zero | up)) & full, zero & up
        distance += bool(right & last) - bool(left & last)
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down, before = (left | ~(zero | right)) & full, right & zero, hit
    return distance


def alignment(a: Column, b: Column) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else alignment_of(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return F.pandas_udf(run, "int")(a, b)


def normal_form(x: Column) -> Column:
    """Compatibility form of Unicode, which no SQL function gives."""

    def run(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return F.pandas_udf(run, "string")(x)
