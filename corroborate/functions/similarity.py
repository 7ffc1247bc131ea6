"""Pair scores on name features (see names.with_name_features) and on types."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corroborate.functions import lexicon as L
from corroborate.functions.literals import literal_map
from corroborate.functions.types import bare_type

UNSHARED_IDF = 1 + math.log(1.5)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda acc, x: acc + F.size(F.filter(b, lambda y: y == x)))


def token_cosine(a: Column, b: Column) -> Column:
    """Cosine of two bags of tokens; 0 when a side is empty."""
    norms = F.sqrt(_dot(a, a).cast("double") * _dot(b, b).cast("double"))
    return F.when(norms > 0, F.least(F.lit(1.0), _dot(a, b) / norms)).otherwise(F.lit(0.0))


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors, clamped to [0, 1]."""

    def total(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norms = F.sqrt(total(a, a) * total(b, b))
    return F.when(norms > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), total(a, b) / norms))).otherwise(F.lit(0.0))


def gram_cosine(grams_a: Column, counts_a: Column, grams_b: Column, counts_b: Column) -> Column:
    """TF-IDF cosine fitted on the two names only.

    With two documents the smoothed idf is 1 for a shared gram and 1 + ln 1.5
    otherwise, so only the shared grams need to be looked up.
    """
    shared = F.array_intersect(grams_a, grams_b)

    def total(over: Column, value) -> Column:
        return F.aggregate(over, F.lit(0), lambda acc, g: acc + value(g))

    def norm_sq(counts: Column) -> Column:
        everything = F.aggregate(F.map_values(counts), F.lit(0), lambda acc, n: acc + n * n)
        common = total(shared, lambda g: counts[g] * counts[g])
        return (everything - common) * F.lit(UNSHARED_IDF**2) + common

    dot = total(shared, lambda g: counts_a[g] * counts_b[g])
    norms = F.sqrt(norm_sq(counts_a).cast("double") * norm_sq(counts_b).cast("double"))
    return F.when(norms > 0, F.least(F.lit(1.0), dot / norms)).otherwise(F.lit(0.0))


def type_score(source: Column, target: Column) -> Column:
    """1.0 equal, 0.8 listed as compatible, 0.6 listed the other way round, else 0.2."""
    src, tgt = bare_type(source), bare_type(target)
    allowed = literal_map(L.TYPE_COMPATIBILITY, "array<string>")
    return (
        F.when(src == tgt, F.lit(1.0))
        .when(F.array_contains(F.try_element_at(allowed, src), tgt), F.lit(0.8))
        .when(F.array_contains(F.try_element_at(allowed, tgt), src), F.lit(0.6))
        .otherwise(F.lit(0.2))
    )


def date_rule(s: str = "s", t: str = "t") -> Column:
    """Date names with matching base words; NULL when the rule does not apply.

    Two date names without any base word count as equal (0.95).
    """
    sb, tb = F.col(f"{s}.base_word"), F.col(f"{t}.base_word")

    def skeleton(c: Column) -> Column:
        return F.regexp_replace(c, "[de]", "")

    return F.when(
        F.col(f"{s}.is_date") & F.col(f"{t}.is_date"),
        F.when(sb.isin("modified", "modify") & tb.isin("updated", "update"), F.lit(0.92))
        .when(skeleton(sb) == skeleton(tb), F.lit(0.92))
        .when(sb.eqNullSafe(tb), F.lit(0.95)),
    )


def domain_score(known_pairs, s: str = "s", t: str = "t") -> Column:
    """Cascade of naming rules; the first that applies gives the score."""

    def col(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    def flat(c: Column) -> Column:
        return F.replace(c, F.lit("_"), F.lit(""))

    pairs = literal_map({f"{a}\n{b}": float(v) for a, b, v in known_pairs}, "double")
    known = F.try_element_at(pairs, F.concat(col(s, "low"), F.lit("\n"), col(t, "low")))
    target_flat = flat(col(t, "low"))
    expands = (flat(col(s, "expansion")) == target_flat) | (col(s, "expansion") == col(t, "norm"))
    stripped_expands = (flat(col(s, "stripped_expansion")) == target_flat) | (
        F.replace(col(s, "stripped_expansion"), F.lit("_"), F.lit(" ")) == F.replace(col(t, "low"), F.lit("_"), F.lit(" "))
    )
    shared = F.size(F.array_intersect(col(s, "open_words"), col(t, "name_words")))
    union = F.size(F.array_union(col(s, "open_words"), col(t, "name_words")))
    overlap = F.when(union > 0, shared / union).otherwise(F.lit(0.0))
    nested = F.contains(col(t, "core"), col(s, "core")) | F.contains(col(s, "core"), col(t, "core"))
    return F.coalesce(
        known,
        F.when(col(s, "norm") == col(t, "norm"), F.lit(0.98)),
        F.when(col(s, "core") == col(t, "core"), F.lit(0.95)),
        F.when(expands, F.lit(0.95)),
        F.when(stripped_expands, F.lit(0.95)),
        F.when(F.arrays_overlap(col(s, "groups"), col(t, "groups")), F.lit(0.88)),
        date_rule(s, t),
        F.when((overlap > 0) & nested, F.greatest(overlap, F.lit(0.75))),
        overlap,
    )


def _indel(a: str, b: str) -> float:
    """1 - insertions and deletions over total length."""
    if not a and not b:
        return 1.0
    return 2 * _common(a, b) / (len(a) + len(b))


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row = (1 << len(a)) - 1
    for y in b:
        hit = row & where.get(y, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & ((1 << len(a)) - 1)).bit_count()


def _partial(a: str, b: str) -> float:
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 1.0 if not long else 0.0
    n = len(short)
    windows = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    best = max(_indel(short, w) for w in windows)
    if len(a) == len(b) and best < 1:
        best = max(best, max(_indel(long, w) for w in {short[max(0, i) : i + n] for i in range(1 - n, n)}))
    return best


def _token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    if common and (x <= y or y <= x):
        return 1.0
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    with_left, with_right = f"{common} {left}".strip(), f"{common} {right}".strip()
    scores = [_indel(with_left, with_right)]
    if common:
        scores += [_indel(common, with_left), _indel(common, with_right)]
    return max(scores)


def fuzzy(a: str, b: str) -> float:
    """0.2 ratio + 0.2 partial ratio + 0.3 token-sort + 0.3 token-set, each in [0, 1]."""
    sort_a, sort_b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 0.2 * _indel(a, b) + 0.2 * _partial(a, b) + 0.3 * _indel(sort_a, sort_b) + 0.3 * _token_set(a, b)


#: Longest string whose subsequences fit the bits of a word; longer ones are scored one at a time.
_WORD = 64


class _Strings:
    """Strings of a batch as a matrix of character codes, the last code as padding, and a bit mask per string and code."""

    def __init__(self, strings: Sequence[str]) -> None:
        self.size = np.array([len(s) for s in strings], dtype=np.int64)
        width = max(1, int(self.size.max(initial=0)))
        flat = np.array([*"".join(strings)], dtype="U1")
        letters, codes = np.unique(flat, return_inverse=True)
        self.pad = len(letters)
        self.codes = np.full((len(strings), width), self.pad, dtype=np.int64)
        row = np.repeat(np.arange(len(strings)), self.size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.codes[row, place] = codes
        self.masks = np.zeros((len(strings), self.pad + 1), dtype=np.uint64)
        np.bitwise_or.at(self.masks, (row, codes), np.uint64(1) << place.astype(np.uint64))


def _matched(strings: _Strings, a: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """Lengths of the longest common subsequences of strings ``a`` and what ``columns`` spells, a code of every pair at a time."""
    row = np.full(len(a), ~np.uint64(0))
    for code in columns:
        hit = row & strings.masks[a, code]
        row = (row + hit) | (row - hit)
    size = strings.size[a]
    low = ~np.uint64(0) >> (_WORD - np.maximum(size, 1)).astype(np.uint64)
    return size - np.where(size > 0, np.bitwise_count(row & low).astype(np.int64), 0)


def _ratios(strings: _Strings, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    width = int(strings.size[b].max(initial=0))
    total = strings.size[a] + strings.size[b]
    common = _matched(strings, a, [strings.codes[b, k] for k in range(width)])
    return np.where(total > 0, 2 * common / np.maximum(total, 1), 1.0)


def _best_windows(strings: _Strings, short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Best ratio of each ``short`` with a window of its length in ``long``, cut off at the ends.

    Windows that hold too few letters of ``short`` to beat the best so far are
    passed over; the whole of the most promising start goes first.
    """
    n, size = strings.size[short], strings.size[long]
    best = np.where((n > 0) | (size > 0), 0.0, 1.0)
    width = int(size.max(initial=0))
    hits = strings.masks[short[:, None], strings.codes[long, :width]]
    known = np.zeros((len(short), width + 1), dtype=np.int64)
    known[:, 1:] = np.cumsum(hits != 0, axis=1)

    def scored(some: np.ndarray, start: np.ndarray | int) -> None:
        first, end = np.maximum(0, start), np.minimum(start + n[some], size[some])
        row, left = np.full(len(some), ~np.uint64(0)), int(np.max(end - first))
        for k in range(left):
            at = first + k
            hit = row & np.where(at < end, hits[some, np.minimum(at, width - 1)], np.uint64(0))
            row = (row + hit) | (row - hit)
        low = ~np.uint64(0) >> (_WORD - n[some]).astype(np.uint64)
        common = n[some] - np.bitwise_count(row & low).astype(np.int64)
        best[some] = np.maximum(best[some], 2 * common / (n[some] + end - first))

    live = np.flatnonzero((n > 0) & (size > 0))
    if len(live):
        at = np.arange(width)[None, :]
        ends = np.minimum(at + n[live, None], size[live, None])
        held = np.where(at < size[live, None], np.take_along_axis(known[live], ends, 1) - known[live][:, :-1], -1)
        scored(live, held.argmax(axis=1))
    for start in range(1 - int(n.max(initial=0)), width):
        some = np.flatnonzero((start < size) & (start + n > 0) & (best < 1) & (n > 0))
        end = np.minimum(start + n[some], size[some])
        held = known[some, end] - known[some, max(0, start)]
        some = some[2 * held > best[some] * (n[some] + end - max(0, start)) + 1e-12]
        if len(some):
            scored(some, start)
    return best


def fuzzy_scores(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """:func:`fuzzy` of many pairs at once: subsequences of all pairs advance together, bit-parallel."""
    names = sorted({*left, *right})
    at = {name: k for k, name in enumerate(names)}
    parts = [name.split() for name in names]
    ordered = [" ".join(sorted(p)) for p in parts]
    bags = [set(p) for p in parts]
    n = len(left)
    a, b = np.array([at[x] for x in left], dtype=np.int64), np.array([at[x] for x in right], dtype=np.int64)
    strings: dict[str, int] = {}

    def number(text: str) -> int:
        return strings.setdefault(text, len(strings))

    whole, in_order = np.array([number(x) for x in names]), np.array([number(x) for x in ordered])
    set_left, set_right, closed = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        p, q = bags[x], bags[y]
        common = " ".join(sorted(p & q))
        if not p or not q or (common and (p <= q or q <= p)):
            closed[k] = 1.0 if common else -1.0
            continue
        u, v = (f"{common} {' '.join(sorted(r))}".strip() for r in (p - q, q - p))
        set_left[k], set_right[k] = number(u), number(v)
        if common:
            closed[k] = 2 * len(common) / (len(common) + min(len(u), len(v)))
    drawn = _Strings([*strings])
    if drawn.size.max(initial=0) > _WORD:
        return np.array([fuzzy(x, y) for x, y in zip(left, right, strict=True)])
    free = np.flatnonzero((closed >= 0) & (closed < 1))
    sets = np.maximum(closed, 0)
    sets[free] = np.maximum(sets[free], _ratios(drawn, set_left[free], set_right[free]))
    left_at, right_at = whole[a], whole[b]
    shorter = drawn.size[left_at] <= drawn.size[right_at]
    partial = _best_windows(drawn, np.where(shorter, left_at, right_at), np.where(shorter, right_at, left_at))
    even = np.flatnonzero((drawn.size[left_at] == drawn.size[right_at]) & (partial < 1))
    partial[even] = np.maximum(partial[even], _best_windows(drawn, right_at[even], left_at[even]))
    return 0.2 * _ratios(drawn, left_at, right_at) + 0.2 * partial + 0.3 * _ratios(drawn, in_order[a], in_order[b]) + 0.3 * sets


@F.pandas_udf(T.DoubleType())
def fuzzy_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Fuzzy score of two normalised names; null with a null name. Call it on distinct pairs."""
    held = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    fits = held & (a.str.len().le(_WORD) & b.str.len().le(_WORD)).to_numpy(dtype=bool, na_value=False)
    if fits.any():
        out[fits] = fuzzy_scores(a[fits].tolist(), b[fits].tolist())
    for k in np.flatnonzero(held & ~fits):
        out[k] = fuzzy(a.iloc[k], b.iloc[k])
    return pd.Series(out).astype(object).where(held, None).astype("float64")


def fuzzy_bound(a: Column, b: Column) -> Column:
    """No fuzzy score of two normalised names without a common token is above this.

    Every part but the partial ratio is twice a common subsequence over the
    lengths of two strings with the names' letters, so the letters that both
    have, in any order, bound it; the partial ratio is 1 at most.
    """

    def letters(c: Column) -> Column:
        return F.filter(F.split(c, ""), lambda x: x != "")

    x, y = letters(a), letters(b)
    held = F.aggregate(F.array_distinct(x), F.lit(0), lambda acc, g: acc + F.least(F.size(F.filter(x, lambda u: u == g)), F.size(F.filter(y, lambda u: u == g))))
    total = F.size(x) + F.size(y)
    return F.when(total == 0, F.lit(1.0)).otherwise(0.8 * 2.0 * held / total + 0.2)


def name_band(score: Column) -> Column:
    """Bands of the name matcher: .85 / .60 / .40."""
    return F.when(score >= 0.85, "high").when(score >= 0.60, "medium").when(score >= 0.40, "low").otherwise("none")


def ensemble_band(score: Column) -> Column:
    """Bands of the ensemble matcher: .8 / .6."""
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")
