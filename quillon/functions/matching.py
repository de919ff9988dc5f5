"""Similarities that no built-in expression has: indel ratio, optimal matching, longest common subsequence."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillon.functions.sets import bound
from quillon.functions.text import normalize_text
from quillon.shipping import ship


def _masks(a) -> dict:
    """The places of each item, as bits."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    return masks


#: Characters of the longest text whose places are remembered: it is mostly compared with several others.
_SHORT = 128
_masks_of_short = lru_cache(4096)(_masks)


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if not len(a) or not len(b):
        return 0
    masks = _masks_of_short(a) if isinstance(a, str) and len(a) <= _SHORT else _masks(a)
    row = full = (1 << len(a)) - 1
    get = masks.get
    for y in b:
        if m := row & get(y, 0):
            row = (row + m) | (row - m)
    return len(a) - (row & full).bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|), 1 for two empty strings."""
    n = len(a) + len(b)
    return 1.0 if n == 0 else 2.0 * lcs_length(a, b) / n


def anls_score(a: str | None, b: str | None, least: float = 0.5) -> float:
    """1 for two empty values, 0 if one is empty, else the ratio where it reaches `least`."""
    a, b = a or "", b or ""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    r = indel_ratio(a, b)
    return r if r >= least else 0.0


#: Cells of a matrix up to which plain lists are faster than arrays.
SMALL_MATRIX = 400


def assignment(weight) -> list[tuple[int, int]]:
    """Row and column pairs of the largest total weight (shortest augmenting paths with potentials), of a matrix as array or lists."""
    if not len(weight) or not len(weight[0]):
        return []
    turned = len(weight) > len(weight[0])
    if len(weight) * len(weight[0]) <= SMALL_MATRIX:
        rows = weight.tolist() if isinstance(weight, np.ndarray) else weight
        match = _augmented_lists([[-float(x) for x in r] for r in (zip(*rows, strict=True) if turned else rows)])
    else:
        w = np.asarray(weight, float)
        match = _augmented(-(w.T if turned else w)).tolist()
    pairs = [(match[j] - 1, j - 1) for j in range(1, len(match)) if match[j]]
    return sorted((c, r) if turned else (r, c) for r, c in pairs)


def _augmented_lists(cost: list[list[float]]) -> list[int]:
    """_augmented, number by number."""
    n, m = len(cost), len(cost[0])
    u, v = [0.0] * (n + 1), [0.0] * (m + 1)
    match, way = [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0 = match[j0]
            row, ui, d, j1 = cost[i0 - 1], u[i0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    slack = row[j - 1] - ui - v[j]
                    if slack < least[j]:
                        least[j], way[j] = slack, j0
                    if least[j] < d:
                        d, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += d
                    v[j] -= d
                else:
                    least[j] -= d
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return match


def _augmented(cost: np.ndarray) -> np.ndarray:
    """The row, from 1, that each column, from 1, is matched with at the least cost; 0 for none. There are no more rows than columns."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            slack = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (slack < least[1:])
            least[1:][better] = slack[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            d = least[j1]
            u[match[used]] += d
            v[used] -= d
            least[~used] -= d
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return match


def matched_score(truth: list[str], found: list[str], accept: float = 0.5) -> float:
    """F1 of the accepted pairs of an optimal matching, times their mean quality; 1 if both are empty."""
    if not len(truth) and not len(found):
        return 1.0
    if not len(truth) or not len(found):
        return 0.0
    w = np.array([[indel_ratio(a, b) for b in found] for a in truth])
    good = [w[i, j] for i, j in assignment(w) if w[i, j] >= accept]
    return 0.0 if not good else 2 * len(good) / (len(truth) + len(found)) * float(np.mean(good))


def _rouge(x: str | None, y: str | None) -> float:
    a, b = (x or "").lower().split(), (y or "").lower().split()
    return 0.0 if not a or not b else 2.0 * lcs_length(a, b) / (len(a) + len(b))


def _lists(x, y) -> float:
    return matched_score([] if x is None else list(x), [] if y is None else list(y))


def _vectorised(one):
    """A pandas UDF of two columns from a function of two values."""

    def many(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    def column(a: Column, b: Column) -> Column:
        ship()
        return F.pandas_udf(many, DoubleType())(a, b)

    return column


anls = _vectorised(anls_score)
hungarian = _vectorised(_lists)
#: F1 of the longest common subsequence of words.
rouge_l = _vectorised(_rouge)


def supported(value: Column, evidence: Column) -> Column:
    """Whether a normal text holds a normal value, or half of the value's distinct words; null for an empty value."""
    words = F.array_distinct(F.split(value, " "))
    share = F.size(F.array_intersect(words, F.split(evidence, " "))) / F.size(words)
    return F.when(value == "", F.lit(None)).otherwise(evidence.contains(value) | (share >= 0.5))


def all_supported(values: Column, evidence: Column) -> Column:
    """Whether a text holds every value of a list, as `supported` tells; null where no value is determinate."""
    text = normalize_text(F.coalesce(evidence, F.lit("")))
    some = F.array_distinct(F.coalesce(values, F.array().cast("array<string>")))
    kept = F.filter(F.array_distinct(F.transform(some, lambda v: normalize_text(F.coalesce(v, F.lit(""))))), lambda v: v != "")

    def held(v: Column, x: Column) -> Column:
        words = F.split(v, " ")
        return x["text"].contains(v) | (F.size(F.array_intersect(words, x["words"])) / F.size(F.array_distinct(words)) >= 0.5)

    # a lambda's variable is computed once; an expression in its body would be, for every value
    return bound(kept, lambda k: F.when(F.size(k) > 0, bound(text, lambda t: bound(F.struct(t.alias("text"), F.array_distinct(F.split(t, " ")).alias("words")), lambda x: F.forall(k, lambda v: held(v, x))))))
