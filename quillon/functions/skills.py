"""Technologies named in free values, with the known skills of their record."""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillon.shipping import ship

# Fixed values.
GENERIC_TOOLS = ("api", "app", "framework", "service", "tool")
LONGEST = 32
MOST_WORDS = 3
MARKS = "[]{}|·,; "

_NOT_WORD, _SPACES, _BETWEEN = re.compile(r"[^\w\s]"), re.compile(r"\s+"), re.compile(r"[,;|]")
#: Characters by which skills are looked up at each place of a text.
KEY = 3


@lru_cache(200_000)
def normal(text: str) -> str:
    return " ".join(_NOT_WORD.sub(" ", text.lower()).split())


@lru_cache(200_000)
def cleaned(piece: str) -> str:
    return _SPACES.sub(" ", piece.strip()).strip(MARKS).strip("()")


class SkillIndex:
    """Skills by their normal forms, filed under the first characters of those."""

    def __init__(self, skills: tuple[str | None, ...]):
        self.value: dict[str, str] = {}
        for s in skills:
            if s and (n := normal(s)):
                self.value[n] = min(s, self.value.get(n, s))
        self.filed: dict[str, list[str]] = defaultdict(list)
        for n in self.value:
            self.filed[n[:KEY]].append(n)

    def within(self, text: str) -> list[str]:
        """Normal forms that a normal text holds, in the order of their first places, shorter ones first where two begin together."""
        found: dict[str, int] = {}
        for at in range(len(text)):
            for size in range(1, KEY + 1):
                # a form shorter than the key is filed under itself
                for n in self.filed.get(text[at : at + size], ()):
                    if (len(n) == size or size == KEY) and n not in found and text.startswith(n, at):
                        found[n] = at
        return sorted(found, key=lambda n: (found[n], self.value[n]))


@lru_cache(4096)
def _index(skills: tuple[str | None, ...]) -> SkillIndex:
    return SkillIndex(skills)


def named(raws: list[str | None], known: SkillIndex) -> list[str]:
    """Technologies of the values in order, each once by its normal form.

    A value's pieces between commas, semicolons and bars count if they are short and new. Where
    none does, or one is generic, or a lone piece is part of an enumeration in words, the known
    skills that the value holds take their place, in order of appearance.
    """
    out: dict[str, str] = {}
    for raw in raws:
        raw = raw or ""
        pieces = [(normal(p), p) for p in map(cleaned, _BETWEEN.split(raw)) if p and len(p) <= LONGEST and len(p.split()) <= MOST_WORDS]
        fresh = [(n, p) for n, p in pieces if n and n not in out]
        names = {n for n, _ in fresh}
        if len(fresh) == 1 and " and " in raw.lower() and not names & known.value.keys():
            fresh, names = [], set()
        if not fresh or not names.isdisjoint(GENERIC_TOOLS):
            instead = [(n, known.value[n]) for n in known.within(normal(raw)) if n not in names and n not in out]
            fresh = instead or fresh
        for n, p in fresh:
            out.setdefault(n, p)
    return list(out.values())


def technologies(raws: Column, skills: Column) -> Column:
    """Arrays of raw values and of known skills to the technologies named, in Arrow batches; null counts as empty."""
    ship()

    def read(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([named([] if x is None else list(x), _index(() if y is None else tuple(y))) for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(read, ArrayType(StringType()))(raws, skills)
