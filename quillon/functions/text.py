"""Text functions as Column expressions: normalisers, keys, tokens, extractors."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

REFUSALS = ("i cannot", "i can't", "i'm sorry", "as an ai", "i am unable")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_text(c: Column) -> Column:
    """Lower case, punctuation to spaces, single spaces: for text without compatibility characters."""
    return squeeze(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "))


@F.arrow_udf(StringType())
def normalize_text_exact(texts: pa.Array) -> pa.Array:
    """As normalize_text, with NFKC and full case folding; text by text, so that only a few are held in other forms."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKC", x).casefold())).strip()

    parts = [pa.array([one(x.as_py()) for x in texts[a : a + 64]], pa.string()) for a in range(0, len(texts), 64)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def normalize_email(c: Column) -> Column:
    return F.lower(F.trim(c))


def normalize_phone(c: Column) -> Column:
    """Digits, and x with the extension's digits if there is one."""
    ext = F.regexp_extract(F.lower(c), r"(?:ext\.?|extension|x)\s*(\d+)\s*$", 1)
    body = F.regexp_replace(F.regexp_replace(F.lower(c), r"(?:ext\.?|extension|x)\s*\d+\s*$", ""), r"\D", "")
    return F.when(ext != "", F.concat(body, F.lit("x"), ext)).otherwise(body)


def normalize_url(c: Column) -> Column:
    """Host in lower case without www., path without doubled or trailing slashes, query kept, the rest dropped."""
    whole = F.regexp_replace(F.trim(c), r"^(?i)(https?)\s*:\s*//\s*", "$1://")
    whole = F.regexp_replace(whole, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    whole = F.regexp_replace(F.regexp_replace(whole, r"#.*$", ""), r"^[^/?@]*@", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(whole, r"^[^/?]*", 0)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(whole, r"^[^/?]*([^?]*)", 1), "/+", "/"), "/$", "")
    query = F.regexp_extract(whole, r"(\?.+)$", 1)
    return F.concat(host, path, query)


def normalize_date(c: Column) -> Column:
    """Dashes unified, white space removed, words for now become present."""
    d = F.regexp_replace(F.translate(F.lower(F.trim(c)), "–—", "--"), r"\s+", "")
    return F.when(d.isin("present", "current", "now"), F.lit("present")).otherwise(d)


def tokenize(c: Column) -> Column:
    """Search tokens: runs of a-z, digits, plus, hash and dot."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9+#.]+"), F.lit(0))


def word_count(c: Column) -> Column:
    """Words between white space; 0 for blank and null."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.coalesce(t, F.lit("")) == "", 0).otherwise(F.size(F.split(t, " ")))


def question_key(c: Column) -> Column:
    """Lower case letters, digits, question marks and single spaces: equal questions have equal keys."""
    k = F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(k, "[\"'“”‘’]", ""), r"[^a-z0-9\s?]", ""))


def strip_numbering(c: Column) -> Column:
    """Middle dots to asterisks, single spaces, no leading number."""
    t = squeeze(F.regexp_replace(c, "·", " * "))
    return F.trim(F.regexp_replace(t, r"^(?:\(?\d+[.):]|[-*])\s*", ""))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def strip_marks(c: Column, marks: str = "[]{}|·,; ") -> Column:
    """Single spaces, and none of the marks at either end."""
    return F.btrim(squeeze(c), F.lit(marks))


def has_any(c: Column, phrases=REFUSALS) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.lower(c).contains(p)
    return found


def stable_hash(*parts: Column, seed: str = "20260609") -> Column:
    """sha256 of the seed and the parts, joined by the unit separator; null counts as None."""
    return F.sha2(F.concat_ws("\x1f", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256)


def stable_fold(digest: Column, folds: int) -> Column:
    """The 256-bit number of a hex digest, modulo folds, digit by digit."""
    digits = F.transform(F.filter(F.split(digest, ""), lambda d: d != ""), lambda d: F.conv(d, 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: F.pmod(a * 16 + d, F.lit(folds).cast("long")))


def keep_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def years_between(start: Column, end: Column) -> Column:
    """Months from YYYY-MM to YYYY-MM, not below 0."""
    month = lambda c: F.substring(c, 1, 4).cast("int") * 12 + F.substring(c, 6, 2).cast("int")
    return F.greatest(month(end) - month(start), F.lit(0))
