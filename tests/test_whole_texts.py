"""Queries over whole texts, against brute force."""

from __future__ import annotations

import re
from itertools import permutations

import pytest

from quillon.plans.catalog import QUERIES


@pytest.fixture
def folder(spark, tmp_path):
    def make(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def test_token_span_beyond_400_tokens(spark, folder):
    docs = [(0, "Filler " * n + "Seek this. " + "rest " * 9 + "seek this") for n in (0, 399, 400, 5000)] + [(0, "seek " * 600), (0, "seek"), (0, "")]
    docs = [(40 * k, x) for k, (_, x) in enumerate(docs)]
    at = folder(documents=(docs, "doc_id long, text string"), benchmark=([(0, "Seek THIS passage")], "item_id long, text string"))

    def first(text):
        w = re.findall("[a-z0-9]+", text.lower())
        return next((i for i in range(len(w) - 1) if w[i : i + 2] == ["seek", "this"]), -1)

    assert {r["doc_id"]: r["at"] for r in QUERIES["c26_token_span"](spark, at).collect()} == {d: first(x) for d, x in docs}


def test_all_lines_are_matched(spark, folder):
    from quillon.functions.matching import indel_ratio

    first = "one two three four five six seven eight nine ten eleven twelve thirteen\nred apples grow\n\n quiet rivers bend "
    turns = {1: (first, "quiet rivers bend\nred apples grew\nzzzz"), 2: ("a b c\nlong tail of words here", "long tail of words here\na b c"), 3: ("same", "same")}
    rows = [(c, n, "user", x) for c, pair in turns.items() for n, x in enumerate([pair[0], "between", pair[1]])]
    at = folder(conversations=(rows, "conv_id long, turn long, role string, text string"))

    def brute(x, y):
        a, b = ([z.strip() for z in v.split("\n") if z.strip()] for v in (x, y))
        a, b = sorted((a, b), key=len)
        pairs = max(([indel_ratio(p, q) for p, q in zip(a, o, strict=True)] for o in permutations(b, len(a))), key=sum)
        good = [v for v in pairs if v >= 0.5]
        return 2 * sum(good) / (len(a) + len(b))

    assert {r["conv_id"]: r["score"] for r in QUERIES["f10_hungarian"](spark, at).collect()} == {c: pytest.approx(brute(*p), abs=1e-6) for c, p in turns.items()}


def test_keywords_of_whole_texts(spark, folder):
    docs = [(0, "x, " * 100 + "Spark SQL | data lake; ETL\nAirflow"), (40, "spark sql,DATA LAKE"), (1, "alone"), (80, "")]
    at = folder(documents=(docs, "doc_id long, text string"), benchmark=([(0, "ETL;Spark SQL\n data lake ")], "item_id long, text string"))
    keys = lambda x: {k.strip().lower() for k in re.split(r"[,;|\n]", x) if k.strip()}

    def f1(d, text):
        a, b = keys(text), keys("ETL;Spark SQL\n data lake ") if d % 40 == 0 else set()
        return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0

    assert {r["doc_id"]: r["f1"] for r in QUERIES["f33_keyword_f1"](spark, at).collect()} == {d: pytest.approx(f1(d, x), abs=1e-6) for d, x in docs}


def test_value_support(spark):
    from pyspark.sql import functions as F

    from quillon.functions import matching as X

    rows = [(["Tin mine"], "the TIN, mine!", True), (["red blue"], "only red here", True), (["red blue green"], "only red here", False), (["red", "", None, "--"], "red", True), (["red", "teal"], "red", False), ([], "red", None), (None, "red", None), (["?"], "red", None), (["red"], None, False)]
    got = spark.createDataFrame([(i, v, t) for i, (v, t, _) in enumerate(rows)], "i int, v array<string>, t string").select("i", X.all_supported(F.col("v"), F.col("t")).alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: w for i, (_, _, w) in enumerate(rows)}


def test_exact_normal_form(spark, folder):
    docs = [(1, "Straße ﬁn — Ünï ②"), (2, "A_b\tc!!"), (3, None)]
    at = folder(documents=(docs, "doc_id long, text string"))
    assert {r.doc_id: r.normal for r in QUERIES["f1_normalize_exact"](spark, at).collect()} == {1: "strasse fin ünï 2", 2: "a_b c", 3: None}
