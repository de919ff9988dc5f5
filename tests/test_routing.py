from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillon.operators import records as C
from quillon.operators import routing as G
from quillon.operators import splits as S

VALUES = [["a", None], ["é ü"], ["😀 and \"quotes\" \\ \n\t"], ["\x7f"], [], ["plain", "two"]]
REC = "array<struct<name:string,year:string>>"


def test_json_length_is_that_of_escaped_json(spark):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, v array<string>")
    got = {r.i: r.n for r in d.select("i", G.json_length(F.col("v")).alias("n")).collect()}
    assert got == {i: len(json.dumps(v, separators=(",", ":"))) for i, v in enumerate(VALUES)}


def test_features_of_two_results(spark):
    a = [{"name": "Léa", "year": "2001"}, {"name": "Bo", "year": None}]
    rows = [(1, a, a, "Léa came in 2001 with Bo"), (2, a, a[:1], "Léa"), (3, None, [], None), (4, [], a, "x"), (5, [{"name": "", "year": None}], None, "x")]
    d = spark.createDataFrame(rows, f"id int, p {REC}, q {REC}, e string")
    x = G.field_features(F.col("p"), F.col("q"), F.col("e"), ("name", "year"))
    got = {r.id: tuple(r)[1:] for r in d.select("id", *[c.alias(k) for k, c in x.items()]).collect()}
    n = len(json.dumps(a, sort_keys=True))
    assert got == {1: (False, 2, 2, n, True), 2: (True, 2, 1, n, False), 3: (False, 0, 0, 2, False), 4: (True, 0, 2, 2, False), 5: (True, 1, 0, len(json.dumps(rows[4][1], sort_keys=True)), False)}


def test_primary_features(spark):
    rows = [(1, ["a", "b"], "x", None, 3, True), (2, None, "", 1.5, None, None), (3, [], None, 2.0, 1, False)]
    d = spark.createDataFrame(rows, "id int, many array<string>, one string, s double, n int, cut boolean")
    got = {(r.id, r.field): tuple(r)[2:] for r in G.primary_features(d, "id", ("many", "one"), "s", "n", "cut").collect()}
    assert got[1, "many"] == (2, 9, False, 0.0, 3, True) and got[1, "one"] == (1, 3, False, 0.0, 3, True)
    assert got[2, "many"] == (0, 4, True, 1.5, 0, False) and got[2, "one"] == (0, 2, True, 1.5, 0, False)
    assert got[3, "many"] == (0, 2, True, 2.0, 1, False) and got[3, "one"] == (0, 4, True, 2.0, 1, False)
    with pytest.raises(PySparkException, match="duplicate id"):
        G.primary_features(d.union(d), "id", ("one",), "s", "n", "cut").collect()
    assert G.primary_features(d.filter("false"), "id", ("one",), "s", "n", "cut").count() == 0


def test_focused_requests(spark):
    d = spark.createDataFrame([(1, True, False), (2, False, False), (3, True, True)], "id int, a boolean, b boolean")
    q = spark.createDataFrame([(1, "t1"), (3, "t3")], "id int, text string")
    ask = lambda r: {x.id: (x.text, list(x.routed_fields), dict(x.schema_)) for x in G.focused_requests(d, r, "id", {"a": F.col("a"), "b": F.col("b")}, {"a": ("x",), "b": ("y", "z")}).withColumnRenamed("schema", "schema_").collect()}
    assert ask(q) == {1: ("t1", ["a"], {"a": ["x"]}), 3: ("t3", ["a", "b"], {"a": ["x"], "b": ["y", "z"]})}
    with pytest.raises(PySparkException, match="no request of 3"):
        ask(q.filter("id = 1"))


def test_routes_of_the_first_result_alone(spark):
    f = lambda field, n, c, s: spark.range(1).select(C.route_primary_only(field, F.lit(n), F.lit(c), F.lit(s)).alias("x")).first().x
    assert f("work_experience", 0, 383, True) and not f("work_experience", 1, 384, True) and not f("work_experience", 1, 10, False)
    assert f("certifications", 1, 9999, True) and not f("certifications", 0, 2, True)


def test_nine_splits(spark):
    rows = [(i, "ab"[i % 2], f"t{i % 5}", None if i % 17 == 0 else f"d{i % 3}") for i in range(300)] + [(300, None, "t1", "d0"), (301, "a", None, "d0")]
    d = spark.createDataFrame(rows, "id int, tier string, template string, domain string")
    got = S.nine_splits(d, "id", "tier", "template", "domain", {"t0": 10, "t9": 4}, {"a": 60, "b": 400}, 30, 20, (4, 9)).collect()
    s = {}
    for r in got:
        s.setdefault(r.split, set()).add(r.id)
    assert sum(map(len, s.values())) == len(got)
    assert len(s["template_ood_test"]) == 10 and all(rows[i][2] == "t0" for i in s["template_ood_test"])
    parts = [s[k] for k in ("template_ood_test", "validation", "id_test", "train")]
    assert set().union(*parts) == s["working"] and sum(map(len, parts)) == len(s["working"])
    assert s["working"] | s["locked_confirmation"] == s["completed"] == set(range(302)) and not s["working"] & s["locked_confirmation"]
    assert sum(rows[i][1] == "a" for i in s["working"]) == 60  # b's quota is beyond its rows
    assert sum(rows[i][1] == "b" and rows[i][2] != "t0" for i in s["working"]) == 120
    assert (len(s["validation"]), len(s["id_test"])) == (30, 20)
    assert s["debug_50"] < s["debug_250"] < s["train"] and (len(s["debug_50"]), len(s["debug_250"])) == (8, 18)
    assert 300 in s["locked_confirmation"]
    shuffled = spark.createDataFrame(rows[::-1], d.schema).repartition(7)
    assert {(r.split, r.id) for r in got} == {(r.split, r.id) for r in S.nine_splits(shuffled, "id", "tier", "template", "domain", {"t0": 10, "t9": 4}, {"a": 60, "b": 400}, 30, 20, (4, 9)).collect()}
