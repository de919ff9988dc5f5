from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillon import api
from quillon.functions import jsonfix as J
from quillon.functions import matching as X
from quillon.functions import sets as S
from quillon.functions import text as T
from quillon.operators import projects as P
from quillon.operators import records as C

WORK = "array<struct<job_title:string,company:string,start_date:string,end_date:string,duration:string>>"


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def work(*rows):
    return F.from_json(F.lit(json.dumps([dict(zip(C.WORK, r, strict=True)) for r in rows])), WORK)


@pytest.mark.parametrize(
    ("row", "record", "events"),
    [
        # dates from the duration; marks at the ends go
        (("Harbour Pilot|", "· Kestrel Lines", "", "", "2011-03 to 2014-09"), ("Harbour Pilot", "Kestrel Lines", "2011-03", "2014-09", "2011-03 - 2014-09"), ["work_start_date_repaired", "work_end_date_repaired", "work_duration_normalized"]),
        # a word for now ends the record
        (("Cartographer", "Ordnance Shed", "2019", "(current)", ""), ("Cartographer", "Ordnance Shed", "2019", "Present", "2019 - Present"), ["work_duration_normalized"]),
        # a lone hint that differs from the start is the end
        (("Beekeeper", "", "2008-05", "", "2010-01"), ("Beekeeper", "", "2008-05", "2010-01", "2008-05 - 2010-01"), ["work_end_date_repaired", "work_duration_normalized"]),
        (("Glazier", "Pane & Son", "1999", "2001", "1999 - 2001"), ("Glazier", "Pane & Son", "1999", "2001", "1999 - 2001"), []),
    ],
)
def test_repair_of_dates(spark, row, record, events):
    x = one(spark, C.repair_work(work(row)[0]))
    assert tuple(x.record) == record and x.events == events


def test_merge_of_neighbours(spark):
    rows = [
        ("Tide Table", "", "2003-02", "", ""), ("Analyst", "Kestrel Lines", "", "2006-07", ""),  # a title completed by a generic one
        ("Lockkeeper", "", "", "", ""), ("", "Canal Trust", "2007", "2009", ""),  # a row without a title fills the one before
        ("Miller", "Grist Co", "2010", "2012", "2010 - 2012"), ("Baker", "Crumb Co", "2013", "2014", "2013 - 2014"),  # whole rows stay
    ]
    got = [tuple(r) for r in one(spark, C.merge_work(work(*rows)))]
    assert got == [("Tide Table Analyst", "Kestrel Lines", "2003-02", "2006-07", "2003-02 - 2006-07"), ("Lockkeeper", "Canal Trust", "2007", "2009", "2007 - 2009"), rows[4], rows[5]]


def test_work_features(spark):
    rows = [("Miller", "Grist Co", "2010", "2012", "2010 - 2012"), ("", "Crumb Co", "", "", ""), ("Glazier", "", "", "1999", ""), ("odd ¤ sign", "Pane", "2001", "2002", ""), ("", "", "", "", "")]
    got = spark.range(1).select(*[c.alias(k) for k, c in C.work_features(work(*rows)).items()]).first().asDict()
    assert got == {"record_count": 5, "complete": 2, "partial": 2, "empty_title": 2, "empty_company": 2, "has_dates": 3, "suspicious": 1}


@pytest.mark.parametrize(
    ("raws", "skills", "want"),
    [
        (["a planner built on Redshift and dbt for the depot"], ["Kafka", "dbt", "Redshift"], ["Redshift", "dbt"]),
        (["framework; a rather long description of how Zig was used there"], ["Zig", "Rust"], ["Zig"]),
        (["Perl | Ada, perl", "Lua"], [], ["Perl", "Ada", "Lua"]),
    ],
)
def test_technologies(spark, raws, skills, want):
    arr = lambda v: F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>")
    assert one(spark, P.technologies(arr(raws), arr(skills))) == want


def test_set_metrics_and_matching(spark):
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    m = S.set_metrics(S.clean_set(arr("Oak", " elm")), S.clean_set(arr("OAK", "Ash")))
    assert list(spark.range(1).select(*[m[k] for k in ("precision", "recall", "f1", "jaccard")]).first()) == pytest.approx([0.5, 0.5, 0.5, 1 / 3])
    assert X.matched_score(["one", "two"], ["one", "two", "two"]) == pytest.approx(0.8)
    assert one(spark, T.normalize_url(F.lit("https : //www.Quarry.example//a/b/?q=1#top"))) == "quarry.example/a/b?q=1"


HEAD = '{"full_name":"Mirek","email":"mirek@quarry.example","location":"Brno","phone":"420","summary":"digs","skills":["blasting"]'


@pytest.mark.parametrize(
    ("raw", "name", "gone"),
    [
        (HEAD + ',"leftovers":{"notes":["an "inner" mark"]}}', "Mirek", "leftovers"),
        (HEAD + '}, "trailer":["more"]}', "Mirek", "trailer"),
        ("```json\n" + HEAD + "}\n```", "Mirek", "x"),
        ("chatter <|output|> " + HEAD + "}", "Mirek", "x"),
        ("no json", None, None),
        ("[1]", None, None),
        (HEAD + "}", "Mirek", "x"),
    ],
)
def test_generated_json(spark, raw, name, gone):
    x = one(spark, J.parsed(F.lit(raw)))
    if name is None:
        assert x.json is None and x.error
    else:
        assert x.error is None and json.loads(x.json)["full_name"] == name and gone not in json.loads(x.json)


def test_coerce(spark):
    record, events = P.coerce(F.lit('{"n": 1, "u": "", "s": ["a", null, " "], "zz": 1}'), ["n", "m"], ["u"], ["s"])
    r = spark.range(1).select(record.alias("r"), events.alias("e")).first()
    assert (r.r.n, r.r.m, r.r.u, r.r.s) == ("1", "", None, ["a"])
    assert r.e == ["required_string_coerced:n", "required_string_coerced:m", "extra_key_removed:zz"]


def test_alignment_takes_tokens_once(spark):
    tokens = spark.createDataFrame([(1, i, w) for i, w in enumerate("Data Lead, at Acme data lead".split())], "doc_id bigint, at int, text string")
    notes = spark.createDataFrame([(1, 0, "data lead", "a"), (1, 1, "Data Lead", "b"), (1, 2, "data lead", "c"), (1, 3, "acme", "d"), (2, 0, "x", "e")], "doc_id bigint, ord int, text string, label string")
    got = {(r.at, r.label) for r in P.align(tokens, notes).collect()}
    assert got == {(0, "a"), (1, "a"), (4, "b"), (5, "b"), (3, "d")}


def test_pipelines(spark, tmp_path):
    docs = spark.createDataFrame([(i, "de" if i % 3 else "fr", f"text number {i} of search") for i in range(90)], "doc_id bigint, lang string, text string")
    api.require_clean(api.audit(docs, "doc_id", ["text"]))
    with pytest.raises(api.GateFailed):
        api.require_clean(api.audit(docs.union(docs.limit(1)), "doc_id", ["text"]))
    splits = api.build_splits(docs, "doc_id", [("test", 9, ["lang"], F.lit(True)), ("validation", 12, ["lang"], F.lit(True))])
    assert {r.split: r["count"] for r in splits.groupBy("split").count().collect()} == {"test": 9, "validation": 12, "train": 69}
    api.validate_splits(splits, docs, "doc_id")
    with pytest.raises(api.GateFailed):
        api.validate_splits(splits.filter("split <> 'test'"), docs, "doc_id")
    q = spark.createDataFrame([(1, "number 7"), (2, "number 8")], "query_id bigint, text string")
    rel = spark.createDataFrame([(1, 7), (2, 8)], "query_id bigint, doc_id bigint")
    assert [r.mrr for r in api.run_baseline(docs, q, rel).collect()] == [1.0, 1.0]
    raw = spark.createDataFrame([(1, 'x {"a": "b"} y'), (2, "{}")], "id bigint, raw string")
    got = {r.id: (r.record.a, len(r.events)) for r in api.ingest(raw.select("id"), raw, "id", ["a"], [], []).collect()}
    assert got == {1: ("b", 0), 2: ("", 1)}
    store = api.RunStore(spark, f"file://{tmp_path}/runs")
    runs = lambda *v: spark.createDataFrame(list(v), "run_id string, status string")
    store.upsert("runs", runs(("a", "running"), ("b", "running")), ["run_id"])
    store.upsert("runs", runs(("a", "completed")), ["run_id"])
    assert {tuple(r) for r in store.read("runs").collect()} == {("a", "completed"), ("b", "running")}
    first = store.guard(T.stable_hash(F.lit("k1"), F.lit(1.5)))
    assert store.guard(T.stable_hash(F.lit("k1"), F.lit(1.5))) == first
    with pytest.raises(api.GateFailed):
        store.guard(T.stable_hash(F.lit("k1"), F.lit(2.0)))
