"""Evaluation of whole documents: known answers, broken predictions, and whole tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillon.operators import evaluation as V
from quillon.operators import relations as R
from quillon.plans.catalog import QUERIES
from tests.conftest import SMALL

ADA = {
    "full_name": "Ada Byron", "email": "ada@x.org", "location": "London", "phone": "+44 20 7946 0958", "linkedin_url": "https://www.linkedin.com/in/ada", "github_url": None, "summary": "First of her kind",
    "skills": ["Python", "SQL"], "work_experience": [{"job_title": "Cook", "company": "A", "start_date": "2001-01", "end_date": "2002-02", "duration": "2001-01 - 2002-02"}, {"job_title": "Cook", "company": "B", "start_date": "2003", "end_date": "now", "duration": ""}],
    "education": [], "projects": None, "certifications": [{"name": "C", "issuer": "I", "date": "2001"}],
}


def scores(**changed):
    r = V.evaluate_one(json.dumps(ADA), json.dumps(ADA | changed), "")
    return {f["path"]: f["score"] for f in r["fields"]}, r


def test_equal_documents_score_one():
    got, r = scores()
    assert set(got.values()) == {1.0} and list(got) == list(V.RECORD) and r["json_valid"] and r["schema_valid"] and r["events"] == [] and r["missing_keys"] == []


def test_each_kind_of_field_has_its_metric():
    got, r = scores(email=" ADA@X.ORG", phone="+44-20-7946-0958", linkedin_url="linkedin.com/in//ada/", summary="first, of her kind!", skills=["python", "Go"], location="Rome")
    assert (got["email"], got["phone"], got["linkedin_url"], got["summary"], got["location"]) == (1, 1, 1, 1, 0) and got["skills"] == pytest.approx(0.5)
    f = next(f for f in r["fields"] if f["path"] == "skills")
    assert (f["precision"], f["recall"], round(f["jaccard"], 6), f["metric"]) == (0.5, 0.5, 0.333333, "set_f1")
    assert scores(phone="+44 20 7946 0958 ext. 7")[0]["phone"] == 0


def test_records_are_matched_at_their_best():
    a, b = ADA["work_experience"]
    got, r = scores(work_experience=[b, a, a], certifications=None)
    f = next(f for f in r["fields"] if f["path"] == "work_experience")
    assert (f["precision"], f["recall"], f["score"]) == (pytest.approx(2 / 3), 1.0, pytest.approx(0.8)) and got["certifications"] == 0 and got["education"] == got["projects"] == 1
    assert V.matched([{"company": "A", "job_title": "E"}, {"company": "B", "job_title": "E"}], [{"company": "B", "job_title": "E"}] + [{"company": "A", "job_title": "E"}] * 2, ("company", "job_title"))["f1"] == pytest.approx(0.8)


def test_what_the_form_forbids_is_told():
    bad = {k: v for k, v in ADA.items() if k != "phone"} | {"email": 7, "skills": ["a", 1], "work_experience": [{"job_title": "x", "more": 1}, "y"], "education": "none", "projects": {}, "extra": 1, "summary": None}
    r = V.evaluate_one(json.dumps(ADA), json.dumps(bad), None)
    assert not r["schema_valid"] and r["json_valid"] and r["missing_keys"] == ["phone"] and r["extra_keys"] == ["extra"]
    assert [(e["kind"], e["path"]) for e in r["events"]] == [
        ("string_type", "email"), ("missing", "phone"), ("string_type", "summary"), ("string_type", "skills.1"), ("missing", "work_experience.0.company"), ("missing", "work_experience.0.start_date"), ("missing", "work_experience.0.end_date"),
        ("missing", "work_experience.0.duration"), ("extra_forbidden", "work_experience.0.more"), ("model_type", "work_experience.1"), ("list_type", "education"), ("list_type", "projects"), ("extra_forbidden", "extra"),
    ]


@pytest.mark.parametrize("raw", [None, "", "{bad json", "[1]", "{" * 100_000])
def test_broken_predictions_are_events(raw):
    r = V.evaluate_one(json.dumps(ADA), raw, "")
    assert not r["json_valid"] and not r["schema_valid"] and r["events"][0]["kind"] == "json_parse_error" and r["missing_keys"] == sorted(V.RECORD)
    assert {f["path"] for f in r["fields"] if f["score"] == 1} == {"github_url", "education", "projects"}  # both sides have none


def test_repair_reads_what_it_can():
    cut = json.dumps(ADA)[:-40]
    assert not V.evaluate_one(json.dumps(ADA), cut, "")["json_valid"]
    r = V.evaluate_one(json.dumps(ADA), cut, "", repair=True)
    assert r["json_valid"] and r["missing_keys"] == ["certifications", "projects"] or r["missing_keys"] == ["certifications"]
    assert next(f["score"] for f in r["fields"] if f["path"] == "work_experience") == 1


def test_support_by_evidence():
    held = V.normal("Jane Doe is a machine learning engineer working with Python.")
    told = lambda v: V.is_supported(v, held, set(held.split()))
    assert told("Jane Doe") and told("machine LEARNING engineer") and told("Doe Jane") and told("python expert") and told(["jane", None, ""]) and told({"a": "doe", "b": ["python"]})
    assert told("unrelated value") is False and told(["jane", "absent"]) is False
    assert told("") is None and told(None) is None and told([]) is None and told({"a": None}) is None and told("··") is None


def test_reports_of_a_corpus(spark):
    rows = [(1, json.dumps(ADA), json.dumps(ADA), json.dumps(ADA)), (2, json.dumps(ADA), "{broken", "nothing"), (3, json.dumps(ADA), json.dumps(ADA | {"email": "b@x.org", "zip": 1}), "ada byron london")]
    df = spark.createDataFrame(rows, "doc_id long, truth string, raw string, evidence string").repartition(2)
    e = V.evaluate_documents(df).cache()
    got = {r.doc_id: r for r in e.collect()}
    assert got[1].macro == 1 and got[2].macro == pytest.approx(3 / 12) and got[3].macro == pytest.approx(11 / 12)
    assert got[1].unsupported_rate == 0 == got[2].unsupported_rate and 0 < got[3].unsupported_rate < 1
    c = V.corpus_report(e).first()
    assert (c.documents, c.json_valid_rate, c.schema_valid_rate) == (3, pytest.approx(2 / 3), pytest.approx(1 / 3)) and c.micro == pytest.approx((12 + 3 + 11) / 36) == c.macro
    assert c.field_scores["email"] == pytest.approx(1 / 3) and c.events["json_parse_error"] == 1 and c.events["extra_forbidden"] == 1 and c.events["missing"] == 8
    none = V.corpus_report(V.evaluate_documents(df.limit(0))).first()
    assert (none.documents, none.micro, none.json_valid_rate) == (0, 0.0, 0.0)
    with pytest.raises(Exception, match="no record"):
        V.evaluate_documents(df.withColumn("truth", F.lit("{}"))).collect()


def test_grounded_documents_and_comparison(spark):
    pages = spark.createDataFrame([(1, 2, ["London"]), (1, 1, ["Ada", "Byron"]), (2, 1, ["x"])], "doc_id long, page int, words array<string>")
    truths = spark.createDataFrame([(i, json.dumps(ADA)) for i in (1, 2)], "doc_id long, truth string")
    predictions = spark.createDataFrame([(1, json.dumps({"full_name": "Ada Byron", "location": "London"}))], "doc_id long, raw string")
    got = {r.doc_id: r for r in V.evaluate_grounded(pages, truths, predictions).collect()}
    assert got[1].unsupported_rate == 0 and got[1].macro == pytest.approx(5 / 12) and got[2].macro == pytest.approx(3 / 12) and not got[2].json_valid
    left, right = V.evaluate_grounded(pages, truths, predictions), V.evaluate_grounded(pages, truths, truths.withColumnRenamed("truth", "raw"))
    d = {r.doc_id: r for r in V.compare_predictions(left, right).collect()}
    assert d[1].macro_delta == pytest.approx(7 / 12) and d[1].field_delta == 1.0 and d[2].right_macro == 1
    with pytest.raises(R.KeyMismatch):
        V.compare_predictions(left.filter("doc_id = 1"), right)


def test_query_over_whole_orders(spark):
    got = QUERIES["c2_evaluation_report"](spark, SMALL).first()
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").select("o_orderkey").collect()
    keys = [r.o_orderkey for r in orders]
    assert got.documents == len(keys)
    assert got.json_valid_rate == pytest.approx(sum(k % 7 != 3 for k in keys) / len(keys))
    assert got.schema_valid_rate == pytest.approx(sum(k % 7 != 3 and k % 5 != 2 for k in keys) / len(keys))
    assert got.field_scores["email"] == pytest.approx(sum(k % 7 != 3 and k % 4 != 1 for k in keys) / len(keys))


def test_report_evaluates_each_document_once(spark):
    rows = spark.createDataFrame([(i, json.dumps(ADA), json.dumps(ADA), None) for i in range(3)], "doc_id long, truth string, raw string, evidence string")
    report = V.corpus_report(V.evaluate_documents(rows))
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("MapInPandas") == 1
    got = report.first()
    assert got.documents == 3 and got.micro == got.macro == 1 and got.events == {} and set(got.field_scores) == set(V.RECORD)
    none = V.corpus_report(V.evaluate_documents(rows.limit(0))).first()
    assert none.documents == 0 and none.micro == 0 and none.json_valid_rate == 0 and none.field_scores == {}


def tokens(text, *labels, doc=1):
    """Words with the label of the runs (first, last, field, index) that they are in."""
    rows = []
    for i, w in enumerate(text.split()):
        f = next(((f, n) for a, b, f, n in labels if a <= i <= b), (None, None))
        rows.append((doc, i, w, *f))
    return rows


TOKENS = "doc_id long, at long, text string, field_path string, record_index int"


def test_labelled_tokens_spell_a_record(spark):
    text = "Ada Byron , Python , Go; Type Script Cook Inn 2001 Chef Bar Planner Rust, Zig Planner"
    labels = [(0, 1, "full_name", None), (3, 7, "skills", None), (8, 8, "work_experience.*.job_title", 0), (9, 9, "work_experience.*.company", 0), (11, 11, "work_experience.*.job_title", 1), (12, 12, "work_experience.*.company", 1), (13, 13, "projects.*.name", 0), (14, 14, "projects.*.technologies", 0), (15, 15, "projects.*.technologies", 0), (16, 16, "projects.*.name", 0)]
    df = spark.createDataFrame(tokens(text, *labels) + tokens("nothing here", doc=2), TOKENS).repartition(3)
    got = {r.doc_id: json.loads(r.raw) for r in V.decode_labelled(df).collect()}
    assert got[1]["full_name"] == "Ada Byron" and got[1]["skills"] == ["Python", "Go", "Type Script"] and got[1]["github_url"] is None and got[1]["email"] == ""
    assert [(w["job_title"], w["company"], w["duration"]) for w in got[1]["work_experience"]] == [("Cook", "Inn", ""), ("Chef", "Bar", "")]
    assert got[1]["projects"] == [{"name": "Planner", "technologies": ["Rust, Zig"], "url": None}] and got[1]["certifications"] is None and got[1]["education"] == []
    assert got[2]["full_name"] == "" and got[2]["work_experience"] == [] and got[2]["projects"] is None
    assert list(V.schema_issues(got[1], V.RECORD)) == [] == list(V.schema_issues(got[2], V.RECORD))


def test_records_by_fields_that_come_back(spark):
    labels = [(0, 0, "work_experience.*.job_title", None), (1, 1, "work_experience.*.company", None), (2, 2, "work_experience.*.job_title", None), (3, 3, "work_experience.*.company", None)]
    df = spark.createDataFrame(tokens("Cook Inn Chef Bar", *labels), TOKENS)
    split = lambda s: [(w["job_title"], w["company"]) for w in json.loads(V.decode_labelled(df, sessions=s).first().raw)["work_experience"]]
    assert split(True) == [("Cook", "Inn"), ("Chef", "Bar")] and split(False) == [("Cook", "Inn")]


def test_labels_alone_carry_a_document(spark):
    truth = {k: "" if f == "text" else [] if f in ("texts", "records") else None for k, f in V.RECORD.items()} | {"full_name": "Ada Byron", "skills": ["Go"], "work_experience": [{"job_title": "Cook", "company": "Inn", "start_date": "", "end_date": "", "duration": ""}]}
    df = spark.createDataFrame(tokens("Ada Byron Go, Cook Inn", (0, 1, "full_name", None), (2, 2, "skills", None), (3, 3, "work_experience.*.job_title", 0), (4, 4, "work_experience.*.company", 0)), TOKENS)
    truths = spark.createDataFrame([(1, json.dumps(truth)), (9, json.dumps(truth))], "doc_id long, truth string")
    r = V.record_oracle(df, truths).collect()
    assert len(r) == 1 and r[0].macro == 1 and r[0].unsupported_rate == 0 and r[0].schema_valid


def test_oracle_over_whole_conversations(spark):
    got = QUERIES["c5_labels_alone"](spark, SMALL).collect()
    assert len(got) == spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id").distinct().count()
    assert all(r.json_valid and r.schema_valid for r in got) and sum(r.macro for r in got) / len(got) > 0.9
