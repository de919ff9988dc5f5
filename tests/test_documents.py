"""Decoding and repair of whole documents: known answers, and a plain fold over whole tables."""

from __future__ import annotations

import json
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions import skills as K
from quillon.operators import documents as D
from quillon.plans.catalog import QUERIES
from tests.conftest import SMALL

CANDIDATES = "doc_id long, at long, path string, value string, confidence double"


def decoded(spark, rows, **options):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], CANDIDATES).repartition(3)
    return {r.doc_id: r for r in D.decode_documents(df, **options).collect()}.get(1)


def test_records_open_at_their_anchor(spark):
    r = decoded(spark, [("education.*.institution", "lost", 0.9), ("education.*.degree", "BSc", 0.5), ("education.*.degree", " [MSc] ", 0.7), ("education.*.institution", "Uni", 0.1), ("education.*.degree", "PhD", 0.2), ("education.*.graduation_date", "2001", None), ("education.*.graduation_date", "2002", 0.4), ("email", "x", 1.0), ("education.*.unknown", "x", 1.0), (None, "x", 1.0)])
    # the second degree joins the first; a date that comes back opens a record without an anchor, which is dropped
    assert [tuple(x) for x in r.education] == [("MSc", "", "Uni", ""), ("PhD", "", "", "2001")]
    assert r.projects == [] and r.certifications == []


def test_items_of_technologies_and_missing_addresses(spark):
    rows = [("projects.*.name", "One", 1.0), ("projects.*.technologies", "[Go, (Rust); go | ,Zig!]", 0.5), ("projects.*.name", "Two", 1.0), ("projects.*.url", "x.org/two,", 0.3), ("projects.*.name", " ", 1.0), ("projects.*.url", "y", 1.0), ("certifications.*.name", "C", 0.3), ("certifications.*.date", None, 0.3)]
    r = decoded(spark, rows)
    assert [tuple(x) for x in r.projects] == [("One", ["Go", "Rust", "Zig!"], None), ("Two", [], "x.org/two")]
    assert [tuple(x) for x in r.certifications] == [("C", "", "")]
    assert decoded(spark, rows, split=False).projects[0].technologies == ["[Go, (Rust); go | ,Zig!]"]


PREDICTION = "doc_id long, work_experience array<struct<job_title: string, company: string, start_date: string, end_date: string, duration: string>>, education array<struct<degree: string, field_of_study: string, institution: string, graduation_date: string>>, projects array<struct<name: string, technologies: array<string>, url: string>>, certifications array<struct<name: string, issuer: string, date: string>>"


def test_what_differs_is_replaced_with_an_event(spark):
    same = [("BSc", "", "Uni", "")]
    rows = [(1, [("Cook", "Inn", "", "", "2001-02 - 2003-04")], [("x", "", "", "")], None, [("C", "", "")]), (2, None, same, [], None), (3, [], None, None, None)]
    candidates = [(1, 1, "education.*.degree", "BSc", 1.0), (1, 2, "education.*.institution", "Uni", 1.0), (1, 3, "projects.*.name", "P", 1.0), (2, 1, "education.*.degree", "BSc", 1.0), (2, 2, "education.*.institution", "Uni", 1.0)]
    got = {r.doc_id: r for r in D.repair_documents(spark.createDataFrame(rows, PREDICTION), spark.createDataFrame(candidates, CANDIDATES)).collect()}
    assert tuple(got[1].work_experience[0]) == ("Cook", "Inn", "2001-02", "2003-04", "2001-02 - 2003-04")
    assert [tuple(e) for e in got[1].events] == [("work_start_date_repaired", "work_experience.*.start_date"), ("work_end_date_repaired", "work_experience.*.end_date"), ("education_anchor_redecoded", "education"), ("projects_anchor_redecoded", "projects"), ("certifications_anchor_redecoded", "certifications")]
    assert [tuple(x) for x in got[1].projects] == [("P", [], None)] and got[1].certifications is None
    # an empty list of projects becomes null, which is a change; nothing else of the second document is
    assert [e.kind for e in got[2].events] == ["projects_anchor_redecoded"] and got[2].projects is None and [tuple(x) for x in got[2].education] == same
    assert got[3].events == [] and got[3].education == []
    s = D.repair_summary(D.repair_documents(spark.createDataFrame(rows, PREDICTION), spark.createDataFrame(candidates, CANDIDATES))).first()
    assert (s.documents, s.repaired_documents, s.events["projects_anchor_redecoded"]) == (3, 2, 2)


def plain(cands, kind):
    """Records of one kind by a fold over rows in order."""
    anchor, *_ = fields = D.KIND_FIELDS[kind]
    groups = []
    for field, value, conf in cands:
        if field == anchor:
            if not groups or set(groups[-1]) - {anchor}:
                groups.append({})
        elif not groups:
            continue
        elif field in groups[-1]:
            groups.append({})
        groups[-1].setdefault(field, []).append((value, conf))
    mark = "[]{}|·,; "
    out = []
    for g in groups:
        best = {f: max(v, key=lambda x: x[1])[0] for f, v in g.items()}
        r = {f: (" ".join(best[f].split()).strip(mark) if f in best else None if f == "url" else "") for f in fields if f != "technologies"}
        if "technologies" in fields:
            seen = {}
            for p in best.get("technologies", "").strip().strip("[]{}").replace(";", ",").replace("|", ",").split(","):
                p = " ".join(p.split()).strip(mark).strip("()")
                seen.setdefault(" ".join("".join(c if c.isalnum() or c == "_" else " " for c in p.lower()).split()), p)
            r["technologies"] = [p for n, p in seen.items() if n and p]
        if r[anchor]:
            out.append({f: r[f] for f in fields if r[f] is not None})
    return out


def test_query_over_whole_orders(spark):
    part = {r.p_partkey: r for r in spark.read.parquet(f"{SMALL}/part.parquet").collect()}
    lines = sorted(spark.read.parquet(f"{SMALL}/lineitem.parquet").collect(), key=lambda r: (r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey, r.l_quantity, r.l_extendedprice))
    docs = {}
    for x in lines:
        if x.l_partkey not in part:
            continue
        p, kind = part[x.l_partkey], list(D.KIND_FIELDS)[x.l_partkey % 3]
        words = p.p_name.split(" ")
        if x.l_returnflag == "N":
            field, value = D.KIND_FIELDS[kind][0], f"{p.p_brand} {p.p_type}"
        elif x.l_returnflag == "R":
            told = f"built on {' and '.join(reversed(words))} with care and time" if x.l_linenumber % 2 == 0 else f"{p.p_name}, {p.p_brand}, {p.p_name}"
            field, value = {"education": "institution", "projects": "technologies", "certifications": "issuer"}[kind], told
        else:
            field, value = {"education": "graduation_date", "projects": "url", "certifications": "date"}[kind], f"https://x.org/{p.p_name}"
        docs.setdefault(x.l_orderkey, {}).setdefault(kind, []).append((field, value, x.l_discount))
    got = {r.doc_id: r for r in QUERIES["c11_repair_all_kinds"](spark, SMALL).collect()}
    orders = [r.o_orderkey for r in spark.read.parquet(f"{SMALL}/orders.parquet").collect()]
    assert set(got) == set(orders) and len(orders) == len(got)
    for o in orders:
        want = {k: plain(docs.get(o, {}).get(k, []), k) for k in D.KIND_FIELDS}
        r = got[o]
        assert json.loads(r.education) == want["education"], o
        assert (json.loads(r.projects) if r.projects else []) == want["projects"] and (json.loads(r.certifications) if r.certifications else []) == want["certifications"]
        events = [k + D.REDECODED for k in D.KIND_FIELDS if want[k] or (k == "projects" and o % 3 == 0)]
        assert [e for e in r.events if e.endswith(D.REDECODED)] == events
        assert ("work_end_date_repaired" in r.events) == (o % 2 == 0)


def by_definition(raws, skills):
    """Known skills by plain containment at their first place."""
    return [s for _, s in sorted({(K.normal(raws).index(K.normal(s)), s) for s in skills if K.normal(s) and K.normal(s) in K.normal(raws)})]


def test_skills_within_a_text():
    r = random.Random(2)
    for _ in range(500):
        skills = tuple("".join(r.choice("ab c+") for _ in range(r.randint(1, 5))) for _ in range(8))
        text = "".join(r.choice("ab c.") for _ in range(25))
        index = K.SkillIndex(skills)
        got = [index.value[n] for n in index.within(K.normal(text))]
        # of skills with one normal form the first by its value is known
        assert got == by_definition(text, {min(s for s in skills if s and K.normal(s) == n) for n in map(K.normal, skills) if n})


@pytest.mark.parametrize(("raws", "skills", "want"), [(["Java and Go and SQL tooling"], ["Go", "SQL", "Java"], ["Java", "Go", "SQL"]), (["api, Zig"], ["Zig", "API gateway"], ["api", "Zig"]), (["uses an app of Flask"], ["Flask", None, ""], ["Flask"]), ([None, "", "Go"], [], ["Go"]), (["Go and care"], ["Go"], ["Go"]), (["go; Go, GO"], ["Go"], ["go"])])
def test_named_technologies(raws, skills, want):
    assert K.named(raws, K.SkillIndex(tuple(skills))) == want


def test_twenty_thousand_rows_take_less_than_five_seconds(spark):
    skills = pd.Series([[f"tool {k}", f"lib{k}", "Shared Thing"] for k in range(20_000)])
    raws = pd.Series([[f"planner built with lib{k} and tool {k} and the shared thing", f"tool {k}, other"] for k in range(20_000)])
    t = time.process_time()
    got = [K.named(a, K.SkillIndex(tuple(b))) for a, b in zip(raws, skills, strict=True)]
    assert time.process_time() - t < 5 and got[7] == ["lib7", "tool 7", "Shared Thing", "other"]


def test_projects_with_known_skills(spark):
    got = QUERIES["c7_decode_projects"](spark, SMALL)
    assert got.filter(F.size("technologies") > 1).count() > 20 and got.filter("name = ''").count() == 0
    told = got.filter(F.exists("technologies", lambda x: x.contains(" and "))).count()
    assert told == 0  # enumerations are taken apart by the known skills
