"""Units of pages and fields laid over them: known answers, and a plain form over whole conversations."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.operators import evidence as E
from quillon.plans.catalog import QUERIES
from tests.conftest import SMALL


def real(x):
    return [real(y) for y in x] if isinstance(x, list) else None if x is None else float(x)


def page(*lines, size=(100.0, 100.0), number=1, table=None):
    table = table and {"cells": real(table["cells"]), "extract": table["extract"]}
    return {"page_number": number, "width": size[0], "height": size[1], "boxes": [{"textlines": [{"spans": [{"text": t, "bbox": real(b)} for t, b in spans], "bbox": real(box)} for spans, box in lines], "table": table}]}


def read(spark, *pages):
    df = spark.createDataFrame([(1, list(pages))], f"doc_id bigint, pages {E.PAGES}")
    return [(r.page, r.text, r.box) for r in E.units(df).orderBy("at").collect()]


def test_words_in_reading_order_with_boxes(spark):
    got = read(spark, page(([("Ada Byron", [10, 20, 50, 40])], None), size=(100.0, 200.0)), page(([("next", [0, 0, 10, 10])], None), number=2))
    assert got == [(1, "Ada", [100, 100, 233, 200]), (1, "Byron", [278, 100, 500, 200]), (2, "next", [0, 0, 100, 100])]


def test_words_split_over_spans_and_wide_gaps(spark):
    spans = [("M", [0, 0, 5, 10]), ("arie C", [6, 0, 45, 10]), ("urie", [46, 0, 80, 10]), ("Paris", [90, 0, 99, 10])]
    assert [w for _, w, _ in read(spark, page((spans, [0, 0, 80, 10])))] == ["Marie", "Curie", "Paris"]


def test_table_cells_without_lines(spark):
    p = page(table={"cells": [[[0, 0, 50, 20], [50, 0, 100, 20]], [None, [50, 20, 100, 40]]], "extract": [["Blue Works", "1999"], ["lost", None]]})
    p["boxes"][0]["textlines"] = None
    assert read(spark, p) == [(1, "Blue", [0, 0, 200, 200]), (1, "Works", [250, 0, 500, 200]), (1, "1999", [500, 0, 1000, 200])]


def test_odd_pages(spark):
    bare = {"page_number": None, "width": 10.0, "height": 10.0, "boxes": None}
    assert read(spark, bare) == [] and read(spark) == []
    numbered = page(([("x", [0, -5, 99, 5])], None), size=(10.0, 10.0), number=None)
    assert read(spark, bare, numbered) == [(2, "x", [0, 0, 1000, 500])]
    with pytest.raises(Exception, match="positive"):
        read(spark, page(size=(0.0, 10.0)))


@pytest.mark.parametrize(("path", "field", "index"), [("contact_info.email", "email", None), ("skills.3", "skills", None), ("skills.3.skill_name", "skills", None), ("education.2.degree", "education.*.degree", 2), ("projects.1.technologies.2", "projects.*.technologies", 1), ("", None, None), (None, None, None)])
def test_field_of_a_path(spark, path, field, index):
    r = spark.createDataFrame([(path,)], "p string").select(E.field_of(F.col("p")).alias("x")).first().x
    assert (r.field_path, r.record_index) == (field, index)


def test_annotations_of_a_record(spark):
    kind = "t struct<email: string, full_name: string, skills: array<string>, projects: array<struct<name: string, technologies: array<string>, url: string>>>"
    df = spark.createDataFrame([(({"full_name": "Ada", "email": " ", "skills": ["a", None, "b"], "projects": [{"name": "P", "technologies": ["x", "y"], "url": None}, {"name": None, "technologies": None, "url": "u"}]}),), (None,)], kind)
    got = [[tuple(a) for a in r.a] if r.a is not None else None for r in df.select(E.truth_annotations("t", df.schema["t"].dataType).alias("a")).collect()]
    assert got[0] == [("full_name", "Ada", None), ("skills.0.skill_name", "a", "skills"), ("skills.2.skill_name", "b", "skills"), ("projects.0.name", "P", None), ("projects.0.technologies.0", "x", "projects.0.technologies"), ("projects.0.technologies.1", "y", "projects.0.technologies"), ("projects.1.url", "u", None)]
    assert got[1] == []


def laid(spark, text, *passes, labels=()):
    words = [(1, i, 1, w, *(dict(labels).get(i, (None, None)))) for i, w in enumerate(text.split())]
    tokens = spark.createDataFrame(words, "doc_id bigint, at bigint, page int, text string, field_path string, record_index int")
    notes = [spark.createDataFrame([(1, n, *a, *[None] * (4 - len(a))) for n, a in enumerate(p)], "doc_id bigint, ord int, path string, text string, page int, grp string") for p in passes]
    return sorted((r.at, r.field_path, r.record_index) for r in E.align_fields(tokens, notes).collect())


def test_equal_values_take_following_places(spark):
    got = laid(spark, "Cook Blue Cook Red", [("work_experience.0.job_title", "cook"), ("work_experience.1.job_title", "Cook", 1), ("work_experience.2.job_title", "Cook")])
    assert got == [(0, "work_experience.*.job_title", 0), (2, "work_experience.*.job_title", 1)]


def test_several_words_with_punctuation(spark):
    got = laid(spark, "· ada@x.org Head of R & D , now", [("contact_info.email", "ada@x.org"), ("summary", "head of R&D"), ("location", "of"), ("phone", "·")])
    assert got == [(1, "email", None), (2, "summary", None), (3, "summary", None), (4, "summary", None), (5, "summary", None), (6, "summary", None)]


def test_no_token_has_two_fields_and_no_value_is_placed_twice(spark):
    assert laid(spark, "Python", [("summary", "Python")], labels=[(0, ("skills", None))]) == [(0, "skills", None)]
    twice = [("work_experience.0.company", "Acme")]
    assert laid(spark, "Acme Cook Acme", twice, twice) == [(0, "work_experience.*.company", 0)]
    # the second pass takes what the first has left
    assert laid(spark, "red fox den red", [("full_name", "red fox")], [("location", "fox den"), ("email", "red")]) == [(0, "full_name", None), (1, "full_name", None), (3, "email", None)]


def test_groups_are_laid_close_together(spark):
    skills = [(f"skills.{i}", s, None, "skills") for i, s in enumerate(["Rust", "Go", "Type Script"])]
    assert [a for a, _, _ in laid(spark, "Rust is old Go Lists : Rust Go Type Script", skills)] == [6, 7, 8, 9]
    assert [a for a, _, _ in laid(spark, "Go then Rust", skills)] == [0]


def test_spans_stay_on_their_page(spark):
    tokens = spark.createDataFrame([(1, 0, 1, "a"), (1, 1, 2, "b"), (1, 2, 2, "a"), (1, 3, 2, "b"), (None, 0, 1, "a")], "doc_id bigint, at bigint, page int, text string")
    notes = spark.createDataFrame([(1, 0, "summary", "a b", None, None), (2, 0, "summary", "a", None, None), (1, 1, "email", "a", 2, None)], "doc_id bigint, ord int, path string, text string, page int, grp string")
    assert sorted((r.at, r.field_path) for r in E.align_fields(tokens, [notes]).collect()) == [(2, "summary"), (3, "summary")]
    assert E.align_fields(tokens.limit(0), [notes.limit(0)]).count() == 0


def plain(tokens, passes):
    """By definition: an annotation that isn't there yet takes the first range of free units of a page whose joined normal text is its own."""
    norm = lambda s: " ".join(re.sub(r"[^\w\s]", " ", s.casefold()).split())
    label = [None] * len(tokens)
    for p in passes:
        for field, text in p:
            if norm(text) in norm(" ".join(t for (_, t), x in zip(tokens, label, strict=True) if x == field)):
                continue
            ranges = ((a, b) for a in range(len(tokens)) if norm(tokens[a][1]) for b in range(a, min(len(tokens), a + 12)) if tokens[a][0] == tokens[b][0] and not any(label[a : b + 1]) and norm(" ".join(t for _, t in tokens[a : b + 1])) == norm(text))
            if hit := next(ranges, None):
                label[hit[0] : hit[1] + 1] = [field] * (hit[1] - hit[0] + 1)
    return label


def test_equals_its_definition(spark):
    r, docs, notes, want = random.Random(5), [], ([], []), []
    for d in range(60):
        words = [(1 + i // 15, r.choice(["a", "b", "c", "a-b", "·", "B.", "d"])) for i in range(30)]
        passes = [[(f"f{r.randrange(4)}", " ".join(r.choice("abcd") for _ in range(r.randint(1, 3)))) for _ in range(6)] for _ in range(2)]
        docs += [(d, i, p, t) for i, (p, t) in enumerate(words)]
        for n, p in enumerate(passes):
            notes[n].extend((d, i, f, t) for i, (f, t) in enumerate(p))
        want += [(d, i, f) for i, f in enumerate(plain(words, passes)) if f]
    tokens = spark.createDataFrame(docs, "doc_id bigint, at bigint, page int, text string").repartition(3)
    got = E.align_fields(tokens, [spark.createDataFrame(n, "doc_id bigint, ord int, path string, text string") for n in notes])
    assert sorted((x.doc_id, x.at, x.field_path) for x in got.collect()) == want


def test_query_over_whole_conversations(spark):
    got = QUERIES["c22_evidence_graphs"](spark, SMALL).collect()
    turns = {}
    for r in sorted(spark.read.parquet(f"{SMALL}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append((r.turn, r.text or ""))
    want = {}
    for conv, ts in turns.items():
        tokens = [(turn + 1, w) for turn, t in ts for w in t.split()]
        first = [(("work_experience.*.job_title", turn), " ".join(t.split()[:3])) for turn, t in ts]
        second = [(("full_name", None), " ".join(ts[0][1].split()[2:4]))] + [x for turn, t in ts for x in ((("work_experience.*.job_title", turn), " ".join(t.split()[:3])), (("work_experience.*.company", turn), " ".join(t.split()[1:4])), (("work_experience.*.duration", turn), " ".join(t.split()[4:6])))]
        label = plain(tokens, [first, [(f, t) for f, t in second if t]])
        for f in {x for x in label if x}:
            want[conv, f[0], f[1]] = (sum(x == f for x in label), " ".join(t for (_, t), x in zip(tokens, label, strict=True) if x == f))
    assert {(r.conv_id, r.field_path, r.record_index): (r.units, r.text) for r in got} == want and len(want) > 100


def test_words_of_a_long_line_are_placed_once(spark):
    import time

    n = 3000
    start = time.time()
    got = read(spark, page(([(" ".join(["abc"] * n), [0, 0, 4 * n - 1, 10])], None), size=(4.0 * n, 10.0)))
    assert len(got) == n and got[0][2] == [0, 0, 0, 1000] and got[-1] == (1, "abc", [1000, 0, 1000, 1000])
    assert time.time() - start < 20
