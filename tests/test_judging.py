"""Judged variants, records as texts, and split files with faults."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.operators import judging as J
from quillon.operators import splits as SP

ANSWERS = f"id int, variant string, batch int, items array<{J.ITEM}>"


def test_batches_of_eight_and_seven(spark):
    d = spark.createDataFrame([(n, [f"q{i}" for i in range(n)]) for n in (0, 3, 8, 15, 17)] + [(99, None)], "id int, q array<string>")
    got = {}
    for r in J.question_batches(d, "id", "q").collect():
        got.setdefault(r.id, {})[r.batch] = r.questions
    assert {k: [len(v[b]) for b in sorted(v)] for k, v in got.items()} == {3: [3], 8: [8], 15: [8, 7], 17: [8, 7, 2]} and got[17][2] == ["q15", "q16"]


def test_answers_are_merged_in_order_and_scored(spark):
    records = spark.createDataFrame([(1, ["a", "b", "c", "d"], {"good": "x", "bad": "y", "blank": " "}), (2, [], {"good": "x"}), (3, ["a"], None)], "id int, q array<string>, v map<string, string>")
    rows = [(1, "good", 1, [("b", True, "late"), ("c", True, None)]), (1, "good", 0, [("a", True, ""), ("b", False, "early"), ("", True, ""), (None, True, "")]), (1, "blank", 0, [("a", True, "")]), (1, "other", 0, [("a", True, "")]), (1, "bad", 0, [("a", None, "")]), (1, "bad", 1, None), (2, "good", 0, [("a", True, "")])]
    got = {r.variant: r for r in J.judged_variants(records, spark.createDataFrame(rows, ANSWERS), "id", "q", "v").collect()}
    assert set(got) == {"good", "bad"}
    assert [(e.question, e.satisfied, e.reasoning) for e in got["good"].evaluations] == [("a", True, ""), ("b", True, "late"), ("c", True, None)]
    assert (got["good"].score, got["good"].yes_count, got["good"].no_count, got["good"].total_questions) == (0.75, 3, 1, 4)
    assert (got["bad"].score, got["bad"].no_count) == (0.0, 4)


RECORD = "full_name string, location string, seniority_level string, years_of_experience int, summary string, skills array<struct<skill_name: string, proficiency: string>>, work_experience array<struct<job_title: string, company: string, description: string, technologies: array<string>>>, education array<struct<degree: string, field_of_study: string, institution: string>>, certifications array<string>"


def test_records_as_texts(spark):
    jobs = [("Cook", "Inn", "d" * 200, [f"t{i}" for i in range(9)]), ("Chef", None, None, None), ("Host", "Bar", "", []), ("Late", "X", "", [])]
    full = ("Ada", "London", "senior", 7, "First", [(f"s{i}", "high" if i else None) for i in range(14)], jobs, [("BSc", "Maths", "Uni"), ("MSc", "", "Uni")], ["c1", "c2", "c3", "c4", "c5"])
    bare = ("", None, "", None, None, None, [], [("BSc", "Maths", "")], [])
    got = [r.x for r in spark.createDataFrame([full, bare], RECORD).select(J.record_text(F.struct("*")).alias("x")).collect()]
    assert got[0].split("\n") == [
        "Name: Ada", "Location: London", "Seniority: senior | Experience: 7 years", "Summary: First", "Skills: s0 (), " + ", ".join(f"s{i} (high)" for i in range(1, 12)),
        f"  Cook @ Inn [t0, t1, t2, t3, t4, t5]: {'d' * 120}", "  Chef @ ", "  Host @ Bar", "Education: BSc in Maths — Uni", "Certifications: c1, c2, c3, c4",
    ]
    assert got[1] == ""


SCHEMA = "id long, tier string, template string"


def write(folder, **files):
    for name, lines in files.items():
        (folder / f"{name}.jsonl").write_text("\n".join(lines))


def line(i, tier="T1", template="a"):
    return f'{{"id": {i}, "tier": "{tier}", "template": "{template}"}}'


def sound():
    """Ten documents: eight working in four parts, two locked."""
    parts = {"train": range(4), "validation": [4], "id_test": [5], "template_ood_test": [6, 7], "debug_50": [0], "debug_250": [0, 1], "working": range(8), "locked_confirmation": [8, 9], "completed": range(10)}
    return {n: [line(i, template="held" if i in (6, 7) else "a") for i in ids] for n, ids in parts.items()}


def issues(spark, folder, **expected):
    rows, broken = SP.read_splits(spark, str(folder), SCHEMA, "id")
    return sorted((r.issue, r.part, r.n) for r in broken.unionByName(SP.validate_splits(rows, "id", "tier", "template", **expected)).collect())


def test_sound_files_have_no_issues(spark, tmp_path):
    write(tmp_path, **sound())
    assert issues(spark, tmp_path, ood={"held": 2}, tiers={"T1": 8}, sizes={n: len(v) for n, v in sound().items()}) == []


def test_one_missing_one_cut_off_and_one_good_file(spark, tmp_path):
    files = sound()
    del files["id_test"]
    files["validation"] = [files["validation"][0][:20]]
    files["train"] = ["", *files["train"], "  "]
    write(tmp_path, **files)
    assert issues(spark, tmp_path) == [("corrupt_file", "validation", 1), ("missing_file", "id_test", 1), ("not_partitioned", "working", 2)]


@pytest.mark.parametrize(("bad", "n"), [("[1]", 1), ('{"tier": "T1"}', 1), ("word", 1)])
def test_lines_that_are_no_rows(spark, tmp_path, bad, n):
    write(tmp_path, **(sound() | {"debug_50": [line(0), bad]}))
    assert issues(spark, tmp_path) == [("corrupt_file", "debug_50", n)]


def test_every_rule(spark, tmp_path):
    files = sound()
    files["validation"].append(line(0))  # in train too
    files["locked_confirmation"].append(line(3))  # working too
    files["completed"].append(line(77))  # in no part
    files["debug_50"].append(line(9))  # not of train
    files["train"].append(line(50, template="held"))  # held out, and not working
    write(tmp_path, **files)
    got = issues(spark, tmp_path, ood={"held": 3, "other": 1}, tiers={"T1": 7, "T2": 1}, sizes={"train": 5, "validation": 1})
    assert [x for x in got if x[0] not in ("size", "tier_quota", "template_quota")] == [("held_out_template", "train", 1), ("not_partitioned", "completed", 1), ("not_partitioned", "working", 1), ("not_subset", "debug_50", 1), ("overlap", "train+validation", 1), ("overlap", "working+locked_confirmation", 1)]
    assert [x for x in got if x[0] in ("tier_quota", "template_quota")] == [("template_quota", "held", 2), ("template_quota", "other", 0), ("tier_quota", "T1", 8), ("tier_quota", "T2", 0)]
    assert ("size", "validation", 2) in got and ("size", "train", 5) not in got
