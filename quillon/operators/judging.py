"""Judged answers: questions in batches, answers merged back in order, scores by rubric; and records as texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of the batches that a judge is asked in.
BATCHES = (8, 7)
#: How much of a record its text has.
MOST_SKILLS, MOST_JOBS, MOST_TOOLS, MOST_CHARACTERS, MOST_SCHOOLS, MOST_CERTIFICATES = 12, 3, 6, 120, 1, 4

ITEM = "struct<question: string, satisfied: boolean, reasoning: string>"


def question_batches(records: DataFrame, key: str, questions: str, sizes: tuple[int, ...] = BATCHES) -> DataFrame:
    """key, batch (from 0) and its questions: as many as `sizes` says, in order; what is left over is a batch more."""
    ends, at = [], 0
    for n in sizes:
        ends.append(F.struct(F.lit(at + 1).alias("a"), F.lit(n).alias("n")))
        at += n
    rest = F.when(F.size(questions) > at, F.array(F.struct(F.lit(at + 1).alias("a"), (F.size(questions) - at).alias("n")))).otherwise(F.array().cast("array<struct<a: int, n: int>>"))
    parts = F.transform(F.concat(F.array(*ends), rest), lambda x: F.slice(questions, x["a"], x["n"]))
    return records.select(key, F.posexplode(F.filter(parts, lambda p: F.size(p) > 0)).alias("batch", "questions"))


def merged_items(batches: Column) -> Column:
    """Items of a document's batches in order: one a question, where it was first asked, with the last answer; blank questions dropped."""
    items = F.filter(F.flatten(batches), lambda x: F.coalesce(x["question"], F.lit("")) != "")
    names = F.transform(items, lambda x: x["question"])
    return F.transform(F.array_distinct(names), lambda q: F.element_at(F.filter(items, lambda x: x["question"] == q), -1))


def judged_variants(records: DataFrame, answers: DataFrame, key: str, questions: str, variants: str) -> DataFrame:
    """key, variant, score, yes_count, no_count, total_questions, evaluations of the judge's answers.

    records: questions (array) and variants (map of name to text); answers: key, variant, batch, items
    (ITEM). Variants without a text and those that no record has are passed over; a later answer to a
    question replaces an earlier one in its place; the score is the share of yes among all questions asked.
    """
    asked = records.filter(F.size(questions) > 0).select(key, F.size(questions).cast("bigint").alias("total"), F.explode(F.map_filter(variants, lambda k, v: F.trim(v) != "")).alias("variant", "text"))
    parts = answers.filter(F.size("items") > 0).groupBy(key, "variant").agg(F.array_sort(F.collect_list(F.struct("batch", F.col("items").cast(f"array<{ITEM}>").alias("items")))).alias("b"))
    merged = merged_items(F.transform("b", lambda x: x["items"]))
    j = asked.join(parts, [key, "variant"]).select(key, "variant", "total", merged.alias("evaluations")).filter(F.size("evaluations") > 0)
    yes = F.size(F.filter("evaluations", lambda x: F.coalesce(x["satisfied"], F.lit(False)))).cast("bigint")
    return j.select(key, "variant", (yes / F.col("total")).alias("score"), yes.alias("yes_count"), F.greatest(F.lit(0), F.col("total") - yes).alias("no_count"), F.col("total").alias("total_questions"), "evaluations")


def record_text(r: Column) -> Column:
    """A nested record as lines: name, place, level, summary, skills, jobs, school and certificates, each only if it is there."""
    text = lambda f: F.coalesce(r[f].cast("string"), F.lit(""))
    line = lambda given, *parts: F.when(given, F.concat(*parts))
    none = F.array().cast("array<string>")
    of = lambda x, f: F.coalesce(x[f], F.lit(""))
    skills = F.transform(F.slice(r["skills"], 1, MOST_SKILLS), lambda s: F.concat(s["skill_name"], F.lit(" ("), of(s, "proficiency"), F.lit(")")))

    def job(x: Column) -> Column:
        tools = F.array_join(F.slice(F.coalesce(x["technologies"], none), 1, MOST_TOOLS), ", ")
        about = F.substring(of(x, "description"), 1, MOST_CHARACTERS)
        return F.concat(F.lit("  "), of(x, "job_title"), F.lit(" @ "), of(x, "company"), F.when(tools != "", F.concat(F.lit(" ["), tools, F.lit("]"))).otherwise(""), F.when(about != "", F.concat(F.lit(": "), about)).otherwise(""))

    school = lambda x: line((of(x, "degree") != "") & (of(x, "institution") != ""), F.lit("Education: "), of(x, "degree"), F.lit(" in "), of(x, "field_of_study"), F.lit(" — "), of(x, "institution"))
    head = F.array(
        line(text("full_name") != "", F.lit("Name: "), text("full_name")),
        line(text("location") != "", F.lit("Location: "), text("location")),
        line((text("seniority_level") != "") | (text("years_of_experience") != ""), F.lit("Seniority: "), text("seniority_level"), F.lit(" | Experience: "), text("years_of_experience"), F.lit(" years")),
        line(text("summary") != "", F.lit("Summary: "), text("summary")),
        line(F.size(r["skills"]) > 0, F.lit("Skills: "), F.array_join(skills, ", ")),
    )
    tail = F.array(line(F.size(r["certifications"]) > 0, F.lit("Certifications: "), F.array_join(F.slice(r["certifications"], 1, MOST_CERTIFICATES), ", ")))
    middle = [F.coalesce(F.transform(F.slice(r["work_experience"], 1, MOST_JOBS), job), none), F.coalesce(F.transform(F.slice(r["education"], 1, MOST_SCHOOLS), school), none)]
    return F.array_join(F.array_compact(F.concat(head, *middle, tail)), "\n")
