"""Nested records: repair, merging, features, assembly, routing, coding, validation, alignment."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import squeeze, stable_hash, strip_marks
from quillon.operators.relations import quotas
from quillon.operators.selection import cut_by_hash
from quillon.shipping import ship

WORK = ("job_title", "company", "start_date", "end_date", "duration")

# Fixed values.
MARKS = "[]{}|·,; "
PRESENT = r"(?i)\b(?:present|current|now)\b"
MONTH = r"\b(?:19|20)\d{2}(?:-\d{2})?\b"
GENERIC_TITLES = ("developer", "engineer", "designer", "analyst", "architect", "scientist", "manager", "tester")
EVENTS = ("work_start_date_repaired", "work_end_date_repaired", "work_duration_normalized")
MCQ_REFUSALS = ("as an ai", "i cannot", "i'm sorry")
ESSAY_REFUSALS = ("as an ai", "i cannot", "i'm sorry", "i don't have personal")
RUBRIC_REFUSALS = ("as an ai", "i cannot generate", "i'm sorry")


def _clean(c: Column) -> Column:
    return strip_marks(F.coalesce(c, F.lit("")), MARKS)


def _present(c: Column) -> Column:
    d = F.btrim(_clean(c), F.lit("()"))
    return F.when(d.rlike(r"^(?i)(?:present|current|now)$"), "Present").otherwise(d)


def repair_work(r: Column) -> Column:
    """A work record with dates filled from its duration and the duration rebuilt, and the events that tell so."""
    start0, end0, dur0 = _present(r["start_date"]), _present(r["end_date"]), _clean(r["duration"])
    hints = F.regexp_extract_all(dur0, F.lit(MONTH), F.lit(0))
    first = F.coalesce(F.get(hints, F.lit(0)), F.lit(""))
    last = F.when(dur0.rlike(PRESENT), "Present").when(F.size(hints) >= 2, F.element_at(hints, -1)).otherwise("")
    start = F.when(start0 == "", first).otherwise(start0)
    inferred = F.when(last != "", last).when((start != "") & (first != "") & (first != start), first).otherwise("")
    end = F.when(end0 == "", inferred).otherwise(end0)
    whole = F.concat(start, F.lit(" - "), end)
    both = (start != "") & (end != "")
    events = F.array_compact(
        F.array(
            F.when((start0 == "") & (first != ""), EVENTS[0]),
            F.when((end0 == "") & (inferred != ""), EVENTS[1]),
            F.when(both & (dur0 != whole), EVENTS[2]),
        )
    )
    record = F.struct(_clean(r["job_title"]).alias("job_title"), _clean(r["company"]).alias("company"), start.alias("start_date"), end.alias("end_date"), F.when(both, whole).otherwise(dur0).alias("duration"))
    return F.struct(record.alias("record"), events.alias("events"))


def merge_work(rows: Column) -> Column:
    """An ordered array of work records with neighbours that are parts of one record put together.

    A row is taken into the one before it where it has no title of its own or the same title, and
    fills something; or where it only completes a title whose record lacks a company.
    """
    filled = ("company", "start_date", "end_date", "duration")

    def struct(values: dict[str, Column]) -> Column:
        return F.struct(*[values[k].alias(k) for k in WORK])

    def step(acc: Column, x: Column) -> Column:
        p = F.element_at(acc, -1)
        title, new = F.lower(p["job_title"]), F.lower(x["job_title"])
        fills = F.lit(False)
        for k in filled:
            fills = fills | ((p[k] == "") & (x[k] != ""))
        part = (title != "") & ((new == "") | (new == title)) & fills
        completes = (title != "") & (new != "") & new.isin(*GENERIC_TITLES) & (p["start_date"] != "") & (x["company"] != "") & (x["end_date"] != "") & (p["company"] == "")
        one = struct({"job_title": p["job_title"]} | {k: F.when(p[k] == "", x[k]).otherwise(p[k]) for k in filled})
        two = struct({"job_title": F.concat(p["job_title"], F.lit(" "), x["job_title"]), "company": x["company"], "start_date": p["start_date"], "end_date": x["end_date"], "duration": F.when(x["duration"] == "", p["duration"]).otherwise(x["duration"])})
        head = F.slice(acc, F.lit(1), F.size(acc) - 1)
        put = lambda r: F.concat(head, F.array(repair_work(r)["record"]))
        add = F.concat(acc, F.array(x))
        return F.when(F.size(acc) == 0, F.array(x)).when(part & (new == ""), put(one)).when(completes, put(two)).when(part, put(one)).otherwise(add)

    text = "struct<" + ",".join(f"{k}:string" for k in WORK) + ">"
    merged = F.aggregate(F.transform(rows, lambda r: struct({k: F.coalesce(r[k], F.lit("")) for k in WORK}).cast(text)), F.array().cast(f"array<{text}>"), lambda a, x: step(a, x).cast(f"array<{text}>"))
    return F.filter(merged, lambda r: r["job_title"] != "")


def work_features(records: Column) -> dict[str, Column]:
    """Counts of an array of work records: complete (four fields and more), partial, without title or company, dated, odd."""
    r = F.coalesce(records, F.expr("array()").cast("array<struct<" + ",".join(f"{k}:string" for k in WORK) + ">>"))
    has = lambda x, k: (F.coalesce(x[k], F.lit("")) != "").cast("int")
    filled = lambda x: sum((has(x, k) for k in WORK[1:]), has(x, WORK[0]))
    name = lambda x: F.trim(F.concat_ws(" ", x["job_title"], x["company"]))
    count = lambda test: F.size(F.filter(r, test))
    return {
        "record_count": F.size(r),
        "complete": count(lambda x: filled(x) >= 4),
        "partial": count(lambda x: filled(x).between(1, 3)),
        "empty_title": count(lambda x: has(x, "job_title") == 0),
        "empty_company": count(lambda x: has(x, "company") == 0),
        "has_dates": count(lambda x: has(x, "start_date") + has(x, "end_date") + has(x, "duration") > 0),
        "suspicious": count(lambda x: name(x).rlike(r"[^A-Za-z0-9 .,&+/#()\-–—]")) + count(lambda x: name(x).rlike(r"[a-z][A-Z]|[A-Z]{2,}[a-z]{2,}[A-Z]{2,}")),
    }


def accept(baseline: Column, other: Column) -> Column:
    """The other records are taken if strictly more of them are complete."""
    return work_features(other)["complete"] > work_features(baseline)["complete"]


def best_values(candidates: DataFrame, keys: list[str], value: str, confidence: str, order: str) -> DataFrame:
    """The value of the highest confidence for each key, the first among equals."""
    w = Window.partitionBy(*keys).orderBy(F.col(confidence).desc(), F.col(order))
    return candidates.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(*keys, F.btrim(F.trim(value), F.lit(MARKS)).alias(value))


def assemble(candidates: DataFrame, doc: str, kind: str, index: str, field: str, value: str, confidence: str, order: str) -> DataFrame:
    """doc, kind, records: an array of (index, fields map), by three groupings of which each partially aggregates."""
    best = best_values(candidates.filter(F.col(index).isNotNull()), [doc, kind, index, field], value, confidence, order)
    fields = best.groupBy(doc, kind, index).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, value)))).alias("fields"))
    return fields.groupBy(doc, kind).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("index"), F.map_entries("fields").alias("fields")))).alias("records"))


def field_scores(rows: DataFrame, doc: str) -> DataFrame:
    """Document and corpus scores of long rows (doc, field, score, supported)."""
    missed = F.coalesce(F.avg((~F.col("supported")).cast("int")), F.lit(0.0))
    return rows.groupBy(doc).agg(F.avg("score").alias("macro"), F.sum("score").alias("total"), F.count("*").alias("fields"), missed.alias("unsupported_rate"))


def corpus_scores(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("documents"), (F.sum("total") / F.sum("fields")).alias("micro"), F.avg("macro").alias("macro"), F.avg("unsupported_rate").alias("unsupported_rate"))


def route(field: str, disagrees: Column, first: Column, second: Column) -> Column:
    """Whether a field goes to the specialist when both results are known."""
    if field == "work_experience":
        return disagrees & (first == second)
    if field == "certifications":
        return disagrees & (first > 0) & (first != second)
    raise ValueError(f"no route for {field}")


def route_primary_only(field: str, count: Column, characters: Column, supported: Column, most: int = 383) -> Column:
    """Whether a field goes to the specialist, from the first result alone."""
    if field == "work_experience":
        return supported & (characters <= most)
    if field == "certifications":
        return supported & (count > 0)
    raise ValueError(f"no route for {field}")


def to_rows(records: Column, fields: tuple[str, ...]) -> Column:
    """Records as positional rows."""
    return F.transform(records, lambda r: F.array(*[F.coalesce(r[k].cast("string"), F.lit("")) for k in fields]))


def from_rows(rows: Column, fields: tuple[str, ...]) -> Column:
    """Positional rows as records: short rows are padded, long ones cut."""
    return F.transform(rows, lambda r: F.struct(*[F.coalesce(F.get(r, F.lit(i)), F.lit("")).alias(k) for i, k in enumerate(fields)]))


def valid_mcq(scenario: Column, question: Column, choices: Column, answer: Column) -> Column:
    """Long enough, no refusal, four distinct choices, and an answer that the question's end doesn't give away."""
    s, q, a = F.trim(scenario), F.trim(question), F.trim(answer)
    c = F.transform(choices, lambda x: F.lower(F.trim(x)))
    both = F.lower(F.concat(s, F.lit(" "), q))
    refused = F.lit(False)
    for p in MCQ_REFUSALS:
        refused = refused | both.contains(p)
    given = (F.length(a) > 4) & F.lower(q).endswith(F.concat(F.lower(a), F.lit("?")))
    return (F.length(s) >= 10) & (F.length(q) >= 5) & ~refused & (F.size(c) == 4) & ~F.array_contains(c, "") & (F.size(F.array_distinct(c)) == 4) & (a != "") & ~given


def valid_essay(scenario: Column, question: Column, answer: Column) -> Column:
    s, q, a = F.trim(scenario), F.trim(question), F.trim(answer)
    refused = F.lit(False)
    for p in ESSAY_REFUSALS:
        refused = refused | F.lower(a).contains(p)
    repeats = (F.lower(a) == F.lower(q)) | F.substring(F.lower(a), F.lit(1), F.length(q) + 10).contains(F.lower(q))
    return (F.length(s) >= 10) & (F.length(q) >= 5) & (F.length(a) >= 10) & ~refused & ~repeats


def valid_rubric(description: Column, questions: Column) -> Column:
    """Four fifths of at least five questions are well formed and unlike each other."""
    d = F.trim(description)
    refused = F.lit(False)
    for p in RUBRIC_REFUSALS:
        refused = refused | F.lower(d).contains(p)
    trimmed = F.transform(questions, lambda q: F.trim(q))
    good = F.array_distinct(F.transform(F.filter(trimmed, lambda q: q.endswith("?") & F.length(q).between(10, 200) & ~F.lower(q).contains("as an ai")), lambda q: F.lower(q)))
    return (F.length(d) >= 20) & ~refused & (F.size(questions) >= 5) & (F.size(good) >= F.size(questions) * 0.8)


def carve(df: DataFrame, key: str, strata: list[str], quota: int, salt: str, into: str, where: Column, column: str = "split") -> DataFrame:
    """Rows without a split that satisfy `where`: a balanced choice of `quota` gets the split `into`."""
    s = df.filter(F.col(column).isNull() & where).select(F.col(key).alias("__k"), F.concat_ws("\x1f", *strata).alias("__s"))
    sizes = s.groupBy("__s").agg(F.count("*").alias("w"))
    q = quotas(sizes, "w", quota, "__s").select("__s", "quota")
    cuts = q.select("__s", F.lit(1).alias("cut"), F.col("quota").alias("k"))
    chosen = cut_by_hash(s, "__k", ["__s"], stable_hash(F.col("__k"), seed=salt), cuts).filter("cut IS NOT NULL").select("__k", F.lit(True).alias("__in"))
    joined = df.join(chosen, F.col(key) == F.col("__k"), "left")
    return joined.withColumn(column, F.when(F.col("__in"), F.lit(into)).otherwise(F.col(column))).drop("__k", "__in")


def constrained_groups(rows: DataFrame, pairs: DataFrame, doc: str, at: str, field: str, least: float = 0.5) -> DataFrame:
    """doc, at, grp: positions joined by likely pairs (doc, a, b, p), unless a group would hold a field twice.

    Pairs are thresholded before they are dealt out by document; the rows of a partition stand in
    order of document, and each document's few positions are joined as its last row passes.
    """
    ship(rows.sparkSession)
    links = pairs.filter(F.col("p") >= least).select(doc, F.lit(None).cast("string").alias("f"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    both = rows.select(doc, F.col(field).alias("f"), F.col(at).cast("long").alias("a"), F.lit(None).cast("long").alias("b")).union(links)
    dealt = both.repartition(doc).sortWithinPartitions(doc, F.col("b").isNotNull(), "a", "b")
    return dealt.mapInArrow(lambda batches: _joined(batches, doc), f"{doc} bigint, at bigint, grp int")


def _joined(batches, doc: str):
    """Groups of each document from its rows: positions with their fields first, then pairs in order."""
    now, up, fields = None, {}, {}

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    def groups(out: list[list]) -> None:
        order = {r: i for i, r in enumerate(sorted({top(a) for a in up}))}
        for a in up:
            for col, v in zip(out, (now, a, order[top(a)]), strict=True):
                col.append(v)

    def batch_of(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], [doc, "at", "grp"])

    for batch in batches:
        out: list[list] = [[], [], []]
        for d, f, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if d != now:
                groups(out)
                now, up, fields = d, {}, {}
            if b is None:
                up[a] = a
                fields.setdefault(a, set()).add(f)
                continue
            if a not in up or b not in up:
                continue
            x, y = sorted((top(a), top(b)))
            if x != y and not fields[x] & fields[y]:
                up[y] = x
                fields[x] |= fields[y]
        yield batch_of(out)
    out = [[], [], []]
    groups(out)
    yield batch_of(out)


def spread_words(text: Column, x0: Column, x1: Column) -> Column:
    """Words of a span with their shares of its width, by characters."""
    kind = "array<struct<word:string,start:int,stop:int>>"

    def step(acc: Column, w: Column) -> Column:
        begin = F.coalesce(F.get(acc, F.size(acc) - 1)["stop"] + 1, F.lit(0))
        return F.concat(acc, F.array(F.struct(w.alias("word"), begin.alias("start"), (begin + F.length(w)).alias("stop")))).cast(kind)

    words = F.filter(F.split(squeeze(text), " "), lambda w: w != "")
    placed = F.aggregate(words, F.array().cast(kind), step)
    n = F.greatest(F.length(squeeze(text)), F.lit(1))
    return F.transform(placed, lambda p: F.struct(p["word"].alias("word"), F.bround(x0 + (x1 - x0) * p["start"] / n).cast("long").alias("x0"), F.bround(x0 + (x1 - x0) * p["stop"] / n).cast("long").alias("x1")))
