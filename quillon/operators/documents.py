"""Whole predicted documents: records of every kind decoded from candidates by their anchors, repaired with events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import normalize_text, strip_marks
from quillon.operators.records import EVENTS, repair_work
from quillon.operators.sequences import anchored_groups

# The fields of each kind, the anchor first.
KIND_FIELDS = {
    "education": ("degree", "field_of_study", "institution", "graduation_date"),
    "projects": ("name", "technologies", "url"),
    "certifications": ("name", "issuer", "date"),
}
WORK_PATHS = ("work_experience.*.start_date", "work_experience.*.end_date", "work_experience.*.duration")
REDECODED = "_anchor_redecoded"
#: Kinds that are null, not empty, where a document has none.
NULL_IF_NONE = ("projects", "certifications")


def listed(raw: Column) -> Column:
    """Items between commas, semicolons and bars, each once by its normal form, blanks dropped."""
    items = F.transform(F.split(F.btrim(F.trim(raw), F.lit("[]{}")), r"[,;|]"), lambda x: F.btrim(strip_marks(x), F.lit("()")))
    some = F.filter(items, lambda x: (x != "") & (normalize_text(x) != ""))
    norms = F.transform(some, normalize_text)
    return F.filter(some, lambda x, i: F.array_position(norms, normalize_text(x)) == i + 1)


def _record(kind: str, fields: Column, split: bool) -> Column:
    at = lambda f: F.try_element_at(fields, F.lit(f))

    def value(f: str) -> Column:
        if f == "technologies":
            return F.coalesce(listed(at(f)) if split else F.when(at(f).isNotNull(), F.array(at(f))), F.array().cast("array<string>"))
        return strip_marks(at(f)) if f == "url" else F.coalesce(strip_marks(at(f)), F.lit(""))

    return F.struct(*[value(f).alias(f) for f in KIND_FIELDS[kind]])


def _empty(kind: str) -> Column:
    fields = ", ".join(f"{f}: {'array<string>' if f == 'technologies' else 'string'}" for f in KIND_FIELDS[kind])
    return F.array().cast(f"array<struct<{fields}>>")


def decode_documents(candidates: DataFrame, doc: str = "doc_id", split: bool = True) -> DataFrame:
    """doc and an array of records of each kind, from candidates (doc, at, path, value, confidence).

    Candidates of a kind are taken in their order: its anchor begins a record once the one before has
    another field, and so does any field that comes back; what stands before the first anchor is left
    out. Of several anchors the most confident counts, the first among equals; records without an anchor are dropped.
    Technologies are split into items unless `split` is off.
    """
    parts = F.split("path", r"\.\*\.", 2)
    c = candidates.select(F.col(doc), F.col("at"), parts[0].alias("kind"), F.get(parts, F.lit(1)).alias("field"), "value", "confidence")
    fits = F.lit(False)
    for kind, fields in KIND_FIELDS.items():
        fits = fits | ((F.col("kind") == kind) & F.col("field").isin(*fields))
    anchors = F.create_map(*[F.lit(x) for kind, fields in KIND_FIELDS.items() for x in (kind, fields[0])])
    c = c.filter(F.col(doc).isNotNull() & F.coalesce(fits, F.lit(False)))
    marked = c.withColumn("f", F.when(F.col("field") == anchors[F.col("kind")], F.lit("*")).otherwise(F.col("field")))
    # candidates go through the fold with their values: nothing is read twice or joined to itself
    groups = anchored_groups(marked, [doc, "kind"], "at", "f", "*", keep=("confidence", "value")).withColumn("field", F.when(F.col("field") == "*", anchors[F.col("kind")]).otherwise(F.col("field")))
    best = groups.groupBy(doc, "kind", "grp", "field").agg(F.max_by("value", F.struct("confidence", (-F.col("at")).alias("o"))).alias("value"))
    fields = best.groupBy(doc, "kind", "grp").agg(F.map_from_entries(F.collect_list(F.struct("field", F.coalesce("value", F.lit("")).alias("value")))).alias("fields"))
    per = fields.groupBy(doc, "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("grp", F.map_entries("fields").alias("e")))), lambda x: F.map_from_entries(x["e"])).alias("groups"))

    def records(kind: str) -> Column:
        made = F.filter(F.transform(F.first(F.when(F.col("kind") == kind, F.col("groups")), ignorenulls=True), lambda g: _record(kind, g, split)), lambda r: r[KIND_FIELDS[kind][0]] != "")
        return F.coalesce(made, _empty(kind)).alias(kind)

    return per.groupBy(doc).agg(*[records(k) for k in KIND_FIELDS])


def repair_documents(predictions: DataFrame, candidates: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, work_experience, education, projects, certifications and events (kind, path) of each prediction.

    Work records are repaired each; the other kinds are decoded anew from the candidates and replace
    what was predicted where they differ, with one event a kind. Documents without candidates have no such records.
    """
    decoded = decode_documents(candidates, doc).select(doc, *[F.col(k).alias(f"__{k}") for k in KIND_FIELDS])
    j = predictions.join(decoded, doc, "left")
    j = j.withColumn("__work", F.transform("work_experience", repair_work))
    work_paths = F.create_map(*[F.lit(x) for e, p in zip(EVENTS, WORK_PATHS, strict=True) for x in (e, p)])
    event = lambda kind, path: F.struct(kind.alias("kind"), path.alias("path"))
    none = F.array().cast("array<struct<kind: string, path: string>>")
    events = [F.coalesce(F.transform(F.flatten(F.transform("__work", lambda w: w["events"])), lambda e: event(e, work_paths[e])), none)]
    columns = {"work_experience": F.transform("__work", lambda w: w["record"])}
    for kind in KIND_FIELDS:
        new = F.coalesce(f"__{kind}", _empty(kind))
        new = F.when(F.size(new) > 0, new) if kind in NULL_IF_NONE else new
        old = F.col(kind) if kind in NULL_IF_NONE else F.coalesce(F.col(kind), _empty(kind))
        events.append(F.when(~new.eqNullSafe(old), F.array(event(F.lit(kind + REDECODED), F.lit(kind)))).otherwise(none))
        columns[kind] = new
    return j.select(doc, *[c.alias(k) for k, c in columns.items()], F.concat(*events).alias("events"))


def repair_summary(repaired: DataFrame) -> DataFrame:
    """One row: documents, repaired_documents and a map of event counts by kind."""
    totals = repaired.agg(F.count("*").alias("documents"), F.count_if(F.size("events") > 0).alias("repaired_documents"))
    kinds = repaired.select(F.explode("events.kind").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
    counts = kinds.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("events"))
    return totals.join(F.broadcast(counts))  # one row each
