"""Evaluation of predicted documents in one call: raw predictions to field results, document scores and a corpus report."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.jsonfix import parse_generated
from quillon.functions.matching import anls_score, assignment
from quillon.functions.text import strip_marks
from quillon.operators.relations import settled
from quillon.operators.sequences import joined_spans, repeated_key_sessions
from quillon.shipping import ship

# The record's fields in order; a question mark allows null and absence.
RECORD = {
    "full_name": "text", "email": "text", "location": "text", "phone": "text", "linkedin_url": "text?", "github_url": "text?", "summary": "text",
    "skills": "texts", "work_experience": "records", "education": "records", "projects": "records?", "certifications": "records?",
}
PARTS = {
    "work_experience": {"job_title": "text", "company": "text", "start_date": "text", "end_date": "text", "duration": "text"},
    "education": {"degree": "text", "field_of_study": "text", "institution": "text", "graduation_date": "text"},
    "projects": {"name": "text", "technologies": "texts", "url": "text?"},
    "certifications": {"name": "text", "issuer": "text", "date": "text"},
}
#: Records that are texts all over.
_PLAIN = {kind for kind, parts in PARTS.items() if set(parts.values()) == {"text"}}
METRICS = {"email": "exact_email", "phone": "exact_phone", "linkedin_url": "exact_url", "github_url": "exact_url", "skills": "set_f1"} | dict.fromkeys(PARTS, "hungarian_f1_quality")
ACCEPTED = 0.5
SUPPORTED = 0.5
#: Characters of the longest value whose forms and likenesses are remembered, and how many of them a worker remembers.
SHORT = 128
REMEMBERED = 1 << 16
#: Documents that leave a task as one batch.
ROWS = 2000

_NOT_WORD = re.compile(r"[^\w\s]")
_ASCII = {i: " " for i in range(128) if _NOT_WORD.match(chr(i))}


# --- values -----------------------------------------------------------------------------------


def _text(v) -> str:
    return str(v) if v else ""


def _form(make):
    """A function of a value's text, whose results for short texts are remembered."""
    short = lru_cache(REMEMBERED)(make)

    def form(v) -> str:
        s = _text(v)
        return short(s) if len(s) <= SHORT else make(s)

    return form


@_form
def normal(s: str) -> str:
    if s.isascii():
        return " ".join(s.lower().translate(_ASCII).split())
    return " ".join(_NOT_WORD.sub(" ", unicodedata.normalize("NFKC", s).casefold()).split())


@_form
def _email(s: str) -> str:
    return s.strip().casefold()


@_form
def _phone(s: str) -> str:
    """Digits, and x with an extension's digits."""
    s = s.casefold()
    ext = re.search(r"(?:ext\.?|extension|x)\s*(\d+)\s*$", s)
    digits = re.sub(r"\D", "", s[: ext.start()] if ext else s)
    return f"{digits}x{ext[1]}" if ext else digits


@_form
def _url(s: str) -> str:
    """Host in lower case without user and www., path without doubled or trailing slashes, query kept."""
    s = re.sub(r"(?i)^https?\s*:\s*/\s*/\s*|^[a-z][a-z0-9+.-]*://", "", s.strip())
    s = s.partition("#")[0]
    host, path, query = re.match(r"([^/?]*)([^?]*)(\?.+)?", s).groups()
    host = host.rpartition("@")[2].casefold().removeprefix("www.")
    return host + re.sub("/+", "/", path).rstrip("/") + (query or "")


@_form
def _date(s: str) -> str:
    s = s.strip().casefold().translate({0x2013: "-", 0x2014: "-"})
    return "present" if s in ("present", "current", "now") else "".join(s.split())


_likeness = lru_cache(REMEMBERED)(anls_score)


def _alike(a: str, b: str) -> float:
    """anls_score of two normal texts, without their common subsequence where lengths tell the result."""
    if a == b:
        return 1.0
    if not a or not b or 2.0 * min(len(a), len(b)) / (len(a) + len(b)) < 0.5:
        return 0.0
    return _likeness(a, b) if len(a) + len(b) <= SHORT else anls_score(a, b)


def _fuzzy(a, b) -> float:
    return _alike(normal(a), normal(b))


def _sets(a, b) -> dict[str, float]:
    x, y = ({n for n in map(normal, v) if n} if isinstance(v, list) else set() for v in (a, b))
    both, p, r = len(x & y), 0.0, 0.0
    p = both / len(y) if y else float(not x)
    r = both / len(x) if x else float(not y)
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0, "jaccard": both / len(x | y) if x | y else 1.0}


def _mean(values: list[float]) -> float:
    """As numpy's, which adds up fewer than eight from the left."""
    if len(values) >= 8:
        return float(np.mean(values))
    total = 0.0
    for v in values:
        total += v
    return total / len(values)


def _same(a: str, b: str) -> float:
    return 1.0 if a == b else 0.0


def _metric(field: str):
    """The form of a value of a record's field, and how alike two forms are, by the kind of field."""
    if field == "technologies":
        return lambda v: v, lambda a, b: _sets(a, b)["f1"]
    if field == "url":
        return _url, _same
    if field == "duration" or "date" in field:
        return _date, _same
    return normal, _alike


def part_score(field: str, a, b) -> float:
    """Two values of a record's field."""
    form, alike = _metric(field)
    return alike(form(a), form(b))


def matched(truth: list[dict], found: list[dict], fields) -> dict[str, float]:
    """precision, recall and f1 times quality of the accepted pairs of the best matching of two lists of records."""
    if not truth or not found:
        one = float(not truth and not found)
        return {"precision": one, "recall": one, "f1": one}
    metrics = [(f, *_metric(f)) for f in fields]
    forms = lambda records: [[form(r.get(f)) for f, form, _ in metrics] for r in records]
    alike, right = [x for _, _, x in metrics], forms(found)
    w = [[sum([like(x, y) for like, x, y in zip(alike, a, b, strict=True)]) / len(fields) for b in right] for a in forms(truth)]
    good = [w[i][j] for i, j in assignment(w) if w[i][j] >= ACCEPTED]
    f1 = 2 * len(good) / (len(truth) + len(found))
    return {"precision": len(good) / len(found), "recall": len(good) / len(truth), "f1": f1 * _mean(good) if good else 0.0}


def is_supported(value, evidence: str, words: set[str]) -> bool | None:
    """Whether a normal text holds a value, or half of its words; all parts of a list or record; null where nothing tells."""
    if isinstance(value, (list, dict)):
        known = [s for s in (is_supported(v, evidence, words) for v in (value.values() if isinstance(value, dict) else value)) if s is not None]
        return all(known) if known else None
    n = normal(value) if value is not None else ""
    if not n:
        return None
    if n in evidence:
        return True
    own = set(n.split())
    return len(own & words) >= SUPPORTED * len(own)


# --- documents --------------------------------------------------------------------------------


def schema_issues(value: dict, spec: dict[str, str], at: str = "") -> Iterator[tuple[str, str]]:
    """(kind, path) of everything that a record's form doesn't allow: fields in order, then keys it doesn't know."""
    for name, kind in spec.items():
        path, v = at + name, value.get(name)
        if name not in value or v is None:
            if not kind.endswith("?"):
                yield ("missing" if name not in value else "string_type" if kind == "text" else "list_type"), path
        elif kind.startswith("texts"):
            if not isinstance(v, list):
                yield "list_type", path
            else:
                yield from (("string_type", f"{path}.{i}") for i, x in enumerate(v) if not isinstance(x, str))
        elif kind.startswith("text"):
            if not isinstance(v, str):
                yield "string_type", path
        elif not isinstance(v, list):
            yield "list_type", path
        else:
            for i, x in enumerate(v):
                if isinstance(x, dict):
                    if x.keys() == PARTS[name].keys() and name in _PLAIN and all([type(v) is str for v in x.values()]):
                        continue
                    yield from schema_issues(x, PARTS[name], f"{path}.{i}.")
                else:
                    yield "model_type", f"{path}.{i}"
    yield from (("extra_forbidden", at + k) for k in value if k not in spec)


def _field(path: str, truth, found) -> dict:
    metric = METRICS.get(path, "anls")
    if path in PARTS:
        records = lambda v: [x for x in v if isinstance(x, dict)] if isinstance(v, list) else []
        got = matched(records(truth), records(found), tuple(PARTS[path]))
        return {"metric": metric, "score": got["f1"], **got}
    if metric == "set_f1":
        got = _sets(truth, found)
        return {"metric": metric, "score": got["f1"], **got}
    same = {"exact_email": _email, "exact_phone": _phone, "exact_url": _url}.get(metric)
    return {"metric": metric, "score": float(same(truth) == same(found)) if same else _fuzzy(truth, found)}


def evaluate_one(truth: str, raw: str | None, evidence: str | None, repair: bool = False) -> dict:
    """The evaluation of a raw prediction; a truth that isn't a record is an error."""
    want = json.loads(truth)
    if wrong := list(schema_issues(want, RECORD)):
        raise ValueError(f"truth is no record: {wrong[0]}")
    events, error = [], None
    if repair:
        text, error = parse_generated(raw)
        found = json.loads(text) if text else {}
    else:
        try:
            found = json.loads(raw or "")
            if not isinstance(found, dict):
                found, error = {}, "prediction JSON must be an object"
        except (ValueError, RecursionError) as e:
            found, error = {}, str(e)
    if error:
        events.append({"kind": "json_parse_error", "path": None, "message": error})
    issues = list(schema_issues(found, RECORD))
    events += [{"kind": k, "path": p, "message": None} for k, p in issues]
    held = normal(evidence)
    words = set(held.split())
    blank = dict.fromkeys(("precision", "recall", "f1", "jaccard"))
    fields = [{"path": p, **blank, **_field(p, want.get(p), found.get(p)), "supported": is_supported(found.get(p), held, words)} for p in RECORD]
    return {"json_valid": error is None, "schema_valid": not issues, "missing_keys": sorted(RECORD.keys() - found.keys()), "extra_keys": sorted(found.keys() - RECORD.keys()), "events": events, "fields": fields}


RESULT = (
    "json_valid boolean, schema_valid boolean, missing_keys array<string>, extra_keys array<string>, events array<struct<kind: string, path: string, message: string>>, "
    "fields array<struct<path: string, metric: string, score: double, precision: double, recall: double, f1: double, jaccard: double, supported: boolean>>"
)
_EVENT = {"kind": pa.string(), "path": pa.string(), "message": pa.string()}
_FIELD = {"path": pa.string(), "metric": pa.string(), "score": pa.float64(), "precision": pa.float64(), "recall": pa.float64(), "f1": pa.float64(), "jaccard": pa.float64(), "supported": pa.bool_()}


def _lists(rows: list[list[dict]], kinds: dict[str, pa.DataType]) -> pa.ListArray:
    """Lists of records with these fields, made column by column."""
    flat = [x for r in rows for x in r]
    items = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], kind) for k, kind in kinds.items()], list(kinds))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), items)


def evaluate_documents(rows: DataFrame, doc: str = "doc_id", truth: str = "truth", raw: str = "raw", evidence: str | None = "evidence", repair: bool = False) -> DataFrame:
    """doc, the evaluation (RESULT), and the document's macro score and share of unsupported fields.

    truth and raw are JSON texts; with `repair` a broken raw prediction counts as far as it can be read.
    A prediction that is no object, or null, counts as one without fields and has an event.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                got = [evaluate_one(t, r, e, repair) for t, r, e in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
                flags = [pa.array([g[k] for g in got], pa.bool_()) for k in ("json_valid", "schema_valid")]
                keys = [pa.array([g[k] for g in got], pa.list_(pa.string())) for k in ("missing_keys", "extra_keys")]
                nested = [_lists([g["events"] for g in got], _EVENT), _lists([g["fields"] for g in got], _FIELD)]
                yield pa.RecordBatch.from_arrays([b.column(0), *flags, *keys, *nested], [doc, "json_valid", "schema_valid", "missing_keys", "extra_keys", "events", "fields"])

    kind = rows.schema[doc].dataType.simpleString()
    text = F.col(evidence) if evidence else F.lit(None)
    asked = rows.select(doc, F.col(truth).alias("truth"), F.col(raw).alias("raw"), text.cast("string").alias("evidence"))
    out = asked.mapInArrow(run, f"{doc} {kind}, {RESULT}")
    sum_of = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    told = F.filter("fields.supported", lambda s: s.isNotNull())
    missed = F.when(F.size(told) > 0, F.size(F.filter(told, lambda s: ~s)) / F.size(told)).otherwise(0.0)
    return out.withColumns({"macro": sum_of(F.col("fields.score")) / F.size("fields"), "unsupported_rate": missed})


def corpus_report(evaluated: DataFrame) -> DataFrame:
    """One row: documents, rates of valid JSON and form, micro and macro scores, unsupported rate, events by kind, field scores."""
    one = lambda what, name, value: F.struct(F.lit(what).alias("what"), name.alias("name"), value.cast("double").alias("v"))
    own = ["json_valid", "schema_valid", "macro", "unsupported_rate"]
    score = F.aggregate("fields.score", F.lit(0.0), lambda s, x: s + x)
    told = F.concat(
        F.array(*[one("document", F.lit(c), F.col(c)) for c in own], one("document", F.lit("score"), score), one("document", F.lit("fields"), F.size("fields"))),
        F.transform("fields", lambda f: one("field", f["path"], f["score"])),
        F.transform("events", lambda e: one("event", e["kind"], F.lit(None))),
    )
    # every document is evaluated once: all that the report needs of it leaves it as rows, which are counted by name
    sums = evaluated.select(F.explode(told).alias("x")).groupBy("x.what", "x.name").agg(F.count("*").alias("n"), F.sum("x.v").alias("s"), F.avg("x.v").alias("a"))
    of = lambda name, c: F.max(F.when((F.col("what") == "document") & (F.col("name") == name), F.col(c)))
    zero = lambda c, n: F.coalesce(c, F.lit(0.0)).alias(n)
    named = lambda what, c, n, v: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("what") == what, F.struct(F.col("name").alias(n), F.col(c).alias(v)))))).alias
    return sums.agg(
        F.coalesce(of("macro", "n"), F.lit(0)).alias("documents"), zero(of("json_valid", "a"), "json_valid_rate"), zero(of("schema_valid", "a"), "schema_valid_rate"), zero(of("score", "s") / of("fields", "s"), "micro"),
        zero(of("macro", "a"), "macro"), zero(of("unsupported_rate", "a"), "unsupported_rate"), named("field", "a", "path", "s")("field_scores"), named("event", "n", "kind", "n")("events"),
    )


def evaluate_grounded(pages: DataFrame, truths: DataFrame, predictions: DataFrame, doc: str = "doc_id") -> DataFrame:
    """As evaluate_documents, for predictions (doc, raw) against the words of their pages (doc, page, words) and truths (doc, truth).

    A document's words in order of pages are its evidence; a document without a prediction counts as one without fields.
    """
    words = pages.groupBy(doc).agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "words"))), lambda p: p["words"])), " ").alias("evidence"))
    return evaluate_documents(truths.join(predictions.select(doc, "raw"), doc, "left").join(words, doc, "left"), doc)


def decode_labelled(tokens: DataFrame, doc: str = "doc_id", sessions: bool = False) -> DataFrame:
    """doc, raw: the record, as JSON, that labelled tokens (doc, at, text, field_path, record_index) spell.

    Runs of tokens with one label are values; runs of skills end after commas, semicolons and bars too. Of several values of a
    field the first counts, of technologies all. Records are told apart by their index or, with
    `sessions`, by fields that come back. Documents without labelled tokens have an empty record.
    """
    before = Window.partitionBy(doc).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ends = (F.col("field_path") == "skills") & F.col("text").rlike(r"[,;|]$")
    cut = tokens.withColumn("__cut", F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)))
    spans = joined_spans(cut, [doc], "at", ["field_path", "record_index", "__cut"], "text").filter("field_path IS NOT NULL")
    parts = F.split("field_path", r"\.\*\.", 2)
    spans = spans.select(doc, "first", parts[0].alias("kind"), F.get(parts, F.lit(1)).alias("field"), "record_index", strip_marks(F.col("text")).alias("value"))
    nested = spans.filter("field IS NOT NULL")
    if sessions:
        nested = repeated_key_sessions(nested, [doc, "kind"], "first", "field", keep=("value",)).withColumnsRenamed({"at": "first", "grp": "idx"})
    else:
        nested = nested.withColumn("idx", F.col("record_index"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("first", F.col("value").alias("v")))), lambda x: x["v"]).alias(c)
    values = nested.groupBy(doc, "kind", "idx", "field").agg(in_order("v")).groupBy(doc, "kind", "idx").agg(F.map_from_entries(F.collect_list(F.struct("field", "v"))).alias("f"))
    none, of = F.array().cast("array<string>"), lambda m, k: F.try_element_at(m, F.lit(k))

    def record(kind: str, m: Column) -> Column:
        one = lambda f, form: F.coalesce(of(m, f), none) if form == "texts" else F.coalesce(of(m, f)[0], F.lit(None if form.endswith("?") else ""))
        return F.struct(*[one(f, form).alias(f) for f, form in PARTS[kind].items()])

    records = values.groupBy(doc).agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("idx", F.map_entries("f").alias("e"))))).alias(k) for k in PARTS])
    flat = spans.filter("field IS NULL").groupBy(doc, "kind").agg(in_order("v")).groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("kind", "v"))).alias("__flat"))
    j = tokens.select(doc).distinct().join(flat, doc, "left").join(records, doc, "left")
    fields = []
    for name, form in RECORD.items():
        if name in PARTS:
            made = F.transform(F.col(name), _typed(record, name))
            made = F.coalesce(made, F.array().cast(_kind(name)))
            fields.append((F.when(F.size(made) > 0, made) if form.endswith("?") else made).alias(name))
        elif form == "texts":
            fields.append(F.array_distinct(F.coalesce(of(F.col("__flat"), name), none)).alias(name))
        else:
            fields.append(F.coalesce(of(F.col("__flat"), name)[0], F.lit(None if form.endswith("?") else "")).alias(name))
    return j.select(doc, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("raw"))


def _typed(record, kind: str):
    return lambda x: record(kind, F.map_from_entries(x["e"]))


def _kind(name: str) -> str:
    return f"array<struct<{', '.join(f'{f}: array<string>' if form == 'texts' else f'{f}: string' for f, form in PARTS[name].items())}>>"


def record_oracle(tokens: DataFrame, truths: DataFrame, doc: str = "doc_id", sessions: bool = False) -> DataFrame:
    """Evaluation of what labelled tokens spell, against truths (doc, truth) and with the tokens as evidence: how far labels alone carry."""
    tokens = settled(tokens)  # they are read several times, and may be dear to make
    words = tokens.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("evidence"))
    return evaluate_documents(truths.join(decode_labelled(tokens, doc, sessions), doc).join(words, doc), doc)


def compare_predictions(left: DataFrame, right: DataFrame, doc: str = "doc_id", field: str = "work_experience") -> DataFrame:
    """doc and the differences of two evaluations of the same documents: macro score and one field's; unequal sets of documents raise."""
    from quillon.operators.relations import strict_join

    one = lambda df, n: df.select(doc, F.col("macro").alias(f"{n}_macro"), F.filter("fields", lambda f: f["path"] == field)[0]["score"].alias(f"{n}_field"))
    j = strict_join(one(left, "left"), one(right, "right"), doc)
    return j.withColumns({"macro_delta": F.col("right_macro") - F.col("left_macro"), "field_delta": F.col("right_field") - F.col("left_field")})
