"""Project records, schema coercion and the alignment of annotations to tokens."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.skills import technologies
from quillon.functions.text import normalize_text, slug, strip_marks
from quillon.operators.records import best_values
from quillon.operators.sequences import anchored_groups
from quillon.shipping import ship


def decode_anchored(candidates: DataFrame, doc: str, at: str, field: str, value: str, confidence: str, anchor: str) -> DataFrame:
    """doc, grp, fields (map of field to its most confident value) of the records that have an anchor."""
    groups = anchored_groups(candidates.select(doc, at, field), [doc], at, field, anchor)
    keyed = candidates.join(groups.select(F.col(doc), F.col("at").alias(at), "grp"), [doc, at])
    best = best_values(keyed, [doc, "grp", field], value, confidence, at)
    records = best.groupBy(doc, "grp").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, value)))).alias("fields"))
    return records.filter(F.coalesce(F.try_element_at("fields", F.lit(anchor)), F.lit("")) != "")


def replace_aligned(current: Column, decoded: Column, name: str = "name", take: str = "technologies") -> Column:
    """Decoded values of one field, where both lists of records agree one to one by normal name; else the current list."""
    same = (F.size(current) == F.size(decoded)) & F.forall(F.zip_with(current, decoded, lambda a, b: normalize_text(a[name]) == normalize_text(b[name])), lambda x: F.coalesce(x, F.lit(False)))
    merged = F.zip_with(current, decoded, lambda a, b: a.withField(take, F.when(F.size(b[take]) > 0, b[take]).otherwise(a[take])))
    return F.when(same, merged).otherwise(current)


def smoothed_back_off(train: DataFrame, rows: DataFrame, full: list[str], reduced: list[str], label: str, least: int = 8, name: str = "p") -> DataFrame:
    """rows with the smoothed share of label 1 in their full bucket, in the reduced one where the first is small, else null."""
    stat = lambda keys, n: train.groupBy(*keys).agg(F.sum(label).alias(f"__y{n}"), F.count(label).alias(f"__n{n}"))
    j = rows.join(stat(full, 1), full, "left").join(stat(reduced, 2), reduced, "left")
    share = lambda n: F.when(F.col(f"__n{n}") >= least, (F.col(f"__y{n}") + 1) / (F.col(f"__n{n}") + 2))
    return j.withColumn(name, F.coalesce(share(1), share(2))).drop("__y1", "__n1", "__y2", "__n2")


def filled_url(url: Column, name: Column, owner: Column, p: Column, least: float = 0.45) -> Column:
    """A missing project address from owner and name, where such projects mostly have one."""
    made = F.concat(F.lit("https://github.com/"), owner, F.lit("/"), slug(name))
    return F.when((F.coalesce(url, F.lit("")) == "") & (F.coalesce(name, F.lit("")) != "") & owner.isNotNull() & (p >= least), made).otherwise(url)


def coerce(raw: Column, required: list[str], optional: list[str], lists: list[str]) -> tuple[Column, Column]:
    """A record with the given fields from a JSON object, and the events of what had to be changed."""
    v = F.try_parse_json(raw)
    at = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    kind = lambda k: F.coalesce(F.schema_of_variant(at(k)), F.lit("VOID"))
    text = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    events = [F.when(kind(k) != "STRING", F.lit(f"required_string_coerced:{k}")) for k in required]
    events += [F.when(~kind(k).isin("STRING", "VOID"), F.lit(f"optional_string_coerced:{k}")) for k in optional]
    events += [F.when(~kind(k).startswith("ARRAY") & (kind(k) != "VOID"), F.lit(f"list_coerced:{k}")) for k in lists]
    known = F.array(*[F.lit(k) for k in [*required, *optional, *lists]])
    extra = F.transform(F.array_sort(F.array_except(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), known)), lambda k: F.concat(F.lit("extra_key_removed:"), k))
    record = F.struct(
        *[F.coalesce(text(k), F.lit("")).alias(k) for k in required],
        *[F.nullif(text(k), F.lit("")).alias(k) for k in optional],
        *[F.filter(F.transform(F.coalesce(F.try_variant_get(v, f"$.{k}", "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")).alias(k) for k in lists],
    )
    return record, F.concat(F.array_compact(F.array(*events)), extra)


_NOT_WORD = re.compile(r"[^\w\s]")


def _normal(s: str | None) -> str:
    return " ".join(_NOT_WORD.sub(" ", (s or "").lower()).split())


def align(tokens: DataFrame, annotations: DataFrame, doc: str = "doc_id", at: str = "at", text: str = "text", order: str = "ord", label: str = "label") -> DataFrame:
    """doc, at, label: tokens that spell an annotation, taken in order of the annotations, each token once.

    Rows of a partition stand in order of document, its tokens first; a document's tokens are
    looked up by the normal form of their first word, so an annotation tries only places that begin like it.
    """
    ship(tokens.sparkSession)
    a = tokens.select(F.col(doc).cast("long").alias("d"), F.lit(0).alias("k"), F.col(at).cast("long").alias("i"), F.col(text).alias("t"), F.lit(None).cast("string").alias("l"))
    b = annotations.select(F.col(doc).cast("long"), F.lit(1), F.col(order).cast("long"), F.col(text), F.col(label))
    rows = a.union(b).repartition("d").sortWithinPartitions("d", "k", "i")
    return rows.mapInArrow(lambda it: _aligned(it, doc), f"{doc} bigint, at bigint, label string")


def _aligned(batches, doc: str):
    now, places, words, starts, used = None, [], [], {}, set()

    def match(want: list[str]) -> list[int] | None:
        for s in starts.get(want[0], ()):
            got, i, taken = [], s, []
            while i < len(words) and i not in used and len(got) < len(want):
                got += words[i]
                taken.append(i)
                i += 1
            if got == want:
                return taken
        return None

    for batch in batches:
        out: list[list] = [[], [], []]
        for d, k, i, t, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if d != now:
                now, places, words, starts, used = d, [], [], {}, set()
            if k == 0:
                w = _normal(t).split()
                if w:
                    starts.setdefault(w[0], []).append(len(words))
                places.append(i)
                words.append(w)
                continue
            want = _normal(t).split()
            hit = match(want) if want else None
            for j in hit or ():
                used.add(j)
                for col, v in zip(out, (d, places[j], label), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], [doc, "at", "label"])

