"""What a router sees of predicted fields, and the requests of the fields that it sends on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quillon.functions.matching import all_supported


def json_length(value: Column) -> Column:
    """Characters of an array or object as JSON without blanks, where all but printable ASCII is escaped."""
    text = F.to_json(value, {"ignoreNullFields": "false"})
    escaped, pairs = F.length(F.regexp_replace(text, r"[\x00-\x7e]", "")), F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))
    return F.length(text) + 5 * escaped + 6 * pairs


def field_features(first: Column, second: Column, evidence: Column, fields: tuple[str, ...]) -> dict[str, Column]:
    """Features of a field whose value is an array of records of these fields, of two results.

    Characters are those of the first result as JSON with a blank after each comma and colon. It is
    supported if the evidence holds every value in it; without any value it is not. A null is an
    empty array.
    """
    n = F.coalesce(F.size(first), F.lit(0))
    blanks = F.when(n > 0, 2 * n * len(fields) - 1).otherwise(0)
    values = F.flatten(F.transform(first, lambda r: F.array(*[r[k].cast("string") for k in fields])))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    return {
        "disagrees": ~((empty(first) & empty(second)) | first.eqNullSafe(second)),
        "primary_count": n,
        "specialist_count": F.coalesce(F.size(second), F.lit(0)),
        "primary_characters": F.coalesce(json_length(first) + blanks, F.lit(2)),
        "primary_supported": F.coalesce(all_supported(values, evidence), F.lit(False)),
    }


def focused_requests(rows: DataFrame, requests: DataFrame, key: str, routes: dict[str, Column], schemas: dict[str, tuple[str, ...]]) -> DataFrame:
    """The requests of documents with a routed field: routed_fields, and schema with those fields alone.

    A routed document without a request is an error; documents without a routed field go before the join.
    """
    routed = F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in routes.items()]))
    schema = F.create_map(*[x for f in routes for x in (F.lit(f), F.array(*[F.lit(k) for k in schemas[f]]))])
    sent = rows.select(key, routed.alias("routed_fields")).filter(F.size("routed_fields") > 0)
    joined = sent.join(requests.withColumn("__asked", F.lit(True)), key, "left")
    known = F.when(F.col("__asked").isNull(), F.raise_error(F.concat(F.lit("no request of "), F.col(key).cast("string")))).otherwise(F.col("routed_fields"))
    return joined.withColumn("routed_fields", known).withColumn("schema", F.map_filter(schema, lambda f, _: F.array_contains("routed_fields", f))).drop("__asked")


def primary_features(rows: DataFrame, key: str, fields: tuple[str, ...], latency: str, tokens: str, truncated: str) -> DataFrame:
    """Long rows (key, field) with six features of the first result alone. A repeated id is an error.

    Arrays count their members, other values count one unless null or ''. Characters are those of
    the value as JSON without blanks; null counts four.
    """
    n = F.count("*").over(Window.partitionBy(key))
    once = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("duplicate id "), F.col(key).cast("string")))).otherwise(F.col(key))

    def features(f: str) -> Column:
        v = F.col(f)
        if isinstance(rows.schema[f].dataType, ArrayType):
            count, size = F.coalesce(F.size(v), F.lit(0)), json_length(v)
        else:
            count, size = F.coalesce((v.cast("string") != "").cast("int"), F.lit(0)), F.when(v.isNotNull(), json_length(F.array(v)) - 2)
        return F.struct(
            F.lit(f).alias("field"), count.alias("primary_count"), F.coalesce(size, F.lit(4)).alias("primary_characters"), (count == 0).alias("primary_empty"),
            F.coalesce(F.col(latency).cast("double"), F.lit(0.0)).alias("primary_latency_seconds"), F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("primary_output_tokens"),
            F.coalesce(F.col(truncated), F.lit(False)).alias("primary_truncated"),
        )

    checked = rows.withColumn("__n", n).withColumn(key, once)
    return checked.select(key, F.explode(F.array(*[features(f) for f in fields])).alias("x")).select(key, "x.*")
