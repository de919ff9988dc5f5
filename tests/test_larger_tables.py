"""Steps whose cost must not outgrow the input: nothing joined to itself, computed once a value, or read whole by a task."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from quillon.functions import matching as X
from quillon.functions import sets as S
from quillon.operators import documents as D
from quillon.operators.relations import dealt
from quillon.plans.catalog import QUERIES
from quillon.sources import files as FS
from tests.conftest import SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_are_decoded_without_a_join(spark):
    rows = [(1, 1, "projects.*.name", "A", 0.5), (1, 2, "projects.*.url", "u", 0.1), (1, 3, "projects.*.name", "B", 0.5), (None, 1, "projects.*.name", "C", 0.5)]
    c = spark.createDataFrame(rows, "doc_id long, at int, path string, value string, confidence double")
    got = D.decode_documents(c)
    assert "Join" not in _plan(got)
    assert [(r.doc_id, [p.name for p in r.projects], [p.url for p in r.projects]) for r in got.collect()] == [(1, ["A", "B"], ["u", None])]


def test_record_oracle_joins_once(spark):
    assert _plan(QUERIES["c5_record_oracle"](spark, SMALL)).count("Join ") == 1


def test_evidence_is_normalized_once(spark):
    row = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.concat(F.lit("Word"), i.cast("string"))).alias("v"))
    row = row.withColumn("e", F.array_join(F.flatten(F.array_repeat(F.col("v"), 20)), " - "))
    start = time.time()
    assert row.select(X.all_supported(F.col("v"), F.col("e")).alias("s")).first().s is True
    assert time.time() - start < 20


def test_multisets_of_long_texts(spark):
    row = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: (i * 7919 % 15_000).cast("string")).alias("x"))
    start = time.time()
    assert row.select(S.multiset_f1(F.col("x"), F.reverse("x")).alias("f")).first().f == 1.0
    assert time.time() - start < 20
    got = spark.sql("SELECT array('b', 'a', 'b', 'c') AS x, array() AS e").select(S.counts(F.col("x")).alias("x"), S.counts(F.col("e").cast("array<string>")).alias("e")).first()
    assert got.x == {"a": 1, "b": 2, "c": 1} and got.e == {}


def test_neighbours_over_ranges(spark, tmp_path):
    rows = [(i, f"w{i} common", None if i % 5 == 0 else "one" if i % 5 else "x") for i in range(400)] + [(1000, "z", "two")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.a, r.b, r.jaccard) for r in QUERIES["a60_pair_jaccard"](spark, str(tmp_path)).collect())
    held = [i for i in range(400) if i % 5]
    assert got == [(a, b, 0.333333) for a, b in zip(held, held[1:], strict=False)]


def test_parts_are_merged_up_to_a_size(spark):
    parts, whole = FS.shared_folder(spark, "parts"), FS.shared_folder(spark, "whole")
    FS.write_parts(spark.range(5000), parts, 4)
    rows = spark.read.schema("id bigint").json(parts)
    n = FS.merge_parts(rows, parts, whole, most=20_000)
    back = spark.read.schema("id bigint").json(whole)
    assert n > 1 and back.select("_metadata.file_path").distinct().count() > 1 and sorted(r.id for r in back.collect()) == list(range(5000))
    assert FS.merge_parts(rows, parts, FS.shared_folder(spark, "whole")) == 1


def test_tasks_of_dealt_rows_are_bounded(spark):
    assert dealt(spark.range(1000), "id", most=100).rdd.getNumPartitions() >= 10
    assert dealt(spark.range(1000), "id", most=1000).rdd.getNumPartitions() == spark.range(1000).rdd.getNumPartitions()


def test_labelled_tokens_are_made_once(spark):
    from quillon.operators import evaluation as V
    from tests.test_evaluation import ADA

    import json

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    tokens = spark.createDataFrame([(1, 0, "Ada", "full_name", None), (1, 1, "x", None, None)], "doc_id long, at long, text string, field_path string, record_index int")
    truths = spark.createDataFrame([(1, json.dumps(ADA))], "doc_id long, truth string")
    assert V.record_oracle(tokens.mapInArrow(count, tokens.schema), truths).count() == 1
    assert made.value == 2
