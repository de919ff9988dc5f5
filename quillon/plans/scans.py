"""Reading and writing files, and incremental runs, each as a round trip of driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.sources import files as S
from quillon.streaming import incremental as I
from quillon.plans.registry import Tables, query


@query("SELECT doc_id, text, lang FROM documents")
def s1_jsonl_strict(t: Tables):
    path = S.shared_folder(t.spark, "jsonl")
    t.documents.select("doc_id", "text", "lang").write.json(path)
    return S.read_jsonl(t.spark, path, "doc_id bigint, text string, lang string")


@query("SELECT event_id, user_id FROM events WHERE event_id % 11 <> 0")
def s3_jsonl_lenient(t: Tables):
    """Every eleventh line is cut off, and dropped on reading."""
    path = S.shared_folder(t.spark, "lenient")
    line = F.to_json(F.struct("event_id", "user_id"))
    t.events.select(F.when(F.col("event_id") % 11 == 0, F.substring(line, 1, 5)).otherwise(line).alias("value")).write.text(path)
    return S.read_jsonl_lenient(t.spark, path, "event_id bigint, user_id bigint").select("event_id", "user_id")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id END AS user_id FROM events WHERE event_id % 3 <> 0")
def s4_required_keys(t: Tables):
    """Rows of three folders whose objects hold both keys; a null value counts as held."""
    a, b = S.shared_folder(t.spark, "keys-a"), S.shared_folder(t.spark, "keys-b")
    keep = t.events.filter("event_id % 3 <> 0").select(F.to_json(F.struct("event_id", F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("user_id")), {"ignoreNullFields": "false"}).alias("value"))
    keep.write.text(a)
    t.events.filter("event_id % 3 = 0").select(F.to_json(F.struct("event_id")).alias("value")).write.text(b)
    return S.read_required(t.spark, [a, b], ["event_id", "user_id"], "event_id bigint, user_id bigint")


@query("SELECT n_name AS name, n_nationkey::VARCHAR AS code FROM nation UNION ALL SELECT r_name, r_regionkey::VARCHAR FROM region")
def s5_csv_union(t: Tables):
    """Files whose header lacks a column are passed over."""
    one, two, three = (S.shared_folder(t.spark, f"csv-{i}") for i in "abc")
    put = lambda df, path: df.write.option("header", True).option("escape", '"').csv(path)
    put(t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("code"), F.lit(1).alias("more")), one)
    put(t.region.select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("name")), two)
    put(t.supplier.select(F.col("s_name").alias("name")), three)
    return S.read_csv_union(t.spark, [one, two, three], ["name", "code"])


@query("SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, text FROM conversations")
def s6_csv_quoted(t: Tables):
    """Quotes, commas and line feeds survive."""
    path = S.shared_folder(t.spark, "quoted")
    t.conversations.select("conv_id", "turn", "text").write.option("header", True).option("escape", '"').csv(path)
    return t.spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


@query("SELECT doc_id, n_chars FROM documents")
def s7_parquet_pruned(t: Tables):
    return t.documents.select("doc_id", "n_chars")


@query("SELECT vec_id, label FROM embeddings UNION ALL SELECT vec_id, label FROM embeddings")
def s9_concatenated_splits(t: Tables):
    return t.embeddings.select("vec_id", "label").unionAll(t.embeddings.select("vec_id", "label"))


@query()
def s12_tree_digests(t: Tables):
    """Key, kind, size and digest of every file of a written tree."""
    path = S.shared_folder(t.spark, "tree")
    t.nation.repartition(4, "n_regionkey").write.partitionBy("n_regionkey").json(path)
    files = S.read_tree(t.spark, path, r"n_regionkey=(\d+)/")
    return files.filter("kind = 'json'").groupBy("key").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max(F.length("sha256")).alias("digest_length"))


@query("SELECT n_regionkey::VARCHAR AS key, 1::BIGINT AS files FROM nation GROUP BY 1")
def s11_pages_by_key(t: Tables):
    path = S.shared_folder(t.spark, "pages")
    t.nation.repartition(1).write.partitionBy("n_regionkey").json(path)
    files = S.read_tree(t.spark, path, r"n_regionkey=(\d+)/", content=False).filter("kind = 'json'")
    return S.pages_by_key(files).select("key", "files")


@query("SELECT doc_id, CASE WHEN trim(coalesce(CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE text END, '')) = '' THEN source ELSE trim(text) END AS body FROM documents")
def s16_fallback_text(t: Tables):
    first = F.when(F.col("doc_id") % 4 == 0, F.lit(" ")).otherwise(F.col("text"))
    return t.documents.select("doc_id", S.fallback_text(first, F.col("source")).alias("body"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def s18_table_scan(t: Tables):
    return t.customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_acctbal")


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A_%'")
def s19_like(t: Tables):
    return t.part.filter(F.col("p_type").like("%A_%")).select("p_partkey", "p_type")


@query("SELECT n_nationkey::INT + 1 AS number, n_name AS item FROM nation")
def s21_numbered_list(t: Tables):
    path = S.shared_folder(t.spark, "list")
    lines = t.nation.select(F.concat(F.col("n_nationkey") + 1, F.lit(". "), "n_name").alias("value"))
    lines.union(t.region.select(F.concat(F.lit("# "), "r_name"))).write.text(path)
    return S.read_numbered(t.spark, path)


@query("SELECT region.r_regionkey, r_name FROM region")
def s22_fresh_cache(t: Tables):
    path = S.shared_folder(t.spark, "cache")
    t.region.select("r_regionkey", "r_name").write.json(path)
    return S.read_fresh(t.spark, path, 3600).select("r_regionkey", "r_name")


@query("SELECT n_name AS name, n_regionkey AS region, NULL::VARCHAR AS note FROM nation UNION ALL SELECT r_name, NULL, 'top' FROM region")
def s24_union_by_name(t: Tables):
    a = t.nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    b = t.region.select(F.col("r_name").alias("name"), F.lit("top").alias("note"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def k2_append(t: Tables):
    path = S.shared_folder(t.spark, "append")
    cols = t.orders.select("o_orderkey", "o_orderstatus")
    S.append(cols, path, "parquet")
    S.append(cols.filter("o_orderstatus = 'F'"), path, "parquet")
    return t.spark.read.parquet(path)


@query("SELECT count(*) AS rows, 5::BIGINT AS parts FROM events")
def k4_round_robin_parts(t: Tables):
    path = S.shared_folder(t.spark, "parts")
    S.write_parts(t.events.select("event_id"), path, 5)
    back = t.spark.read.schema("event_id bigint").json(path).select("event_id", F.col("_metadata.file_name").alias("f"))
    return back.agg(F.count("*").alias("rows"), F.count_distinct("f").alias("parts"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def t1_resume(t: Tables):
    """A resumable run: what is done already is left out, the rest is appended once, run twice."""
    path = S.shared_folder(t.spark, "resume")
    work = t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id", "lang")
    I.resume(work, path, ["doc_id"])
    I.resume(work, path, ["doc_id"])
    return t.spark.read.parquet(path)


@query("SELECT DISTINCT event_type, user_id FROM events")
def t2_stateful_dedup(t: Tables):
    """A stream of files, each key let through once over all micro-batches."""
    return I.deduplicated(t.spark, t.events.select("event_type", "user_id"), ["event_type", "user_id"])


@query("SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'failed' ELSE 'completed' END AS status FROM events")
def t3_failure_rows(t: Tables):
    """Rows that can't be processed are kept with their status, so that no run tries them again."""
    return I.with_status(t.events.select("event_id"), F.col("event_id") % 13 != 0)


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def t4_daily_stream(t: Tables):
    """Daily totals by micro-batches of files, with a watermark."""
    return I.daily_totals(t.spark, t.events.select("event_id", "ts", "event_type", "value"))
