"""Join and store queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import relations as R
from quillon.plans.registry import Tables, query


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def j8_dimension_lookup(t: Tables):
    """Inner lookup that fails if a row has no match."""
    j = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    name = F.when(F.col("r_name").isNull(), F.raise_error(F.lit("no region")).cast("string")).otherwise(F.col("r_name"))
    return j.select("n_nationkey", "n_name", name.alias("r_name"))


@query("SELECT doc_id, n_chars, length(text)::BIGINT AS counted FROM documents")
def j1_strict_join(t: Tables):
    """Both sides hold the same ids once each, or the join raises."""
    return R.strict_join(t.documents.select("doc_id", "n_chars"), t.documents.select("doc_id", F.length("text").cast("long").alias("counted")), "doc_id")


@query("SELECT o_orderkey, o_totalprice, q FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def j4_inner_partial(t: Tables):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_totalprice", "q")


@query("SELECT user_id, max_by(value, event_id) AS latest, max(event_id) AS at FROM events GROUP BY 1")
def j3_last_wins(t: Tables):
    return R.last_wins(t.events, ["user_id"], F.col("event_id")).select("user_id", F.col("value").alias("latest"), F.col("event_id").alias("at"))


@query("SELECT doc_id, coalesce(quality, -1)::BIGINT AS quality, coalesce(toxic, 0)::BIGINT AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def j5_left_overlay(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).cast("long").alias("quality"), F.coalesce("toxic", F.lit(0)).cast("long").alias("toxic"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def j6_pending(t: Tables):
    return R.pending(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"])


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def j7_existing(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT o_custkey, o_orderstatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def j9_grouped_join(t: Tables):
    j = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT a.conv_id, a.turn, a.role, b.role AS next_role FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS i FROM conversations) a JOIN (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS i FROM conversations) b ON b.i = a.i + 1")
def j10_positional_join(t: Tables):
    """Row i beside row i + 1 of the same global order."""
    n = R.numbered(t.conversations.select("conv_id", "turn", "role"), [F.col("conv_id"), F.col("turn")])
    nxt = n.select((F.col("id") - 1).alias("id"), F.col("role").alias("next_role"))
    return n.join(nxt, "id").select("conv_id", "turn", "role", "next_role")


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def j11_index_lookup(t: Tables):
    """Every probe row keeps its duplicates."""
    return t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region WHERE n_regionkey <> r_regionkey OR n_nationkey % 2 = 0")
def j12_plan_of_pairs(t: Tables):
    """All pairs of two dimensions of fixed size, filtered."""
    return t.nation.crossJoin(F.broadcast(t.region)).filter("n_regionkey <> r_regionkey OR n_nationkey % 2 = 0").select("n_name", "r_name")


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations")
def j17_adjacent(t: Tables):
    return t.conversations.select("conv_id", "turn", "role", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"))


@query(
    """WITH s AS (SELECT doc_id, n_chars AS v, 1 AS shard FROM documents UNION ALL SELECT doc_id, -n_chars, 2 FROM documents WHERE lang = 'de')
    SELECT d.doc_id, max_by(v, shard) AS v FROM documents d JOIN s USING (doc_id) GROUP BY 1"""
)
def j18_shard_merge(t: Tables):
    """Later shards replace earlier ones, then requests fetch their rows."""
    a = t.documents.select("doc_id", F.col("n_chars").alias("v"), F.lit(1).alias("shard"))
    b = t.documents.filter("lang = 'de'").select("doc_id", (-F.col("n_chars")).alias("v"), F.lit(2).alias("shard"))
    merged = R.last_wins(a.union(b), ["doc_id"], F.col("shard")).drop("shard")
    return t.documents.select("doc_id").join(merged, "doc_id")


@query(
    """WITH u AS (SELECT doc_id, unnest(['quality', 'toxic']) AS field, unnest([quality, toxic]) AS v FROM labels), x AS (SELECT doc_id, 'toxic' AS field FROM documents WHERE lang = 'en')
    SELECT u.doc_id, u.field, u.v FROM u LEFT JOIN x USING (doc_id, field) WHERE x.doc_id IS NULL"""
)
def j19_pair_exclusion(t: Tables):
    u = t.labels.unpivot(["doc_id"], ["quality", "toxic"], "field", "v")
    out = t.documents.filter("lang = 'en'").select("doc_id", F.lit("toxic").alias("field"))
    return u.join(out, ["doc_id", "field"], "left_anti")


@query(
    """WITH b AS (SELECT vec_id, label, vec_id // 10 AS batch, row_number() OVER (PARTITION BY vec_id // 10, label ORDER BY vec_id) AS slot FROM embeddings),
    c AS (SELECT a.vec_id AS anchor, b.vec_id AS negative, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) AS n FROM b a JOIN b ON a.batch = b.batch AND a.slot = b.slot AND a.label <> b.label)
    SELECT anchor, negative FROM c WHERE n <= 2"""
)
def j20_batch_negatives(t: Tables):
    """Negatives from the same batch and slot, of another label: two an anchor."""
    b = t.embeddings.select("vec_id", "label", F.floor(F.col("vec_id") / 10).alias("batch"))
    b = b.withColumn("slot", F.row_number().over(Window.partitionBy("batch", "label").orderBy("vec_id")))
    other = b.select(F.col("vec_id").alias("negative"), F.col("label").alias("other"), "batch", "slot")
    w = Window.partitionBy("vec_id").orderBy("negative")
    j = b.join(other, ["batch", "slot"]).filter("label <> other").withColumn("n", F.row_number().over(w))
    return j.filter("n <= 2").select(F.col("vec_id").alias("anchor"), "negative")


_HASH = "sha256(concat_ws(chr(31), '{seed}', doc_id::VARCHAR))"


@query(
    f"""WITH a AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_HASH.format(seed='left')}, doc_id) AS i FROM documents), b AS (SELECT doc_id AS other, lang, row_number() OVER (PARTITION BY lang ORDER BY {_HASH.format(seed='right')}, doc_id) AS i FROM documents)
    SELECT lang, doc_id, other, (doc_id = other) AS fixed FROM a JOIN b USING (lang, i)"""
)
def j21_repaired_pairs(t: Tables):
    """Two hash orders of each language beside each other: random pairs within it, fixed points marked."""
    order = lambda seed: F.row_number().over(Window.partitionBy("lang").orderBy(T.stable_hash(F.col("doc_id"), seed=seed), "doc_id"))
    a = t.documents.select("doc_id", "lang", order("left").alias("i"))
    b = t.documents.select(F.col("doc_id").alias("other"), "lang", order("right").alias("i"))
    return a.join(b, ["lang", "i"]).select("lang", "doc_id", "other", (F.col("doc_id") == F.col("other")).alias("fixed"))


@query("SELECT page_id, min_by(s_suppkey, s_name) AS supplier FROM pages LEFT JOIN supplier ON s_suppkey = page_id % 10 GROUP BY 1")
def j22_first_match(t: Tables):
    j = t.pages.select("page_id").join(R.maybe_broadcast(t.supplier), F.col("s_suppkey") == F.col("page_id") % 10, "left")
    return j.groupBy("page_id").agg(F.min_by("s_suppkey", "s_name").alias("supplier"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' ELSE lang END AS name FROM documents")
def j23_alias_with_fallback(t: Tables):
    names = F.create_map(*[F.lit(x) for x in ("en", "english", "fr", "french")])
    return t.documents.select("doc_id", F.coalesce(F.try_element_at(names, F.col("lang")), "lang").alias("name"))


@query("SELECT doc_id, (n_chars IS NOT DISTINCT FROM length(text)) AS agrees FROM documents")
def j24_cross_check(t: Tables):
    return t.documents.select("doc_id", F.col("n_chars").eqNullSafe(F.length("text").cast("long")).alias("agrees"))


@query(
    """SELECT o_orderkey, o_custkey, round(CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice * 2 ELSE o_totalprice END, 2) AS price FROM orders"""
)
def k7_upsert(t: Tables):
    old = t.orders.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price"))
    new = t.orders.filter("o_orderkey % 10 = 0").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 2, 2).alias("price"))
    return R.upsert(old, new, ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 7 <> 0 UNION ALL SELECT l_orderkey, 1, sum(l_quantity) FROM lineitem WHERE l_orderkey % 7 = 0 GROUP BY 1")
def k8_replace_children(t: Tables):
    cols = ("l_orderkey", "l_linenumber", "l_quantity")
    old = t.lineitem.select(*cols)
    new = t.lineitem.filter("l_orderkey % 7 = 0").groupBy("l_orderkey").agg(F.lit(1).cast(old.schema["l_linenumber"].dataType).alias("l_linenumber"), F.sum("l_quantity").alias("l_quantity"))
    return R.replace_children(old, new.select(*cols), ["l_orderkey"])


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) AS id FROM events")
def k10_generated_ids(t: Tables):
    return R.numbered(t.events.select("event_id"), [F.col("event_id")])


@query("SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 1 ELSE user_id END AS parent FROM events")
def k11_reparent(t: Tables):
    return t.events.select("event_id", F.when(F.col("user_id") % 5 == 0, F.lit(1).cast("long")).otherwise(F.col("user_id")).alias("parent"))


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'click'")
def k12_delete(t: Tables):
    return t.events.filter("event_type <> 'click'").select("event_id", "event_type")
