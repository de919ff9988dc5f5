"""Ordered sequences, ranks, splits, samples, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import relations as R
from quillon.operators import selection as S
from quillon.operators import sequences as Q
from quillon.plans.registry import Tables, query

_H = "sha256(concat_ws(chr(31), '{seed}', {key}::VARCHAR))"

_QUOTA = """s AS (SELECT {by} AS k, count(*) AS w FROM {table} GROUP BY 1), e AS (SELECT k, w * {total} / sum(w) OVER () AS x FROM s),
b AS (SELECT k, x, floor(x) AS base FROM e), q AS (SELECT k, (base + (row_number() OVER (ORDER BY round(x - base, 9) DESC, k) <= {total} - sum(base) OVER ())::INT)::BIGINT AS quota FROM b)"""


@query(f"WITH {_QUOTA.format(by='source', table='documents', total=137)} SELECT k AS source, quota FROM q")
def o9_largest_remainder(t: Tables):
    s = t.documents.groupBy("source").agg(F.count("*").alias("w"))
    return R.quotas(s, "w", 137, "source").select("source", "quota")


@query(
    f"""WITH {_QUOTA.format(by='lang', table='documents', total=200)}, r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_H.format(seed='split', key='doc_id')}, doc_id) AS n FROM documents)
    SELECT doc_id, lang, n <= quota AS selected FROM r JOIN q ON q.k = r.lang"""
)
def o10_stratified_select(t: Tables):
    return S.stratified_split(t.documents.select("doc_id", "lang"), "doc_id", "lang", 200, "split")


@query(
    f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_H.format(seed='rank', key='doc_id')}, doc_id) AS n FROM documents) SELECT doc_id, lang, n AS rank FROM r WHERE n <= 20"""
)
def w1_hash_rank_quota(t: Tables):
    """The 20 least hashes of each language, ranked: only those 20 are ordered."""
    d, h = t.documents.select("doc_id", "lang"), T.stable_hash(F.col("doc_id"), seed="rank")
    cuts = d.select("lang").distinct().select("lang", F.lit(1).alias("cut"), F.lit(20).alias("k"))
    first = S.cut_by_hash(d, "doc_id", ["lang"], h, cuts).filter("cut IS NOT NULL")
    return first.select("doc_id", "lang", F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id")).cast("long").alias("rank"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def w2_full_ranking(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rank"))


@query(
    """WITH c AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w OR lag(turn) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c)
    SELECT conv_id, island::BIGINT AS island, role, string_agg(text, ' ' ORDER BY turn, text) AS text, min(turn) AS first, max(turn) AS last, count(*) AS rows FROM i GROUP BY conv_id, island, role"""
)
def w4_islands(t: Tables):
    """Runs of equal role in a conversation, joined to spans."""
    return Q.joined_spans(t.conversations, ["conv_id"], "turn", ["role"], "text")


@query()
def w6_repeated_key_sessions(t: Tables):
    """Event types of a user: a new record where a type comes back after another."""
    return Q.repeated_key_sessions(t.events, ["user_id"], "event_id", "event_type").withColumnRenamed("at", "event_id").withColumnRenamed("field", "event_type")


@query()
def w7_anchored_groups(t: Tables):
    """Event types of a user, in groups that a purchase opens."""
    return Q.anchored_groups(t.events, ["user_id"], "event_id", "event_type", "purchase").withColumnRenamed("at", "event_id").withColumnRenamed("field", "event_type")


@query(
    """WITH m AS (SELECT l_orderkey, l_linenumber, year(l_shipdate) * 12 + month(l_shipdate) AS s FROM lineitem), e AS (SELECT *, s + 3 AS e0 FROM m)
    SELECT l_orderkey, l_linenumber, s::BIGINT AS s, (CASE WHEN e0 > lead(s) OVER w THEN lead(s) OVER w - 1 ELSE e0 END)::BIGINT AS e FROM e WINDOW w AS (PARTITION BY l_orderkey ORDER BY s, l_linenumber)"""
)
def w9_truncate_overlaps(t: Tables):
    """Spans of months in an order, cut where the next begins."""
    s = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long")
    m = t.lineitem.select("l_orderkey", "l_linenumber", s.alias("s")).withColumn("e", F.col("s") + 3)
    return Q.truncate_overlaps(m, ["l_orderkey"], "s", "e", "l_linenumber")


@query(r"WITH k AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS k FROM conversations) SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY conv_id, turn) AS n FROM k) WHERE n = 1")
def w12_first_seen(t: Tables):
    k = t.conversations.select("conv_id", "turn", F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")).alias("k"))
    return R.first_seen(k, ["k"], [F.col("conv_id"), F.col("turn")]).select("conv_id", "turn")


@query(
    f"""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_H.format(seed='pairs', key='doc_id')}, doc_id) AS n, count(*) OVER (PARTITION BY source) AS c FROM documents)
    SELECT a.source, a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.source = b.source AND a.n % 2 = 1 AND b.n = a.n + 1 WHERE (a.n + 1) // 2 <= least(15, a.c // 2)"""
)
def w13_pairs_per_group(t: Tables):
    """Up to 15 pairs a source, from neighbours in hash order."""
    g = Window.partitionBy("source")
    w = g.orderBy(T.stable_hash(F.col("doc_id"), seed="pairs"), "doc_id")
    r = t.documents.select("source", F.col("doc_id").alias("a"), F.lead("doc_id").over(w).alias("b"), F.row_number().over(w).alias("n"), F.count("*").over(g).alias("c"))
    return r.filter("n % 2 = 1 AND b IS NOT NULL AND (n + 1) / 2 <= least(15, floor(c / 2))").select("source", "a", "b")


@query(
    f"""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_H.format(seed='top', key='doc_id')}, doc_id) AS n, {_H.format(seed='top', key='doc_id')} AS h FROM documents),
    rest AS (SELECT doc_id, source, row_number() OVER (ORDER BY h, doc_id) AS m FROM r WHERE n > 5) SELECT doc_id, source, 'sample' AS part FROM r WHERE n <= 5 UNION ALL SELECT doc_id, source, 'top_up' FROM rest WHERE m <= 10"""
)
def w14_sample_and_top_up(t: Tables):
    """Five of each source, then ten of what is left."""
    h = T.stable_hash(F.col("doc_id"), seed="top")
    r = t.documents.select("doc_id", "source", h.alias("h")).withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("h", "doc_id")))
    rest = r.filter("n > 5").orderBy("h", "doc_id").limit(10)
    return r.filter("n <= 5").select("doc_id", "source", F.lit("sample").alias("part")).union(rest.select("doc_id", "source", F.lit("top_up").alias("part")))


@query("SELECT user_id, round(regr_slope(value, i), 6) AS slope FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) GROUP BY 1")
def w17_slope(t: Tables):
    w = Window.partitionBy("user_id").orderBy("event_id")
    i = t.events.select("user_id", "value", F.row_number().over(w).cast("double").alias("i"))
    return i.groupBy("user_id").agg(F.round(F.regr_slope("value", "i"), 6).alias("slope"))


@query("SELECT g.i AS step, b.item_id FROM range(0, 1000) g(i) JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS n, count(*) OVER () AS c FROM benchmark) b ON g.i % b.c = b.n")
def w18_cyclic_schedule(t: Tables):
    n = R.numbered(t.benchmark.select("item_id"), [F.col("item_id")]).withColumn("n", F.col("id") - 1)
    size = t.benchmark.agg(F.count("*").alias("c"))
    steps = t.spark.range(1000).withColumnRenamed("id", "step").join(F.broadcast(size)).withColumn("n", F.col("step") % F.col("c"))
    return steps.join(n, "n").select("step", "item_id")


@query("SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE role IS NOT NULL AND role IS DISTINCT FROM p")
def c30_change_positions(t: Tables):
    return Q.adjacent_changes(t.conversations, ["conv_id"], "turn", "role").select("conv_id", "turn", "role")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def o4_top_k(t: Tables):
    return t.orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("SELECT doc_id, quality, row_number() OVER (ORDER BY quality DESC NULLS LAST, doc_id) AS place FROM documents LEFT JOIN labels USING (doc_id)")
def o3_nulls_last(t: Tables):
    j = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality")
    return R.numbered(j, [F.col("quality").desc_nulls_last(), F.col("doc_id")], "place")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_H.format(seed='shuffle', key='doc_id')}, doc_id) AS place FROM documents")
def o7_shuffle(t: Tables):
    """All rows in the order of a hash."""
    return R.numbered(t.documents.select("doc_id").withColumn("h", T.stable_hash(F.col("doc_id"), seed="shuffle")), [F.col("h"), F.col("doc_id")], "place").drop("h")


@query(f"SELECT doc_id, lang FROM documents ORDER BY {_H.format(seed='sample', key='doc_id')}, doc_id LIMIT 100")
def o8_exact_sample(t: Tables):
    """A hundred rows by hash order."""
    return t.documents.orderBy(T.stable_hash(F.col("doc_id"), seed="sample"), "doc_id").limit(100).select("doc_id", "lang")


@query(
    f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_H.format(seed='ratio', key='doc_id')}, doc_id) AS n, count(*) OVER (PARTITION BY lang) AS c FROM documents)
    SELECT doc_id, lang, CASE WHEN n <= floor(c * 0.7) THEN 'train' WHEN n <= floor(c * 0.85) THEN 'validation' ELSE 'test' END AS split FROM r"""
)
def o13_stratified_split(t: Tables):
    """70, 15 and 15 of a hundred of each language."""
    d = t.documents.select("doc_id", "lang")
    r = S.cut_by_hash(d, "doc_id", ["lang"], T.stable_hash(F.col("doc_id"), seed="ratio"), S.share_cuts(d, ["lang"], [0.7, 0.85]))
    return r.select("doc_id", "lang", F.when(F.col("cut") == 1, "train").when(F.col("cut") == 2, "validation").otherwise("test").alias("split"))


@query("WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT source, round_even(n / sum(n) OVER () * 333, 0)::BIGINT AS target, ceil(n / 7)::BIGINT AS chunks FROM c")
def o15_rounded_targets(t: Tables):
    c = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    return c.select("source", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy()) * 333).cast("long").alias("target"), F.ceil(F.col("n") / 7).alias("chunks"))


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS chunk FROM documents")
def o17_chunks(t: Tables):
    return Q.chunks(t.documents.select("doc_id", "source"), ["source"], [F.col("doc_id")], 8)


@query("SELECT doc_id, text, 'document' AS kind FROM documents UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark")
def u1_union_all(t: Tables):
    return t.documents.select("doc_id", "text", F.lit("document").alias("kind")).unionByName(t.benchmark.select(F.col("item_id").alias("doc_id"), "text", F.lit("benchmark").alias("kind")))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer")
def u2_intersect(t: Tables):
    return t.orders.select(F.col("o_custkey").alias("k")).intersect(t.customer.select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def u2_difference(t: Tables):
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.select("o_custkey"))


@query("SELECT 'missing' AS issue, '*' AS part, count(*) AS n FROM documents WHERE lang = 'es' HAVING count(*) > 0")
def u3_partition_report(t: Tables):
    """Splits by language against the whole: one language is left out, which is the only issue."""
    part = lambda x: t.documents.filter(F.col("lang") == x)
    return R.set_report({x: part(x) for x in ("en", "fr", "de")}, t.documents, "doc_id")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY source, text")
def u4_distinct_on_subset(t: Tables):
    return R.first_seen(t.documents, ["source", "text"], [F.col("doc_id")]).select("doc_id")


@query("SELECT DISTINCT lang, source FROM documents")
def u5_distinct(t: Tables):
    return t.documents.select("lang", "source").distinct()


@query("SELECT conv_id, list_sort(list_filter(['assistant', 'system', 'tool', 'user'], lambda x: NOT list_contains(r, x))) AS missing FROM (SELECT conv_id, list(DISTINCT role) AS r FROM conversations GROUP BY 1)")
def u6_missing_keys(t: Tables):
    want = F.array(*[F.lit(x) for x in ("assistant", "system", "tool", "user")])
    return t.conversations.groupBy("conv_id").agg(F.array_sort(F.array_except(want, F.collect_set("role"))).alias("missing"))


@query("SELECT doc_id, unnest(range(1, 4)) AS copy_no FROM labels WHERE quality = 0")
def u7_oversample(t: Tables):
    return t.labels.filter("quality = 0").select("doc_id", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])).alias("copy_no"))


@query("SELECT event_id, unnest(json_keys(props)) AS k, json_extract_string(props, '$.' || unnest(json_keys(props))) AS v FROM events")
def u9_explode_map(t: Tables):
    m = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", F.explode(m).alias("k", "v"))
