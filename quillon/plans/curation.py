"""Projection, cleaning, validation and classification of records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import sets as S
from quillon.functions import text as T
from quillon.operators import relations as R
from quillon.plans.registry import Tables, query

_WORDS = r"CASE WHEN trim(regexp_replace({c}, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace({c}, '\s+', ' ', 'g')), ' ')) END"


@query("SELECT doc_id, text, 1 AS label, 'prose' AS kind FROM documents")
def p1_constant_columns(t: Tables):
    return t.documents.select("doc_id", "text", F.lit(1).alias("label"), F.lit("prose").alias("kind"))


@query("SELECT doc_id, lang, source FROM documents")
def p2_drop_columns(t: Tables):
    return t.documents.drop("text", "n_chars", "not_there")


@query("SELECT l.doc_id AS left_id, d.text AS left_text, l.quality AS label, 'labels' AS dataset FROM labels l JOIN documents d USING (doc_id)")
def p3_pair_schema(t: Tables):
    return t.labels.join(t.documents, "doc_id").select(F.col("doc_id").alias("left_id"), F.col("text").alias("left_text"), F.col("quality").alias("label"), F.lit("labels").alias("dataset"))


@query("SELECT d.doc_id, quality FROM documents d LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND lang IS NOT NULL")
def p4_drop_null(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality", "lang").na.drop(subset=["quality", "lang"]).drop("lang")


@query("SELECT doc_id FROM documents WHERE text IS NULL OR trim(text) <> ''")
def p5_non_blank(t: Tables):
    """Null survives, blank does not."""
    return t.documents.filter(F.col("text").isNull() | (F.trim("text") != "")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE {_WORDS.format(c='text')} BETWEEN 5 AND 600")
def p6_length_band(t: Tables):
    return t.documents.filter(T.word_count(F.col("text")).between(5, 600)).select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'de')")
def p7_membership(t: Tables):
    return t.documents.filter(F.col("lang").isin("fr", "de")).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE lang = 'es'")
def p8_split_selector(t: Tables):
    return t.documents.filter(F.col("lang") == "es").select("doc_id")


@query("SELECT page_id, url FROM pages WHERE page_id IN (SELECT doc_id FROM documents)")
def p9_existing_paths(t: Tables):
    return t.pages.join(t.documents, F.col("page_id") == F.col("doc_id"), "left_semi").select("page_id", "url")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE o_orderstatus END AS status, round(o_totalprice, 2) AS price FROM orders")
def p10_overlay_field(t: Tables):
    """One field of a nested record replaced, the others kept."""
    r = t.orders.select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.round("o_totalprice", 2).alias("price")).alias("r"))
    r = r.withColumn("r", F.col("r").withField("status", F.when(F.col("r.status") == "F", "final").otherwise(F.col("r.status"))))
    return r.select("o_orderkey", "r.status", "r.price")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def p11_map_whitelist(t: Tables):
    m = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: k.isin("k"))
    return t.events.select("event_id", F.try_element_at(m, F.lit("k")).alias("k"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 20")
def p12_filter_top_k(t: Tables):
    return t.supplier.filter("s_acctbal > 0").orderBy(F.col("s_acctbal").desc(), "s_suppkey").limit(20).select("s_suppkey", "s_name")


@query("SELECT doc_id, NOT contains(lower(text), 'license') AS license_absent, NOT contains(lower(text), '@') AS mail_absent FROM documents")
def p13_absence(t: Tables):
    return t.documents.select("doc_id", (~F.lower("text").contains("license")).alias("license_absent"), (~F.lower("text").contains("@")).alias("mail_absent"))


@query("SELECT d.doc_id, CASE WHEN contains(lower(text), source) THEN source END AS source, CASE WHEN contains(lower(text), lang) THEN lang END AS lang FROM documents d")
def p14_null_out_unsupported(t: Tables):
    keep = lambda c: F.when(F.lower("text").contains(F.col(c)), F.col(c)).alias(c)
    return t.documents.select("doc_id", keep("source"), keep("lang"))


@query("SELECT doc_id, k AS field FROM documents, (SELECT unnest(['text', 'lang', 'source', 'n_chars']) AS k) WHERE substr(sha256(concat_ws(chr(31), 'schema', doc_id::VARCHAR, k)), 1, 1) < '8'")
def p15_schema_subset(t: Tables):
    """Half the fields of each record, by hash."""
    k = t.documents.select("doc_id", F.explode(F.array(*[F.lit(x) for x in ("text", "lang", "source", "n_chars")])).alias("field"))
    return k.filter(F.substring(T.stable_hash(F.col("doc_id"), F.col("field"), seed="schema"), 1, 1) < "8")


@query("SELECT conv_id, turn, length(trim(text)) >= 20 AND NOT regexp_matches(lower(text), 'i cannot|i can''t|i''m sorry|as an ai|i am unable') AND role IN ('user', 'assistant') AS valid FROM conversations")
def p17_turn_validator(t: Tables):
    ok = (F.length(F.trim("text")) >= 20) & ~T.has_any(F.col("text")) & F.col("role").isin("user", "assistant")
    return t.conversations.select("conv_id", "turn", ok.alias("valid"))


_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 20)"


@query(f"SELECT doc_id, len({_LINES}) >= 1 AND len(list_distinct({_LINES})) >= 0.8 * len(string_split(text, chr(10))) AS valid FROM documents WHERE text IS NOT NULL")
def p18_share_of_valid_lines(t: Tables):
    """Four fifths of the lines are long enough and unlike each other."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= 20)
    ok = (F.size(lines) >= 1) & (F.size(F.array_distinct(lines)) >= 0.8 * F.size(F.split("text", "\n")))
    return t.documents.filter("text IS NOT NULL").select("doc_id", ok.alias("valid"))


@query(r"SELECT doc_id, length(text) >= 500 AND NOT regexp_matches(lower(text), 'i cannot|i can''t|i''m sorry|as an ai|i am unable') AND NOT regexp_matches(text, '\[[A-Z][^\]]*\]|\{\{') AS valid FROM documents")
def p19_long_text_validator(t: Tables):
    ok = (F.length("text") >= 500) & ~T.has_any(F.col("text")) & ~F.col("text").rlike(r"\[[A-Z][^\]]*\]|\{\{")
    return t.documents.select("doc_id", ok.alias("valid"))


@query("SELECT conv_id, count(*) BETWEEN 3 AND 25 AND count(DISTINCT text) >= 0.8 * count(*) AS valid FROM conversations GROUP BY 1")
def p20_group_validator(t: Tables):
    n = F.count("*")
    return t.conversations.groupBy("conv_id").agg((n.between(3, 25) & (F.count_distinct("text") >= 0.8 * n)).alias("valid"))


@query(
    """WITH w AS (SELECT doc_id, tier, trim(lower(x)) AS k, i FROM (SELECT doc_id, 1 AS tier, unnest(string_split(text, ',')) AS x, generate_subscripts(string_split(text, ','), 1) AS i FROM documents UNION ALL SELECT doc_id, 2, unnest(string_split(text, '.')), generate_subscripts(string_split(text, '.'), 1) FROM documents)),
    f AS (SELECT doc_id, tier, k, row_number() OVER (PARTITION BY doc_id, k ORDER BY tier, i) AS n FROM w WHERE k <> '')
    SELECT doc_id, count(*) FILTER (tier = 1) AS tier_1, count(*) FILTER (tier = 2) AS tier_2 FROM f WHERE n = 1 GROUP BY 1"""
)
def p21_tiered_first_seen(t: Tables):
    """Items of two tiers; an item counts in the first tier that has it."""
    part = lambda n, mark: t.documents.select("doc_id", F.lit(n).alias("tier"), F.posexplode(F.split("text", mark)).alias("i", "x"))
    w = part(1, ",").union(part(2, r"\.")).select("doc_id", "tier", "i", F.trim(F.lower("x")).alias("k")).filter("k <> ''")
    first = R.first_seen(w, ["doc_id", "k"], [F.col("tier"), F.col("i")])
    return first.groupBy("doc_id").agg(F.count_if(F.col("tier") == 1).alias("tier_1"), F.count_if(F.col("tier") == 2).alias("tier_2"))


@query("SELECT conv_id, list_concat(list(role ORDER BY turn), list_transform(range(0, 5), lambda i: ['a', 'b', 'c'][(i % 3 + 1)::INT]))[1:5] AS roles FROM conversations GROUP BY 1")
def p22_exact_length(t: Tables):
    """Roles of a conversation, cut or filled cyclically to five."""
    g = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    return g.select("conv_id", S.at_least(F.col("r"), 5, F.array(*[F.lit(x) for x in "abc"])).alias("roles"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN false WHEN regexp_matches(s_name, '[13579]$') THEN s_acctbal > 1000 ELSE true END AS realistic FROM supplier")
def p23_realistic(t: Tables):
    c = F.when(F.col("s_acctbal") < 0, False).when(F.col("s_name").rlike("[13579]$"), F.col("s_acctbal") > 1000).otherwise(True)
    return t.supplier.select("s_suppkey", c.alias("realistic"))


@query(
    """WITH x AS (SELECT p_partkey, string_split(p_type, ' ') AS c, p_size FROM part)
    SELECT p_partkey, coalesce(c[(p_size % 4)::INT + 1], c[1], 'none') AS choice, CASE WHEN c[(p_size % 4)::INT + 1] IS NOT NULL THEN 'exact' WHEN c[1] IS NOT NULL THEN 'repaired' ELSE 'failed' END AS outcome FROM x"""
)
def p24_align_choice(t: Tables):
    """The choice of a place, else the first, else none, and which of these happened."""
    x = t.part.select("p_partkey", F.split("p_type", " ").alias("c"), "p_size")
    exact, first = F.get("c", (F.col("p_size") % 4).cast("int")), F.get("c", F.lit(0))
    return x.select("p_partkey", F.coalesce(exact, first, F.lit("none")).alias("choice"), F.when(exact.isNotNull(), "exact").when(first.isNotNull(), "repaired").otherwise("failed").alias("outcome"))


@query("WITH x AS (SELECT c_custkey, list_filter([c_name, nullif(c_mktsegment, 'BUILDING'), ''], lambda v: v IS NOT NULL AND v <> '' AND v <> 'nan') AS tags FROM customer) SELECT c_custkey, CASE WHEN len(tags) > 0 THEN tags END AS tags FROM x")
def p25_tags(t: Tables):
    """Columns to one array without null, blank and nan; null if nothing is left."""
    a = F.filter(F.array("c_name", F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("")), lambda v: v.isNotNull() & (v != "") & (v != "nan"))
    return t.customer.select("c_custkey", F.when(F.size(a) > 0, a).alias("tags"))


@query("SELECT p_partkey, [p_name, p_brand, p_type] AS parts FROM part")
def p26_gather_prefix(t: Tables):
    """All string columns with a prefix, in order, as one array."""
    cols = [c for c, kind in t.part.dtypes if c.startswith("p_") and kind == "string"]
    return t.part.select("p_partkey", F.array(*cols).alias("parts"))


@query("SELECT conv_id, turn, '<' || role || '>' || chr(10) || text || chr(10) || '</' || role || '>' AS prompt FROM conversations")
def p27_prompt(t: Tables):
    return t.conversations.select("conv_id", "turn", F.format_string("<%s>\n%s\n</%s>", "role", "text", "role").alias("prompt"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'legal' WHEN regexp_matches(text, '[0-9]{4}') THEN 'numeric' WHEN contains(text, '|') THEN 'table' WHEN n_chars < 200 THEN 'short' ELSE 'prose' END AS kind FROM documents")
def p30_rule_cascade(t: Tables):
    k = F.when(F.lower("text").contains("license"), "legal").when(F.col("text").rlike("[0-9]{4}"), "numeric").when(F.col("text").contains("|"), "table").when(F.col("n_chars") < 200, "short").otherwise("prose")
    return t.documents.select("doc_id", k.alias("kind"))


@query("SELECT doc_id, CASE WHEN n_chars < 200 THEN 'junior' WHEN n_chars < 1000 THEN 'mid' WHEN n_chars < 5000 THEN 'senior' ELSE 'lead' END AS level FROM documents")
def p31_buckets(t: Tables):
    return t.documents.select("doc_id", F.when(F.col("n_chars") < 200, "junior").when(F.col("n_chars") < 1000, "mid").when(F.col("n_chars") < 5000, "senior").otherwise("lead").alias("level"))


@query("SELECT doc_id, ['plain', 'modern', 'classic'][(doc_id % 3 + 1)::INT] AS template FROM documents")
def p32_rotation(t: Tables):
    a = F.array(*[F.lit(x) for x in ("plain", "modern", "classic")])
    return t.documents.select("doc_id", F.element_at(a, (F.pmod("doc_id", F.lit(3)) + 1).cast("int")).alias("template"))


@query("SELECT page_id, CASE WHEN contains(url, 'blog.') THEN 'blog' WHEN contains(url, 'm.') THEN 'mobile' WHEN contains(url, 'www.') THEN 'web' ELSE 'other' END AS generator FROM pages")
def p33_first_keyword(t: Tables):
    first = F.coalesce(*[F.when(F.col("url").contains(k), F.lit(v)) for k, v in (("blog.", "blog"), ("m.", "mobile"), ("www.", "web"))], F.lit("other"))
    return t.pages.select("page_id", first.alias("generator"))


@query("SELECT o_custkey, list_sort(list(o_orderkey)) AS keys, list_sort(list_distinct(list(o_orderstatus))) AS statuses FROM orders GROUP BY 1")
def p34_flat_arrays(t: Tables):
    g = t.orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("x"))
    return g.select("o_custkey", F.array_sort(F.transform("x", lambda r: r["o_orderkey"])).alias("keys"), F.array_sort(F.array_distinct(F.transform("x", lambda r: r["o_orderstatus"]))).alias("statuses"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(try_cast(substr(event_type, 1, 2) AS BIGINT), -1) AS coerced FROM events")
def p35_coercion(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.coalesce(F.substring("event_type", 1, 2).try_cast("bigint"), F.lit(-1).cast("long")).alias("coerced"))


@query("SELECT doc_id, contains(text, source) OR contains(lang, source) AS leaks FROM documents")
def p36_leaked_tokens(t: Tables):
    whole = F.to_json(F.struct("text", "lang"))
    return t.documents.select("doc_id", whole.contains(F.col("source")).alias("leaks"))


@query(
    """WITH e AS (SELECT user_id, avg(value) FILTER (event_type = 'click') / 100 AS a, avg(value) FILTER (event_type = 'view') / 100 AS b FROM events GROUP BY 1),
    c AS (SELECT user_id, least(greatest(coalesce(a, 0) * 0.7 + coalesce(b, 0) * 0.3, 0), 1) AS open_, least(greatest(coalesce(b, 0) * 0.6 - coalesce(a, 0) * 0.2, 0), 1) AS calm FROM e)
    SELECT user_id, round(open_, 6) AS open_, round(calm, 6) AS calm, CASE WHEN open_ >= calm THEN 'open' ELSE 'calm' END AS tag FROM c"""
)
def p37_trait_blend(t: Tables):
    """Weighted, clamped traits and the stronger one."""
    mean = lambda k: F.coalesce(F.avg(F.when(F.col("event_type") == k, F.col("value"))) / 100, F.lit(0.0))
    e = t.events.groupBy("user_id").agg(mean("click").alias("a"), mean("view").alias("b"))
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    c = e.select("user_id", clamp(F.col("a") * 0.7 + F.col("b") * 0.3).alias("open_"), clamp(F.col("b") * 0.6 - F.col("a") * 0.2).alias("calm"))
    return c.select("user_id", F.round("open_", 6).alias("open_"), F.round("calm", 6).alias("calm"), F.when(F.col("open_") >= F.col("calm"), "open").otherwise("calm").alias("tag"))


@query("SELECT source, round(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) * 0.35 + count(*) * 0.01, 4) AS projected, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) * 0.35 + count(*) * 0.01 <= 5 AS within_budget FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def a58_budget_gate(t: Tables):
    cost = F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)) * F.lit(0.35) + F.count("*") * F.lit(0.01)
    g = t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(cost.alias("c"))
    return g.select("source", F.round("c", 4).alias("projected"), (F.col("c") <= 5).alias("within_budget"))


@query(
    """WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat(lang, doc_id::VARCHAR)), doc_id) AS n FROM documents) SELECT lang, doc_id FROM r WHERE n <= 5"""
)
def c27_seeded_five(t: Tables):
    w = Window.partitionBy("lang").orderBy(F.md5(F.concat("lang", F.col("doc_id").cast("string"))), "doc_id")
    return t.documents.select("lang", "doc_id", F.row_number().over(w).alias("n")).filter("n <= 5").drop("n")


@query(
    """WITH n AS (SELECT source, count(*) AS c FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY 1)
    SELECT d.source, d.doc_id, 'own' AS origin FROM documents d JOIN labels l USING (doc_id) JOIN n USING (source) WHERE l.quality = 0 AND c >= 3
    UNION ALL SELECT s.source, f.doc_id, 'fallback' FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN n USING (source) CROSS JOIN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 3) f WHERE coalesce(c, 0) < 3"""
)
def c28_fallback_source(t: Tables):
    """Groups with fewer than three rows take the first three documents instead."""
    own = t.documents.join(t.labels, "doc_id").filter("quality = 0").select("source", "doc_id").withColumn("c", F.count("*").over(Window.partitionBy("source")))
    rich = own.filter("c >= 3").select("source", "doc_id", F.lit("own").alias("origin"))
    poor = t.documents.select("source").distinct().join(rich, "source", "left_anti")
    three = t.documents.orderBy("doc_id").limit(3).select("doc_id")
    return rich.union(poor.crossJoin(F.broadcast(three)).select("source", "doc_id", F.lit("fallback").alias("origin")))
