"""Scalar functions, record comparison and evidence checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import matching as X
from quillon.functions import sets as S
from quillon.functions import text as T
from quillon.operators import sequences as Q
from quillon.operators.relations import maybe_broadcast
from quillon.plans.registry import Tables, query


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS normal FROM documents")
def f1_normalize_text(t: Tables):
    return t.documents.select("doc_id", T.normalize_text(F.col("text")).alias("normal"))


@query("SELECT c_custkey, lower(trim(c_name)) AS mail FROM customer")
def f2_normalize_email(t: Tables):
    return t.customer.select("c_custkey", T.normalize_email(F.col("c_name")).alias("mail"))


@query(r"SELECT doc_id, regexp_replace(regexp_extract(text, '\+[0-9][ ().0-9-]+[0-9]'), '\D', '', 'g') AS phone FROM documents")
def f3_normalize_phone(t: Tables):
    return t.documents.select("doc_id", T.normalize_phone(F.regexp_extract("text", r"\+[0-9][ ().0-9-]+[0-9]", 0)).alias("phone"))


@query(
    r"""WITH w AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '#.*$', '') AS u FROM pages)
    SELECT page_id, regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www\.', '') || regexp_replace(regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+', '/', 'g'), '/$', '') || regexp_extract(u, '(\?.+)$', 1) AS url FROM w"""
)
def f4_normalize_url(t: Tables):
    return t.pages.select("page_id", T.normalize_url(F.col("url")).alias("url"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'present' ELSE strftime(o_orderdate, '%Y-%m') END AS d FROM orders")
def f5_normalize_date(t: Tables):
    raw = F.when(F.col("o_orderkey") % 9 == 0, " Current ").otherwise(F.concat(F.date_format("o_orderdate", "yyyy"), F.lit(" – "), F.date_format("o_orderdate", "MM")))
    return t.orders.select("o_orderkey", T.normalize_date(raw).alias("d"))


@query("SELECT o_orderkey, (lower(trim(o_orderstatus)) = 'f')::INT::DOUBLE AS score FROM orders")
def f6_exact_score(t: Tables):
    return t.orders.select("o_orderkey", (T.normalize_email(F.col("o_orderstatus")) == "f").cast("double").alias("score"))


@query()
def f7_anls(t: Tables):
    """Indel similarity of a document's beginning and the benchmark text of its number modulo 40."""
    b = t.benchmark.select(F.col("item_id"), F.col("text").alias("other"))
    j = t.documents.join(maybe_broadcast(b), F.col("doc_id") % 40 == F.col("item_id"))
    return j.select("doc_id", F.round(X.anls(F.col("text"), F.col("other")), 6).alias("anls"))


_SETS = "list_distinct(list_filter(list_transform(string_split({c}, ' '), lambda x: lower(trim(x))), lambda x: x <> ''))"


@query(
    f"""WITH x AS (SELECT conv_id, turn, {_SETS.format(c='text')} AS a, {_SETS.format(c='lead(text) OVER (PARTITION BY conv_id ORDER BY turn)')} AS b FROM conversations), y AS (SELECT *, coalesce(b, []) AS z, len(list_intersect(a, coalesce(b, []))) AS h FROM x)
    SELECT conv_id, turn, round(CASE WHEN len(a) = 0 AND len(z) = 0 THEN 1 WHEN len(z) = 0 THEN 0 ELSE h / len(z) END, 6) AS "precision", round(CASE WHEN len(a) = 0 AND len(z) = 0 THEN 1 WHEN len(a) = 0 THEN 0 ELSE h / len(a) END, 6) AS recall,
    round(CASE WHEN len(a) + len(z) = 0 THEN 1 ELSE 2 * h / (len(a) + len(z)) END, 6) AS f1, round(CASE WHEN len(a) + len(z) = 0 THEN 1 ELSE h / len(list_distinct(list_concat(a, z))) END, 6) AS jaccard FROM y"""
)
def f8_set_metrics(t: Tables):
    """Word sets of neighbouring turns."""
    from pyspark.sql import Window

    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    x = t.conversations.select("conv_id", "turn", F.split("text", " ").alias("p"), F.split(nxt, " ").alias("q"))
    x = x.select("conv_id", "turn", S.clean_set(F.col("p")).alias("a"), S.clean_set(F.col("q")).alias("b"))
    return x.select("conv_id", "turn", *[F.round(c, 6).alias(k) for k, c in S.set_metrics(F.col("a"), F.col("b")).items()])


@query()
def f10_hungarian(t: Tables):
    """All lines of a conversation's first and last turn, matched optimally."""
    g = t.conversations.groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("b"))
    lines = lambda c: F.filter(F.transform(F.split(c, r"\n"), lambda x: F.trim(x)), lambda x: x != "")
    return g.select("conv_id", F.round(X.hungarian(lines("a"), lines("b")), 6).alias("score"))


@query("SELECT doc_id, contains(lower(text), lang) OR contains(lower(text), source) AS supported FROM documents")
def f11_supported(t: Tables):
    low = F.lower("text")
    return t.documents.select("doc_id", (low.contains(F.col("lang")) | low.contains(F.col("source"))).alias("supported"))


_NORM = r"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
#: A document's evidence, and a list of values, its benchmark text's sentences; every seventh document has none.
_VALUES = f"""v AS (SELECT d.doc_id, d.lang, {_NORM.format(c='d.text')} AS ev, CASE WHEN d.doc_id % 7 = 0 THEN [] ELSE list_filter(list_transform(string_split(b.text, '.'), lambda x: {_NORM.format(c='x')}), lambda x: x <> '') END AS vals
  FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id),
s AS (SELECT doc_id, lang, CASE WHEN len(vals) = 0 THEN NULL ELSE len(list_filter(vals, lambda x: NOT (contains(ev, x) OR len(list_intersect(list_distinct(string_split(x, ' ')), list_distinct(string_split(ev, ' ')))) / len(list_distinct(string_split(x, ' '))) >= 0.5))) = 0 END AS supported FROM v)"""


def _value_support(t: Tables):
    b = t.benchmark.select("item_id", F.split("text", r"\.").alias("vals"))
    j = t.documents.join(maybe_broadcast(b), F.col("doc_id") % 40 == F.col("item_id"))
    vals = F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.col("vals"))
    return j.select("doc_id", "lang", X.all_supported(vals, F.col("text")).alias("supported"))


@query(f"WITH {_VALUES} SELECT doc_id, supported FROM s")
def f11_value_supported(t: Tables):
    """Whether a document holds each of a list of values, as a phrase or by half of its words; null for a list without values."""
    return _value_support(t).select("doc_id", "supported")


@query(f"WITH {_VALUES} SELECT lang, count(*) AS documents, count(supported) AS judged, round(coalesce(avg((NOT supported)::INT), 0), 6) AS unsupported_rate FROM s GROUP BY lang")
def a13_unsupported_values(t: Tables):
    """Share of unsupported lists among those with a support, 0 where none has one."""
    return _value_support(t).groupBy("lang").agg(F.count("*").alias("documents"), F.count("supported").alias("judged"), F.round(F.coalesce(F.avg((~F.col("supported")).cast("int")), F.lit(0.0)), 6).alias("unsupported_rate"))


@query()
def f1_normalize_exact(t: Tables):
    """normalize_text with compatibility forms and full case folding, which SQL has no functions for."""
    return t.documents.select("doc_id", T.normalize_text_exact(F.col("text")).alias("normal"))


@query("SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9+#.]+') AS tokens FROM documents")
def f12_tokenize(t: Tables):
    return t.documents.select("doc_id", T.tokenize(F.col("text")).alias("tokens"))


@query("SELECT p_partkey, concat_ws(chr(10), p_name, p_brand, p_type, p_size::VARCHAR) AS body FROM part")
def f13_search_text(t: Tables):
    return t.part.select("p_partkey", F.concat_ws("\n", "p_name", "p_brand", "p_type", F.col("p_size").cast("string")).alias("body"))


@query("SELECT l_orderkey, l_linenumber, 'lines[' || (l_linenumber - 1) || '].quantity' AS path, 'lines[].quantity' AS wildcard, (l_linenumber - 1)::BIGINT AS i FROM lineitem")
def f14_field_path(t: Tables):
    p = t.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit("lines["), F.col("l_linenumber") - 1, F.lit("].quantity")).alias("path"))
    return p.select("*", F.regexp_replace("path", r"\[\d+\]", "[]").alias("wildcard"), F.regexp_extract("path", r"\[(\d+)\]", 1).try_cast("bigint").alias("i"))


@query("SELECT event_id, least(greatest(round_even(value * 10.5, 0), 0), 1000)::BIGINT AS box FROM events")
def f16_clamped_box(t: Tables):
    return t.events.select("event_id", F.least(F.greatest(F.bround(F.col("value") * 10.5), F.lit(0)), F.lit(1000)).cast("long").alias("box"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 5 THEN -1 ELSE l_orderkey % 4 * 1000 + l_linenumber END AS grp FROM lineitem")
def f18_group_id(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") > 5, F.lit(-1).cast("long")).otherwise(F.col("l_orderkey") % 4 * 1000 + F.col("l_linenumber")).alias("grp"))


@query(r"SELECT conv_id, turn, trim(trim(regexp_replace(text, '\s+', ' ', 'g')), '[]{}|·,; ') AS body FROM conversations")
def f19_strip_marks(t: Tables):
    return t.conversations.select("conv_id", "turn", T.strip_marks(F.col("text")).alias("body"))


@query(r"SELECT doc_id, regexp_extract_all(text, '\b(?:19|20)[0-9]{2}(?:-[0-9]{2})?\b') AS years FROM documents")
def f20_duration_hints(t: Tables):
    return t.documents.select("doc_id", F.regexp_extract_all("text", F.lit(r"\b(?:19|20)[0-9]{2}(?:-[0-9]{2})?\b"), F.lit(0)).alias("years"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def f22_slug(t: Tables):
    return t.part.select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber::BIGINT AS page, l_orderkey::BIGINT AS word FROM lineitem")
def f23_candidate_position(t: Tables):
    e = t.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit("cv:p"), F.col("l_linenumber"), F.lit(":w"), F.col("l_orderkey")).alias("e"))
    part = lambda n: F.coalesce(F.nullif(F.regexp_extract("e", r":p(\d+):w(\d+)", n), F.lit("")).try_cast("bigint"), F.lit(10**9))
    return e.select("l_orderkey", "l_linenumber", part(1).alias("page"), part(2).alias("word"))


@query("SELECT doc_id, sha256(concat_ws(chr(31), '20260609', doc_id::VARCHAR, lang)) AS digest, list_reduce(list_transform(string_split(sha256(concat_ws(chr(31), '20260609', doc_id::VARCHAR, lang)), ''), lambda c: (instr('0123456789abcdef', c) - 1)::BIGINT), lambda a, d: (a * 16 + d) % 5) AS fold FROM documents")
def f24_stable_hash_and_fold(t: Tables):
    h = t.documents.select("doc_id", T.stable_hash(F.col("doc_id"), F.col("lang")).alias("digest"))
    return h.withColumn("fold", T.stable_fold(F.col("digest"), 5))


@query("SELECT event_id, json_valid(props) AS ok, json_extract_string(props, '$.k') AS k FROM events")
def f25_parse_json(t: Tables):
    """Fenced answers parsed after their fences are gone."""
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    body = F.regexp_extract(fenced, r"(?s)\{.*\}", 0)
    return t.events.select("event_id", F.expr("try_parse_json(props)").isNotNull().alias("ok"), F.get_json_object(body, "$.k").alias("k"))


@query("SELECT event_id, regexp_matches(props, '^\\s*\\{') AS is_object, regexp_matches(props, '^\\s*\\[') AS is_array FROM events")
def f28_container_check(t: Tables):
    return t.events.select("event_id", F.col("props").rlike(r"^\s*\{").alias("is_object"), F.col("props").rlike(r"^\s*\[").alias("is_array"))


@query("SELECT event_id, length(to_json(struct_pack(k := json_extract_string(props, '$.k'))))::BIGINT AS n FROM events")
def f29_json_length(t: Tables):
    return t.events.select("event_id", F.length(F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k")))).cast("long").alias("n"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), '["''“”‘’]', '', 'g'), '[^a-z0-9\s?]', '', 'g')) AS k FROM conversations""")
def f30_question_key(t: Tables):
    return t.conversations.select("conv_id", "turn", T.question_key(F.col("text")).alias("k"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(trim(regexp_replace(replace(text, '·', ' * '), '\s+', ' ', 'g')), '^(?:\(?\d+[.):]|[-*])\s*', '')) AS q FROM conversations")
def f31_strip_numbering(t: Tables):
    return t.conversations.select("conv_id", "turn", T.strip_numbering(F.col("text")).alias("q"))


@query("SELECT doc_id, regexp_replace(replace(replace(text, 'Ġ', ' '), 'Ċ', chr(10)), '\n{3,}', chr(10) || chr(10), 'g') AS code FROM documents")
def f32_clean_pieces(t: Tables):
    return t.documents.select("doc_id", F.regexp_replace(F.translate("text", "ĠĊ", " \n"), "\n{3,}", "\n\n").alias("code"))


@query(
    """WITH w AS (SELECT conv_id, turn, unnest(string_split(lower(text), ' ')) AS k FROM conversations), c AS (SELECT conv_id, turn, k, count(*) AS n FROM w GROUP BY ALL), s AS (SELECT conv_id, turn, sum(n) AS total FROM c GROUP BY ALL),
    h AS (SELECT a.conv_id, a.turn, sum(least(a.n, b.n)) AS common FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.k = b.k GROUP BY ALL)
    SELECT x.conv_id, x.turn, round(2 * coalesce(common, 0) / (x.total + y.total), 6) AS f1 FROM s x JOIN s y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1 LEFT JOIN h ON h.conv_id = x.conv_id AND h.turn = x.turn"""
)
def f34_token_f1(t: Tables):
    """Multiset overlap of the words of a turn and the next."""
    a = t.conversations.select("conv_id", "turn", F.split(F.lower("text"), " ").alias("x"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.split(F.lower("text"), " ").alias("y"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(S.multiset_f1(F.col("x"), F.col("y")), 6).alias("f1"))


@query("SELECT c_custkey, 'Name: ' || substr(c_name, 1, 12) || chr(10) || 'Segment: ' || c_mktsegment AS body FROM customer")
def f35_serialise(t: Tables):
    return t.customer.select("c_custkey", F.concat(F.lit("Name: "), F.substring("c_name", 1, 12), F.lit("\nSegment: "), "c_mktsegment").alias("body"))


@query("SELECT p_partkey, '<s_brand>' || p_brand || '</s_brand><s_name>' || p_name || '</s_name>' AS tokens FROM part")
def f36_tagged(t: Tables):
    """Fields in order of their names, as nested tags."""
    tag = lambda k: F.concat(F.lit(f"<s_{k}>"), F.coalesce(F.col(f"p_{k}"), F.lit("")), F.lit(f"</s_{k}>"))
    return t.part.select("p_partkey", F.concat(*[tag(k) for k in sorted(("name", "brand"))]).alias("tokens"))


@query("SELECT l_orderkey, l_linenumber, greatest((year(l_shipdate) * 12 + month(l_shipdate)) - (year(o_orderdate) * 12 + month(o_orderdate)), 0)::BIGINT AS months FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def f37_months_between(t: Tables):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    ym = lambda c: F.date_format(c, "yyyy-MM")
    return j.select("l_orderkey", "l_linenumber", T.years_between(ym("o_orderdate"), ym("l_shipdate")).cast("long").alias("months"))


@query("SELECT event_id, ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS active FROM events")
def f38_active(t: Tables):
    last = t.events.agg(F.max("ts").alias("m"))
    return t.events.join(F.broadcast(last)).select("event_id", (F.col("ts") >= F.col("m") - F.expr("INTERVAL 7 DAYS")).alias("active"))


@query("SELECT event_id, round(1 / (1 + exp(-value / 100)), 6) AS s, round(log2(abs(value) + 1), 6) AS l, floor(value)::BIGINT AS f FROM events")
def f39_math(t: Tables):
    v = F.col("value")
    return t.events.select("event_id", F.round(1 / (1 + F.exp(-v / 100)), 6).alias("s"), F.round(F.log2(F.abs(v) + 1), 6).alias("l"), F.floor(v).alias("f"))


@query(r"SELECT doc_id, (CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END)::BIGINT AS words FROM documents WHERE text IS NOT NULL")
def f40_word_count(t: Tables):
    return t.documents.filter("text IS NOT NULL").select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"))


@query("SELECT conv_id, turn, regexp_matches(lower(text), 'i cannot|i can''t|i''m sorry|as an ai|i am unable') AS refused FROM conversations")
def f41_refusal(t: Tables):
    return t.conversations.select("conv_id", "turn", T.has_any(F.col("text")).alias("refused"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c) WHERE r = 1")
def f42_dominant(t: Tables):
    c = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return c.select("user_id", S.best_key(F.col("m")).alias("dominant"))


@query("SELECT conv_id, list_slice(list(turn ORDER BY turn), 1, 8) AS first_batch, list_slice(list(turn ORDER BY turn), 9, 15) AS second_batch FROM conversations GROUP BY 1")
def f43_batches(t: Tables):
    g = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("x"))
    return g.select("conv_id", F.slice("x", 1, 8).alias("first_batch"), F.slice("x", 9, 7).alias("second_batch"))


@query()
def a34_rouge_l(t: Tables):
    """Longest common subsequence of the words of a turn and the next."""
    a = t.conversations.select("conv_id", "turn", F.col("text").alias("x"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.rouge_l(F.col("x"), F.col("y")), 6).alias("rouge_l"))


@query(
    """WITH w AS (SELECT d.doc_id, list_transform(regexp_extract_all(lower(d.text), '[a-z0-9]+')[1:], lambda x: x) AS a, regexp_extract_all(lower(b.text), '[a-z0-9]+')[1:2] AS b FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id)
    SELECT doc_id, coalesce(list_min(list_filter(range(0, greatest(len(a) - len(b) + 1, 0)), lambda i: a[(i + 1)::INT:(i + len(b))::INT] = b)), -1)::BIGINT AS at FROM w"""
)
def c26_token_span(t: Tables):
    """First place of a short token run in a whole document, or -1."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    b = t.benchmark.select("item_id", F.slice(words("text"), 1, 2).alias("b"))
    j = t.documents.select("doc_id", words("text").alias("a")).join(maybe_broadcast(b), F.col("doc_id") % 40 == F.col("item_id"))
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size("a") - F.size("b"), F.lit(0))), lambda i: (F.get("a", i) == F.get("b", F.lit(0))) & (F.slice(F.col("a"), i + 1, F.size("b")) == F.col("b")))
    return j.select("doc_id", F.coalesce(F.array_min(places), F.lit(-1)).cast("long").alias("at"))


@query(
    """WITH p AS (SELECT conv_id AS doc_id, count(*) AS units, count(turn) - count(DISTINCT turn % 5) AS repeated, count(*) FILTER (turn * 150 + 100 > 1000) AS outside FROM conversations GROUP BY 1),
    g AS (SELECT doc_id, doc_id % 50 = 0 AS oracle, units, repeated, outside FROM documents LEFT JOIN p USING (doc_id))
    SELECT doc_id, 'oracle evidence' AS issue, 1::BIGINT AS n FROM g WHERE oracle UNION ALL SELECT doc_id, 'repeated ids', 1 FROM g WHERE repeated > 0
    UNION ALL SELECT doc_id, 'no units', 1 FROM g WHERE units IS NULL UNION ALL SELECT doc_id, 'box out of bounds', outside FROM g WHERE outside > 0"""
)
def c21_validate_sequences(t: Tables):
    """Turns as units with boxes further down the page: repeated ids, empty documents, bounds of boxes, oracle evidence."""
    at = F.col("turn") * 150
    units = t.conversations.select(F.col("conv_id").alias("doc_id"), (F.col("turn") % 5).alias("unit"), F.array(at, F.lit(0), at + 100, F.lit(50)).alias("box"))
    return Q.graph_issues(t.documents.select("doc_id", (F.col("doc_id") % 50 == 0).alias("oracle")), units, "doc_id", "unit", "box", "oracle")
