"""Nested records built from the driver tables: repair, merging, assembly, scoring, routing, splits, alignment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import matching as X
from quillon.functions import text as T
from quillon.operators import metrics as M
from quillon.operators import records as C
from quillon.operators.relations import dealt
from quillon.operators.retrieval import profile_scores
from quillon.plans.registry import Tables, query
from quillon.sources import files as FS

# Work records of a customer: one an order, with gaps by the order's key.
_WORK_CTE = """w AS (SELECT o_custkey, o_orderkey,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS job_title, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'Firm ' || o_orderstatus END AS company,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m') END AS start_date, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN 'present' ELSE strftime(o_orderdate + INTERVAL 1 YEAR, '%Y-%m') END AS end_date,
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m') || ' to ' || strftime(o_orderdate + INTERVAL 2 YEAR, '%Y-%m') WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y') || ' - Present' ELSE '' END AS duration FROM orders)"""


def _work(t: Tables):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    ym = lambda c: F.date_format(c, "yyyy-MM")
    later = lambda n: F.add_months(d.cast("date"), 12 * n)
    return t.orders.select(
        "o_custkey",
        "o_orderkey",
        F.struct(
            F.when(k % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("job_title"),
            F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("Firm "), "o_orderstatus")).alias("company"),
            F.when(k % 3 == 0, "").otherwise(ym(d)).alias("start_date"),
            F.when(k % 4 == 0, "").when(k % 4 == 1, "present").otherwise(ym(later(1))).alias("end_date"),
            F.when(k % 2 == 0, F.concat(ym(d), F.lit(" to "), ym(later(2)))).when(k % 3 == 0, F.concat(F.date_format(d, "yyyy"), F.lit(" - Present"))).otherwise("").alias("duration"),
        ).alias("r"),
    )


_REPAIR_CTE = (
    _WORK_CTE
    + r""", h AS (SELECT *, CASE WHEN lower(end_date) = 'present' THEN 'Present' ELSE end_date END AS e0, regexp_extract_all(duration, '\b(?:19|20)[0-9]{2}(?:-[0-9]{2})?\b') AS m FROM w),
i AS (SELECT *, coalesce(m[1], '') AS f, CASE WHEN regexp_matches(duration, '(?i)\b(present|current|now)\b') THEN 'Present' WHEN len(m) >= 2 THEN m[-1] ELSE '' END AS l FROM h),
j AS (SELECT *, CASE WHEN start_date = '' THEN f ELSE start_date END AS s FROM i),
k AS (SELECT *, CASE WHEN l <> '' THEN l WHEN s <> '' AND f <> '' AND f <> s THEN f ELSE '' END AS inf FROM j),
rep AS (SELECT *, CASE WHEN e0 = '' THEN inf ELSE e0 END AS e FROM k),
fin AS (SELECT *, CASE WHEN s <> '' AND e <> '' THEN s || ' - ' || e ELSE duration END AS d2, (start_date = '' AND f <> '')::INT AS ev1, (e0 = '' AND inf <> '')::INT AS ev2, (s <> '' AND e <> '' AND duration <> s || ' - ' || e)::INT AS ev3 FROM rep)"""
)


@query(f"WITH {_REPAIR_CTE} SELECT o_orderkey, s AS start_date, e AS end_date, d2 AS duration, (ev1 + ev2 + ev3)::BIGINT AS events FROM fin")
def f20_repair_work(t: Tables):
    """Dates filled from durations, durations rebuilt from dates."""
    x = _work(t).select("o_orderkey", C.repair_work(F.col("r")).alias("x"))
    return x.select("o_orderkey", "x.record.start_date", "x.record.end_date", "x.record.duration", F.size("x.events").cast("long").alias("events"))


@query(f"WITH {_REPAIR_CTE} SELECT count(DISTINCT o_custkey) AS documents, sum(ev1)::BIGINT AS work_start_date_repaired, sum(ev2)::BIGINT AS work_end_date_repaired, sum(ev3)::BIGINT AS work_duration_normalized, count(*) FILTER (ev1 + ev2 + ev3 > 0) AS repaired FROM fin")
def c14_repair_summary(t: Tables):
    x = _work(t).select("o_custkey", C.repair_work(F.col("r"))["events"].alias("e"))
    n = lambda k: F.count_if(F.array_contains("e", k)).alias(k)
    return x.agg(F.count_distinct("o_custkey").alias("documents"), *[n(k) for k in C.EVENTS], F.count_if(F.size("e") > 0).alias("repaired"))


def _documents(t: Tables):
    return _work(t).groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "r"))), lambda x: x["r"]).alias("work"))


@query(
    f"""WITH {_WORK_CTE}, n AS (SELECT *, (job_title <> '')::INT + (company <> '')::INT + (start_date <> '')::INT + (end_date <> '')::INT + (duration <> '')::INT AS filled, trim(concat_ws(' ', job_title, company)) AS nm FROM w)
    SELECT o_custkey, count(*) AS record_count, count(*) FILTER (filled >= 4) AS complete, count(*) FILTER (filled BETWEEN 1 AND 3) AS partial, count(*) FILTER (job_title = '') AS empty_title, count(*) FILTER (company = '') AS empty_company,
    count(*) FILTER (start_date <> '' OR end_date <> '' OR duration <> '') AS has_dates, count(*) FILTER (regexp_matches(nm, '[^A-Za-z0-9 .,&+/#()\\-–—]')) + count(*) FILTER (regexp_matches(nm, '[a-z][A-Z]|[A-Z]{{2,}}[a-z]{{2,}}[A-Z]{{2,}}')) AS suspicious FROM n GROUP BY 1"""
)
def a28_work_features(t: Tables):
    return _documents(t).select("o_custkey", *[c.cast("long").alias(k) for k, c in C.work_features(F.col("work")).items()])


@query()
def w8_merge_neighbours(t: Tables):
    """Neighbouring parts of a record put together: rows before and after."""
    d = _documents(t)
    return d.select("o_custkey", F.size("work").alias("before"), C.merge_work(F.col("work")).alias("m")).select("o_custkey", "before", F.size("m").alias("after"), F.get("m", F.lit(0))["duration"].alias("first_duration"))


@query(
    f"""WITH {_REPAIR_CTE}, a AS (SELECT o_custkey, count(*) FILTER ((job_title <> '')::INT + (company <> '')::INT + (start_date <> '')::INT + (end_date <> '')::INT + (duration <> '')::INT >= 4) AS old, count(*) FILTER ((job_title <> '')::INT + (company <> '')::INT + (s <> '')::INT + (e <> '')::INT + (d2 <> '')::INT >= 4) AS new FROM fin GROUP BY 1)
    SELECT o_custkey, new > old AS taken FROM a"""
)
def c9_selective_replacement(t: Tables):
    """Repaired records replace the old ones where more of them are complete."""
    d = _documents(t).withColumn("other", F.transform("work", lambda r: C.repair_work(r)["record"]))
    return d.select("o_custkey", C.accept(F.col("work"), F.col("other")).alias("taken"))


@query(
    """WITH c AS (SELECT l_orderkey AS doc, l_returnflag AS kind, l_linenumber % 2 AS idx, l_linestatus AS field, l_partkey::VARCHAR AS value, l_discount AS conf, l_linenumber::BIGINT * 1000000000 + l_partkey AS ord FROM lineitem),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, kind, idx, field ORDER BY conf DESC, ord) AS n FROM c) WHERE n = 1)
    SELECT doc, kind, count(DISTINCT idx) AS records, count(*) AS fields, max(value) AS last_value FROM b GROUP BY ALL"""
)
def c4_assemble_records(t: Tables):
    """Candidates to kind, record and field; the most confident value wins, the first among equals."""
    c = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("kind"), (F.col("l_linenumber") % 2).alias("idx"), F.col("l_linestatus").alias("field"), F.col("l_partkey").cast("string").alias("value"), F.col("l_discount").alias("conf"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey")).alias("ord"))
    a = C.assemble(c, "doc", "kind", "idx", "field", "value", "conf", "ord")
    each = F.flatten(F.transform("records", lambda r: r["fields"]))
    return a.select("doc", "kind", F.size("records").cast("long").alias("records"), F.size(each).cast("long").alias("fields"), F.array_max(F.transform(each, lambda e: e["value"])).alias("last_value"))


_PAIRS_CTE = """p AS (SELECT o_orderkey AS doc, unnest(['status', 'priority', 'phone']) AS field,
  unnest([lower(trim(o_orderstatus)) = lower(trim(CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END)), CASE WHEN o_orderkey % 4 = 0 THEN false ELSE true END, o_orderkey % 9 <> 0]) AS hit FROM orders)"""


def _pairs(t: Tables):
    """Truth and found values of three fields of an order, as long rows."""
    k = F.col("o_orderkey")
    phone = F.concat(F.lit("+1 212 555 "), F.lpad((k % 10000).cast("string"), 4, "0"))
    rows = F.array(
        F.struct(F.lit("status").alias("field"), F.lit("text").alias("metric"), F.col("o_orderstatus").alias("truth"), F.when(k % 6 == 0, "X").otherwise(F.lower("o_orderstatus")).alias("found")),
        F.struct(F.lit("priority").alias("field"), F.lit("text").alias("metric"), F.col("o_orderpriority").alias("truth"), F.when(k % 4 == 0, "").otherwise(F.col("o_orderpriority")).alias("found")),
        F.struct(F.lit("phone").alias("field"), F.lit("phone").alias("metric"), phone.alias("truth"), F.when(k % 9 == 0, "none").otherwise(F.regexp_replace(phone, " ", "-")).alias("found")),
    )
    return t.orders.select(F.col("o_orderkey").alias("doc"), F.explode(rows).alias("x")).select("doc", "x.*")


def _scored(t: Tables):
    hit = F.when(F.col("metric") == "phone", T.normalize_phone(F.col("truth")) == T.normalize_phone(F.col("found"))).otherwise(T.normalize_email(F.col("truth")) == T.normalize_email(F.col("found")))
    supported = F.when(F.col("found") == "", F.lit(None)).otherwise(F.col("found") != "none")
    return _pairs(t).select("doc", "field", hit.cast("double").alias("score"), supported.alias("supported"))


@query(f"WITH {_PAIRS_CTE} SELECT doc, round(avg(hit::INT), 6) AS macro, round(coalesce(avg(CASE WHEN field = 'priority' AND doc % 4 = 0 THEN NULL WHEN field = 'phone' AND doc % 9 = 0 THEN 1 ELSE 0 END), 0), 6) AS unsupported_rate, count(*) AS fields FROM p GROUP BY 1")
def c1_evaluate_documents(t: Tables):
    """Fields scored by their own metric, then documents."""
    d = C.field_scores(_scored(t), "doc")
    return d.select("doc", F.round("macro", 6).alias("macro"), F.round("unsupported_rate", 6).alias("unsupported_rate"), "fields")


@query(f"WITH {_PAIRS_CTE} SELECT count(DISTINCT doc) AS documents, round(avg(hit::INT), 6) AS micro FROM p")
def c2_corpus_scores(t: Tables):
    return C.corpus_scores(C.field_scores(_scored(t), "doc")).select("documents", F.round("micro", 6).alias("micro"))


@query()
def f9_object_similarity(t: Tables):
    """Mean of component scores by kind of field: fuzzy text, exact phone."""
    s = F.when(F.col("metric") == "phone", (T.normalize_phone(F.col("truth")) == T.normalize_phone(F.col("found"))).cast("double")).otherwise(X.anls(F.lower("truth"), F.lower("found")))
    return _pairs(t).withColumn("s", s).groupBy("doc").agg(F.round(F.avg("s"), 6).alias("similarity"))


_ROUTE_CTE = """r AS (SELECT l_orderkey AS doc, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS b, count(*) FILTER (l_returnflag = 'N') AS c, sum(l_quantity) FILTER (l_returnflag = 'A') AS qa, sum(l_quantity) FILTER (l_returnflag = 'R') AS qb FROM lineitem GROUP BY 1)"""


def _route(t: Tables):
    flag = lambda f: F.col("l_returnflag") == f
    return t.lineitem.groupBy(F.col("l_orderkey").alias("doc")).agg(*[F.count_if(flag(f)).alias(n) for f, n in (("A", "a"), ("R", "b"), ("N", "c"))], *[F.sum(F.when(flag(f), F.col("l_quantity"))).alias(n) for f, n in (("A", "qa"), ("R", "qb"))])


@query(f"WITH {_ROUTE_CTE} SELECT doc, (qa IS DISTINCT FROM qb) AND a = b AS work, (qa IS DISTINCT FROM qb) AND a > 0 AND a <> b AS certifications FROM r")
def c17_route_fields(t: Tables):
    differs = ~F.col("qa").eqNullSafe(F.col("qb"))
    return _route(t).select("doc", C.route("work_experience", differs, F.col("a"), F.col("b")).alias("work"), C.route("certifications", differs, F.col("a"), F.col("b")).alias("certifications"))


@query(f"WITH {_ROUTE_CTE}, f AS (SELECT doc, c > 0 AND coalesce(qa, 0) * 10 <= 383 AS w, c > 0 AND a > 0 AS k, coalesce(qa, 0) AS l1, coalesce(qb, 0) AS l2 FROM r) SELECT doc, w::INT::BIGINT + k::INT AS routed, round(l1 + CASE WHEN w OR k THEN l2 ELSE 0 END, 4) AS latency FROM f")
def c18_selective_router(t: Tables):
    """Routed fields and the latency of one or both results."""
    chars = F.coalesce("qa", F.lit(0.0)) * 10
    w = C.route_primary_only("work_experience", F.col("a"), chars, F.col("c") > 0)
    k = C.route_primary_only("certifications", F.col("a"), chars, F.col("c") > 0)
    f = _route(t).select("doc", w.alias("w"), k.alias("k"), F.coalesce("qa", F.lit(0.0)).alias("l1"), F.coalesce("qb", F.lit(0.0)).alias("l2"))
    return f.select("doc", (F.col("w").cast("long") + F.col("k").cast("long")).alias("routed"), F.round(F.col("l1") + F.when(F.col("w") | F.col("k"), F.col("l2")).otherwise(0.0), 4).alias("latency"))


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part")
def p29_row_codec(t: Tables):
    """Records to positional rows and back."""
    fields = ("p_name", "p_brand", "p_type")
    r = t.part.select("p_partkey", C.from_rows(C.to_rows(F.array(F.struct(*fields)), fields), fields)[0].alias("r"))
    return r.select("p_partkey", "r.*")


@query(
    """SELECT p_partkey, length('Parts of ' || p_brand) >= 10 AND len(list_distinct([lower(p_name), lower(p_brand), lower(p_type), CASE WHEN p_size % 9 = 0 THEN lower(p_name) ELSE p_size::VARCHAR END])) = 4 AND NOT (length(p_name) > 4 AND p_partkey % 5 = 0) AS valid FROM part"""
)
def p16_mcq_validator(t: Tables):
    q = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("What is a "), "p_name", F.lit("?"))).otherwise(F.lit("Which part is it?"))
    choices = F.array("p_name", "p_brand", "p_type", F.when(F.col("p_size") % 9 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string")))
    return t.part.select("p_partkey", C.valid_mcq(F.concat(F.lit("Parts of "), "p_brand"), q, choices, F.col("p_name")).alias("valid"))


@query()
def p17_essay_validator(t: Tables):
    """A turn as the answer to the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = t.conversations.select("conv_id", "turn", F.lag("text").over(w).alias("q"), F.col("text").alias("a"))
    return x.filter("q IS NOT NULL").select("conv_id", "turn", C.valid_essay(F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")), F.col("q"), F.col("a")).alias("valid"))


@query()
def p18_rubric_validator(t: Tables):
    """Sentences of a document as the questions of a rubric."""
    qs = F.transform(F.split("text", r"\."), lambda s: F.concat(F.trim(s), F.lit("?")))
    return t.documents.select("doc_id", C.valid_rubric(F.col("text"), qs).alias("valid"))


@query(
    """WITH th AS (SELECT l_discount AS threshold, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS w FROM lineitem GROUP BY 1), c AS (SELECT threshold, sum(n) OVER o AS routed, sum(w) OVER o AS wins, sum(n) OVER () AS total FROM th WINDOW o AS (ORDER BY threshold)),
    f AS (SELECT threshold, routed, wins, wins - (routed - wins) AS net, wins / routed AS precision_ FROM c WHERE routed / total <= 0.45 AND wins / routed >= 0.2)
    SELECT threshold, net::BIGINT AS net, round(precision_, 6) AS precision_ FROM f ORDER BY net DESC, precision_ DESC, threshold LIMIT 3"""
)
def o5_top_thresholds(t: Tables):
    """The three best thresholds of bounded coverage and sufficient precision."""
    th = t.lineitem.groupBy(F.col("l_discount").alias("threshold")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("w"))
    c = M.running(th, [F.col("threshold")], {"routed": "n", "wins": "w"})
    c = c.join(F.broadcast(c.agg(F.max("routed").alias("total"))))
    f = c.filter((F.col("routed") / F.col("total") <= 0.45) & (F.col("wins") / F.col("routed") >= 0.2)).select("threshold", (2 * F.col("wins") - F.col("routed")).alias("net"), (F.col("wins") / F.col("routed")).alias("p"))
    return f.orderBy(F.col("net").desc(), F.col("p").desc(), "threshold").limit(3).select("threshold", "net", F.round("p", 6).alias("precision_"))


@query(
    r"""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9+#.]+')) AS toks FROM documents), o AS (SELECT lang, doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9+#.]+'))) AS term FROM documents),
    g AS (SELECT lang, term, count(*) AS c FROM o GROUP BY ALL), f AS (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY c DESC, term) AS n FROM g), p AS (SELECT lang AS profile, list(term ORDER BY term) AS terms FROM f WHERE n <= 12 GROUP BY 1)
    SELECT doc_id, profile, len(list_intersect(toks, terms))::BIGINT AS score FROM d CROSS JOIN p"""
)
def j13_score_all_profiles(t: Tables):
    """Every document against every profile, zero scores kept: the profiles are one row a language."""
    d = t.documents.select("doc_id", "lang", F.array_distinct(T.tokenize(F.col("text"))).alias("toks"))
    f = d.select("lang", F.explode("toks").alias("term")).groupBy("lang", "term").agg(F.count("*").alias("c"))
    f = f.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("c").desc(), "term"))).filter("n <= 12")
    p = f.groupBy(F.col("lang").alias("profile")).agg(F.collect_set("term").alias("terms"))
    return profile_scores(d, p, "doc_id", "toks", "profile", "terms", zeros=True)


@query("SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, round(1 / (1 + abs(a.l_quantity - b.l_quantity)), 6) AS sim FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'R'")
def j14_similarity_matrix(t: Tables):
    """Truth items by found items of each document."""
    g = t.lineitem.groupBy("l_orderkey").agg(*[F.collect_list(F.when(F.col("l_returnflag") == f, F.struct("l_linenumber", "l_quantity"))).alias(n) for f, n in (("A", "x"), ("R", "y"))])
    m = g.select("l_orderkey", F.explode("x").alias("x"), "y").select("l_orderkey", "x", F.explode("y").alias("y"))
    return m.select("l_orderkey", F.col("x.l_linenumber").alias("i"), F.col("y.l_linenumber").alias("j"), F.round(1 / (1 + F.abs(F.col("x.l_quantity") - F.col("y.l_quantity"))), 6).alias("sim"))


@query()
def j16_constrained_groups(t: Tables):
    """Lines of an order joined by likely pairs, no group with a flag twice."""
    rows = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("at"), F.col("l_returnflag").alias("field"))
    a = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("a"), F.col("l_quantity").alias("qa"))
    b = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("b"), F.col("l_quantity").alias("qb"))
    pairs = a.join(b, "l_orderkey").filter("a < b").select("l_orderkey", "a", "b", (1 / (1 + F.abs(F.col("qa") - F.col("qb")) / 10)).alias("p"))
    return C.constrained_groups(rows, pairs, "l_orderkey", "at", "field")


@query(
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem), s AS (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber <= 3)
    SELECT v.l_orderkey, round(avg((s.l_orderkey IS NOT NULL)::INT), 6) AS coverage, bool_and(s.l_orderkey IS NOT NULL) AS all_covered FROM v LEFT JOIN s USING (l_orderkey, l_returnflag) GROUP BY 1"""
)
def a26_span_coverage(t: Tables):
    """Share of the values that some early span of the document holds."""
    spans = t.lineitem.filter("l_linenumber <= 3").select("l_orderkey", "l_returnflag").distinct().withColumn("hit", F.lit(True))
    v = t.lineitem.select("l_orderkey", "l_returnflag").join(spans, ["l_orderkey", "l_returnflag"], "left").withColumn("hit", F.col("hit").isNotNull())
    return v.groupBy("l_orderkey").agg(F.round(F.avg(F.col("hit").cast("int")), 6).alias("coverage"), F.bool_and("hit").alias("all_covered"))


@query(
    """WITH c AS (SELECT l_orderkey, avg((l_linenumber <= 5)::INT) AS x FROM lineitem GROUP BY 1) SELECT l_orderkey, round(x, 6) AS coverage FROM c WHERE x >= 0.95 ORDER BY x DESC, l_orderkey LIMIT 25"""
)
def a29_eligible_top(t: Tables):
    """The 25 best covered documents of at least 0.95."""
    c = t.lineitem.groupBy("l_orderkey").agg(F.avg((F.col("l_linenumber") <= 5).cast("int")).alias("x"))
    return c.filter("x >= 0.95").orderBy(F.col("x").desc(), "l_orderkey").limit(25).select("l_orderkey", F.round("x", 6).alias("coverage"))


@query(
    """WITH a AS (SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS v FROM events UNION ALL SELECT event_id, 'type', event_type FROM events), b AS (SELECT event_id, 'k' AS key, CASE WHEN event_id % 5 = 0 THEN '0' ELSE json_extract_string(props, '$.k') END AS v FROM events UNION ALL SELECT event_id, 'extra', 'x' FROM events WHERE event_id % 7 = 0),
    j AS (SELECT coalesce(a.event_id, b.event_id) AS e, coalesce(a.key, b.key) AS key, a.v AS t, b.v AS p FROM a FULL JOIN b ON a.event_id = b.event_id AND a.key = b.key)
    SELECT key, count(t) AS wanted, count(p) AS found, count(*) FILTER (t IS NOT NULL AND p IS NOT NULL) AS both_, round(coalesce(count(*) FILTER (t = p) / nullif(count(t), 0), 0), 6) AS accuracy FROM j GROUP BY 1"""
)
def a30_open_schema_metrics(t: Tables):
    """Keys and values of open records, wanted and found."""
    m = F.from_json("props", "map<string,string>")
    want = t.events.select("event_id", F.explode(F.map_concat(m, F.create_map(F.lit("type"), F.col("event_type")))).alias("key", "t"))
    wrong = F.transform_values(m, lambda k, v: F.when(F.col("event_id") % 5 == 0, "0").otherwise(v))
    more = F.when(F.col("event_id") % 7 == 0, F.create_map(F.lit("extra"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    got = t.events.select("event_id", F.explode(F.map_concat(wrong, more)).alias("key", "p"))
    j = want.join(got, ["event_id", "key"], "full_outer")
    return j.groupBy("key").agg(F.count("t").alias("wanted"), F.count("p").alias("found"), F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("both_"), F.round(F.when(F.count("t") > 0, F.count_if(F.col("t") == F.col("p")) / F.count("t")).otherwise(0.0), 6).alias("accuracy"))


@query("WITH f AS (SELECT source, lang, min(doc_id) AS a FROM documents GROUP BY ALL) SELECT source, list(lang ORDER BY a) AS langs FROM f GROUP BY 1")
def a48_provenance_lists(t: Tables):
    f = t.documents.groupBy("source", "lang").agg(F.min("doc_id").alias("a"))
    return f.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "lang"))), lambda x: x["lang"]).alias("langs"))


@query(
    """WITH c AS (SELECT *, CASE WHEN l_returnflag IS DISTINCT FROM lag(l_returnflag) OVER w OR lag(l_linestatus) OVER w = 'F' THEN 1 ELSE 0 END AS new FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS g FROM c) SELECT l_orderkey, g::BIGINT AS grp, l_returnflag, count(*) AS rows, min(l_linenumber) AS first FROM i GROUP BY ALL"""
)
def w5_split_islands(t: Tables):
    """Runs of equal flags, cut after rows that end a part."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    new = (~F.col("l_returnflag").eqNullSafe(F.lag("l_returnflag").over(w)) | F.coalesce(F.lag("l_linestatus").over(w) == "F", F.lit(False))).cast("int")
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"]
    g = dealt(t.lineitem.select(*columns), "l_orderkey").withColumn("new", new).withColumn("grp", F.sum("new").over(w))
    return g.groupBy("l_orderkey", "grp", "l_returnflag").agg(F.count("*").alias("rows"), F.min("l_linenumber").alias("first"))


@query(
    """WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag || CASE WHEN lead(l_quantity) OVER w - l_quantity > 5 THEN ' ' ELSE '' END AS piece FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity))
    SELECT l_orderkey, string_agg(piece, '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS line FROM g GROUP BY 1"""
)
def w10_gap_spaces(t: Tables):
    """Pieces put together, with a space where the gap to the next is wide."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    wide = F.coalesce(F.lead("l_quantity").over(w) - F.col("l_quantity") > 5, F.lit(False))
    g = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.concat("l_returnflag", F.when(wide, " ").otherwise("")).alias("piece"))
    return g.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "piece"))), lambda x: x["piece"]), "").alias("line"))


@query("WITH u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), v AS (SELECT doc_id, i, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) AS j FROM u) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS place, word FROM v")
def w15_reading_order(t: Tables):
    """Words numbered over lines and places in a line."""
    u = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    v = u.select("doc_id", "i", F.posexplode(F.split("line", " ")).alias("j", "word"))
    return v.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("i", "j")).cast("long").alias("place"), "word")


@query("SELECT conv_id, role, unnest(list(turn ORDER BY turn)) AS turn FROM conversations GROUP BY conv_id, role")
def u8_explode_nested(t: Tables):
    """A map of arrays to rows."""
    g = t.conversations.groupBy("conv_id", "role").agg(F.collect_list("turn").alias("x")).groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "x"))).alias("m"))
    return g.select("conv_id", F.explode("m").alias("role", "x")).select("conv_id", "role", F.explode("x").alias("turn"))


@query(
    """WITH r AS (SELECT p_partkey, unnest(['p_name', 'p_brand', 'p_type']) AS path, unnest([p_name, p_brand, p_type]) AS value, unnest([1, 2, 3]) AS o FROM part) SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY o) AS place, path, value FROM r WHERE value IS NOT NULL AND value <> ''"""
)
def f15_flatten_record(t: Tables):
    """A record as ordered rows of path and value."""
    fields = ("p_name", "p_brand", "p_type")
    rows = F.array(*[F.struct(F.lit(k).alias("path"), F.col(k).alias("value")) for k in fields])
    r = t.part.select("p_partkey", F.posexplode(F.filter(rows, lambda x: x["value"].isNotNull() & (x["value"] != ""))).alias("i", "x"))
    return r.select("p_partkey", (F.col("i") + 1).cast("long").alias("place"), "x.path", "x.value")


@query()
def f17_spread_words(t: Tables):
    """Words of a name with their shares of a box of 1000."""
    s = t.part.select("p_partkey", F.explode(C.spread_words(F.col("p_name"), F.lit(0), F.lit(1000))).alias("x"))
    return s.select("p_partkey", "x.word", "x.x0", "x.x1")


@query("SELECT conv_id, json_extract_string(j, '$.role') AS role FROM (SELECT conv_id, turn, '{\"role\": \"' || role || '\"}' AS j FROM conversations)")
def f26_fenced_json(t: Tables):
    """An object inside fences, words and a trailing comma."""
    raw = F.concat(F.lit("Here: ```json\n{\"role\": \""), "role", F.lit("\",}\n``` done"))
    body = F.regexp_replace(F.regexp_extract(raw, r"(?s)\{.*\}", 0), r",\s*\}", "}")
    return t.conversations.select("conv_id", F.get_json_object(body, "$.role").alias("role"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def f27_nested_or_flat(t: Tables):
    """A value that stands at the top or one level down."""
    j = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"result": '), "props", F.lit("}"))).otherwise(F.col("props"))
    return t.events.select("event_id", F.coalesce(F.get_json_object(j, "$.result.k"), F.get_json_object(j, "$.k")).alias("k"))


@query("SELECT n_nationkey, n_name FROM nation")
def s2_json_documents(t: Tables):
    """Documents of several lines."""
    path = FS.shared_folder(t.spark, "documents")
    whole = t.nation.agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name")), {"pretty": "true"}).alias("value"))
    whole.write.text(path)
    return t.spark.read.schema("n_nationkey int, n_name string").option("multiLine", True).json(path)


@query("SELECT n_name, r_name AS topic FROM nation JOIN region ON r_regionkey = n_regionkey")
def s13_topics_from_paths(t: Tables):
    """Topics as the names of folders."""
    path = FS.shared_folder(t.spark, "topics")
    t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.col("r_name").alias("topic")).write.partitionBy("topic").json(path)
    back = t.spark.read.schema("n_name string").option("recursiveFileLookup", True).json(path)
    return back.select("n_name", F.url_decode(F.regexp_extract("_metadata.file_path", "topic=([^/]+)/", 1)).alias("topic"))


@query("SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'english' WHEN contains(url, '/fr/') THEN 'french' ELSE 'other' END AS label FROM pages")
def s14_label_from_path(t: Tables):
    return t.pages.select("page_id", F.when(F.col("url").contains("/en/"), "english").when(F.col("url").contains("/fr/"), "french").otherwise("other").alias("label"))


@query("SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN d.text ELSE p.html END AS body FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id")
def s15_lanes(t: Tables):
    """The text of the lane that each document asks for."""
    lanes = t.documents.select("doc_id", F.lit("text").alias("lane"), F.col("text").alias("body")).union(t.pages.select(F.col("page_id").alias("doc_id"), F.lit("page").alias("lane"), F.col("html").alias("body")))
    want = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "text").otherwise("page").alias("lane"))
    return want.join(lanes, ["doc_id", "lane"], "left").select("doc_id", "body")


@query("SELECT 'train' AS split, count(*) AS n FROM documents WHERE lang <> 'es'")
def s17_guarded_manifest(t: Tables):
    """Open splits are read; a locked one asks for confirmation."""
    try:
        FS.guarded(lambda: t.documents, "locked_confirmation")
    except FS.LockedSplit:
        pass
    return FS.guarded(lambda: t.documents.filter("lang <> 'es'"), "train").agg(F.count("*").alias("n")).select(F.lit("train").alias("split"), "n")


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 3")
def s20_summaries(t: Tables):
    """Summaries below a folder that have a mode."""
    path = FS.shared_folder(t.spark, "summaries")
    t.region.select("r_regionkey", F.struct("r_regionkey", "r_name", F.when(F.col("r_regionkey") != 3, "full").alias("mode")).alias("s")).select(F.col("r_regionkey").alias("run"), "s.*").write.partitionBy("run").json(path)
    back = t.spark.read.schema("r_regionkey int, r_name string, mode string").option("recursiveFileLookup", True).json(path)
    return back.filter("mode IS NOT NULL").select("r_regionkey", "r_name")


@query("SELECT o_orderkey FROM orders")
def k5_merged_parts(t: Tables):
    path, whole = FS.shared_folder(t.spark, "parts"), FS.shared_folder(t.spark, "whole")
    FS.write_parts(t.orders.select("o_orderkey"), path, 4)
    FS.merge_parts(t.spark.read.schema("o_orderkey bigint").json(path), path, whole)
    return t.spark.read.schema("o_orderkey bigint").json(whole)


@query("SELECT count(*) AS lines, 1::BIGINT AS bold FROM region")
def k13_markdown(t: Tables):
    """A report of a few rows, rendered with its best value in bold."""
    rows = [r.asDict() for r in t.region.select("r_name", (F.col("r_regionkey") / 10).alias("score")).limit(100).collect()]
    text = FS.markdown(rows, ["score"])
    return t.spark.createDataFrame([(text,)], "text string").select((F.size(F.split("text", "\n")) - 2).cast("long").alias("lines"), F.size(F.filter(F.split("text", "\n"), lambda x: x.contains("**"))).cast("long").alias("bold"))


@query("SELECT sha256(concat_ws(chr(31), '20260609', 'bm25', '1.5', '0.75')) AS run_id, true AS same")
def k14_resume_guard(t: Tables):
    """A run continues only under the digest of its own configuration."""
    now = T.stable_hash(F.lit("bm25"), F.lit(1.5), F.lit(0.75))
    r = t.spark.range(1).select(now.alias("run_id"), T.stable_hash(F.lit("bm25"), F.lit(1.5), F.lit(0.75)).alias("kept"))
    return r.select("run_id", (F.col("run_id") == F.col("kept")).alias("same"))
