"""Composite pipelines of several operators, samplers, and hooks for user functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import documents as D
from quillon.operators import evaluation as V
from quillon.operators import evidence as E
from quillon.operators import judging as J
from quillon.operators import metrics as M
from quillon.operators import projects as P
from quillon.operators import records as C
from quillon.operators import relations as R
from quillon.operators import resampling as B
from quillon.operators import selection as S
from quillon.operators import sequences as Q
from quillon.operators import splits as SP
from quillon.plans.registry import Tables, query
from quillon.sources import files as FS
from quillon.streaming import incremental as I


def _candidates(t: Tables):
    """Lines of an order as candidates: a flag is the field, N the anchor."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_discount"]
    return R.dealt(t.lineitem.select(*columns), "l_orderkey").select(F.col("l_orderkey").alias("doc"), F.row_number().over(w).alias("at"), F.col("l_returnflag").alias("field"), F.col("l_partkey").cast("string").alias("value"), F.col("l_discount").alias("conf"))


@query()
def c6_decode_anchored(t: Tables):
    """Records opened by an anchor, with the most confident value of each field."""
    d = P.decode_anchored(_candidates(t), "doc", "at", "field", "value", "conf", "N")
    return d.select("doc", "grp", F.size("fields").alias("fields"), F.try_element_at("fields", F.lit("N")).alias("anchor"))


@query(
    """WITH e AS (SELECT p_partkey, list_filter([trim(p_name), trim(p_brand), trim(p_type)], lambda x: length(x) <= 32) AS v FROM part) SELECT p_partkey, v AS tools FROM e"""
)
def f21_technologies(t: Tables):
    """Pieces of two raw values in order, each once: the second repeats the first's."""
    raws = F.array(F.concat_ws(", ", "p_name", "p_brand", "p_type"), F.concat_ws("; ", "p_name", "p_type"))
    return t.part.select("p_partkey", P.technologies(raws, F.array(F.lit("nothing of it"))).alias("tools"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [p_brand, p_type] ELSE [p_brand] END AS tools FROM part")
def c12_replace_aligned(t: Tables):
    """Decoded values taken where the names agree."""
    cur = F.array(F.struct(F.col("p_name").alias("name"), F.array("p_brand").alias("technologies")))
    dec = F.array(F.struct(F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.concat(F.lit("x"), "p_name")).alias("name"), F.array("p_brand", "p_type").alias("technologies")))
    return t.part.select("p_partkey", P.replace_aligned(cur, dec)[0]["technologies"].alias("tools"))


_URL_SQL = """x AS (SELECT doc_id, lang, source, CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 2000 THEN 1 ELSE 2 END AS b, quality FROM documents LEFT JOIN labels USING (doc_id)),
a AS (SELECT lang, source, b, sum(quality) AS y, count(quality) AS n FROM x GROUP BY ALL), c AS (SELECT lang, b, sum(quality) AS y, count(quality) AS n FROM x GROUP BY ALL),
p AS (SELECT doc_id, source, CASE WHEN a.n >= 8 THEN (a.y + 1) / (a.n + 2) WHEN c.n >= 8 THEN (c.y + 1) / (c.n + 2) END AS p FROM x LEFT JOIN a USING (lang, source, b) LEFT JOIN c USING (lang, b))"""


@query(f"WITH {_URL_SQL} SELECT doc_id, CASE WHEN p >= 0.8 AND doc_id % 2 = 0 THEN 'https://github.com/owner/doc-' || doc_id ELSE '' END AS url FROM p")
def c13_fill_addresses(t: Tables):
    """Missing addresses made from owner and name, where such records mostly have one."""
    b = F.when(F.col("n_chars") < 500, 0).when(F.col("n_chars") < 2000, 1).otherwise(2)
    x = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "lang", "source", b.alias("b"), "quality")
    s = P.smoothed_back_off(x, x, ["lang", "source", "b"], ["lang", "b"], "quality")
    owner = F.when(F.col("doc_id") % 2 == 0, F.lit("owner"))
    return s.select("doc_id", P.filled_url(F.lit(""), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")), owner, F.col("p"), 0.8).alias("url"))


@query("SELECT event_id, event_type AS name, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'https://x.org' END AS url, CASE WHEN event_id % 4 = 0 THEN [] ELSE ['a', 'b'] END AS skills, ((event_id % 4 = 0)::INT + (event_id % 5 = 0)::INT)::BIGINT AS events FROM events")
def c15_coerce_records(t: Tables):
    """Open JSON objects to a closed schema, with events for what was changed."""
    k = F.col("event_id")
    raw = F.concat(
        F.lit('{"name": "'), "event_type", F.lit('", "url": '), F.when(k % 3 == 0, F.lit("null")).otherwise(F.lit('"https://x.org"')), F.lit(', "skills": '), F.when(k % 4 == 0, F.lit('"none"')).otherwise(F.lit('["a", " b ", ""]')), F.when(k % 5 == 0, F.lit(', "more": 1')).otherwise(F.lit("")), F.lit("}")
    )
    record, events = P.coerce(raw, ["name"], ["url"], ["skills"])
    return t.events.select("event_id", record.alias("r"), F.size(events).cast("long").alias("events")).select("event_id", "r.*", "events")


@query()
def w16_align_annotations(t: Tables):
    """The first two and the last word of a turn, found among its words."""
    words = F.filter(F.split(F.regexp_replace("text", r"\s+", " "), " "), lambda w: w != "")
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id")
    c = t.conversations.select(key, words.alias("w")).filter("size(w) > 3")
    tokens = c.select("doc_id", F.posexplode("w").alias("at", "text"))
    notes = F.array(F.struct(F.lit(0).alias("ord"), F.array_join(F.slice("w", 1, 2), " ").alias("text"), F.lit("start").alias("label")), F.struct(F.lit(1).alias("ord"), F.element_at("w", -1).alias("text"), F.lit("end").alias("label")))
    return P.align(tokens, c.select("doc_id", F.explode(notes).alias("n")).select("doc_id", "n.*"))


@query("SELECT doc_id, length(string_agg(text, ' ' ORDER BY turn, text)) AS n_chars FROM (SELECT conv_id AS doc_id, turn, text FROM conversations) GROUP BY 1")
def c3_grounded_rows(t: Tables):
    """Words of all pages of a document, in order, as one text."""
    g = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return g.select("doc_id", F.length(F.array_join(F.transform("x", lambda r: r["text"]), " ")).cast("long").alias("n_chars"))


@query("SELECT page_id, CASE WHEN length(html) > 3000 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN length(html) > 3000 THEN 'too_long' END AS reason FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def c23_materialise_outputs(t: Tables):
    """Rows with no output yet, split into completed and failed with a reason."""
    rest = R.pending(t.pages, t.labels.select(F.col("doc_id").alias("page_id")), ["page_id"])
    bad = F.length("html") > 3000
    return rest.select("page_id", F.when(bad, "failed").otherwise("completed").alias("status"), F.when(bad, "too_long").alias("reason"))


@query("SELECT 'overlap' AS issue, '*' AS part, count(*) AS n FROM documents WHERE lang = 'en' AND n_chars > 2000 UNION ALL SELECT 'missing', '*', count(*) FROM documents WHERE lang <> 'en' AND n_chars <= 2000")
def c25_validate_splits(t: Tables):
    """Parts that overlap and leave rows out."""
    parts = {"english": t.documents.filter("lang = 'en'"), "long": t.documents.filter("n_chars > 2000")}
    return R.set_report(parts, t.documents, "doc_id")


@query("WITH q AS (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 8 AS batch, role FROM conversations) SELECT conv_id, count(DISTINCT batch) AS batches, round(count(*) FILTER (role = 'user') / count(*), 6) AS score FROM q GROUP BY 1")
def c31_judge_batches(t: Tables):
    """Questions in batches of eight, answers merged back and scored."""
    q = Q.chunks(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn")], 8)
    return q.groupBy("conv_id").agg(F.count_distinct("chunk").alias("batches"), F.round(F.count_if(F.col("role") == "user") / F.count("*"), 6).alias("score"))


@query("SELECT d.doc_id, d.lang || chr(10) || d.text AS prompt, l.quality AS target FROM documents d JOIN labels l USING (doc_id)")
def p28_build_requests(t: Tables):
    """Manifest, text and truth joined to requests."""
    return t.documents.join(t.labels, "doc_id").select("doc_id", F.concat_ws("\n", "lang", "text").alias("prompt"), F.col("quality").alias("target"))


@query("SELECT o_orderkey, o_orderstatus AS first, o_orderpriority AS second FROM orders")
def j2_strict_pair(t: Tables):
    """First and second results of the same requests."""
    a, b = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("first")), t.orders.select("o_orderkey", F.col("o_orderpriority").alias("second"))
    return R.strict_join(a, b, "o_orderkey")


@query("SELECT doc_id, row_number() OVER (ORDER BY lang, n_chars DESC, doc_id) AS place FROM documents")
def o1_stable_sort(t: Tables):
    return R.numbered(t.documents.select("doc_id", "lang", "n_chars"), [F.col("lang"), F.col("n_chars").desc(), F.col("doc_id")], "place").select("doc_id", "place")


@query("SELECT source, avg(n_chars) AS m, row_number() OVER (ORDER BY avg(n_chars) DESC, source) AS place FROM documents GROUP BY 1")
def o2_leaderboard(t: Tables):
    b = t.documents.groupBy("source").agg(F.avg("n_chars").alias("m"))
    return b.withColumn("place", F.row_number().over(Window.orderBy(F.col("m").desc(), "source")).cast("long"))


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 20")
def o6_head(t: Tables):
    return t.events.orderBy("event_id").limit(20).select("event_id", "event_type")


_RH = "sha256(concat_ws(chr(31), '{s}', doc_id::VARCHAR))"


@query(f"SELECT doc_id, ntile(4) OVER (PARTITION BY lang ORDER BY {_RH.format(s='slice')}, doc_id) AS slice FROM documents")
def o12_ratio_slices(t: Tables):
    """Four equal slices of each class, by hash order."""
    d = t.documents.select("doc_id", "lang")
    r = S.cut_by_hash(d, "doc_id", ["lang"], T.stable_hash(F.col("doc_id"), seed="slice"), S.tile_cuts(d, ["lang"], 4))
    return r.select("doc_id", F.coalesce("cut", F.lit(4)).alias("slice"))


@query(f"WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY {_RH.format(s='holdout')}, doc_id) AS n, count(*) OVER () AS c FROM documents) SELECT doc_id FROM h WHERE n <= least(ceil(c * 0.1), 50)")
def o14_test_head(t: Tables):
    """The first fifty of a tenth held out by hash."""
    n = t.documents.agg(F.least(F.ceil(F.count("*") * 0.1), F.lit(50)).alias("k"))
    h = t.documents.select("doc_id").orderBy(T.stable_hash(F.col("doc_id"), seed="holdout"), "doc_id").limit(50)
    r = h.withColumn("n", F.row_number().over(Window.orderBy(T.stable_hash(F.col("doc_id"), seed="holdout"), "doc_id")))
    return r.join(F.broadcast(n)).filter(F.col("n") <= F.col("k")).select("doc_id")


@query()
def o16_weighted_draws(t: Tables):
    """Draws with replacement, longer documents more likely."""
    d = B.weighted_draws(t.documents, "doc_id", "n_chars", 200, "draws")
    return d.groupBy("doc_id").agg(F.count("*").alias("times"))


@query("SELECT n_regionkey AS region, count(*) AS files FROM nation GROUP BY 1")
def s10_keyed_tree(t: Tables):
    """Files of two kinds below a folder, one row a key with the digest of each kind."""
    path = FS.shared_folder(t.spark, "keyed")
    t.nation.repartition("n_regionkey").write.partitionBy("n_regionkey").json(path + "/a")
    t.nation.groupBy("n_regionkey").agg(F.count("*").alias("files")).write.partitionBy("n_regionkey").json(path + "/b")
    files = FS.read_tree(t.spark, path, r"n_regionkey=(\d+)/").filter("kind = 'json'").withColumn("kind", F.regexp_extract("path", "/([ab])/n_regionkey", 1))
    keyed = files.groupBy("key").pivot("kind", ["a", "b"]).agg(F.first("sha256"))
    counts = t.spark.read.json(path + "/b").select(F.col("n_regionkey").cast("string").alias("key"), "files")
    return keyed.filter("a IS NOT NULL AND b IS NOT NULL").join(counts, "key").select(F.col("key").cast("int").alias("region"), "files")


@query("SELECT o_orderkey, 'completed' AS status FROM orders")
def k3_checkpointed_append(t: Tables):
    """Half of the work, then the rest: what is done isn't done again."""
    path = FS.shared_folder(t.spark, "checkpointed")
    work = I.with_status(t.orders.select("o_orderkey"), F.lit(True))
    I.resume(work.filter("o_orderkey % 2 = 0"), path, ["o_orderkey"])
    I.resume(work, path, ["o_orderkey"])
    return t.spark.read.parquet(path)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def k6_csv_and_parquet(t: Tables):
    """Written as CSV, read, written as Parquet, read."""
    a, b = FS.shared_folder(t.spark, "as-csv"), FS.shared_folder(t.spark, "as-parquet")
    t.events.groupBy("event_type").agg(F.count("*").alias("n")).write.option("header", True).csv(a)
    t.spark.read.option("header", True).schema("event_type string, n bigint").csv(a).write.parquet(b)
    return t.spark.read.parquet(b)


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'error' ORDER BY user_id LIMIT 15")
def t6_quota_bounded(t: Tables):
    """Consumption that stops at its target."""
    return t.events.filter("event_type = 'error'").select("user_id").distinct().orderBy("user_id").limit(15)


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def t7_expiry(t: Tables):
    """Rows that haven't outlived their time, as of the last event."""
    last = t.events.agg(F.max("ts").alias("m"))
    return t.events.join(F.broadcast(last)).filter(F.col("ts") > F.col("m") - F.expr("INTERVAL 3 DAYS")).select("event_id")


@query("SELECT user_id, round(avg(value / 100), 6) AS mean_ FROM events GROUP BY 1")
def d3_strategy_by_name(t: Tables):
    """An aggregate looked up in the registry of strategies."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    s = M.sequence_scores(t.events.select("user_id", (F.row_number().over(w) - 1).alias("i"), (F.col("value") / 100).alias("s")), "user_id", "i", "s")
    return s.select("user_id", F.round(M.STRATEGIES["mean"], 6).alias("mean_"))


@query("SELECT c_custkey, (lower(trim(c_mktsegment)) = 'building')::INT::DOUBLE AS a, (regexp_replace(c_name, '\\D', '', 'g') = '000000001')::INT::DOUBLE AS b FROM customer")
def d1_normaliser_hook(t: Tables):
    """Exact scores under normalisers given as functions."""
    score = lambda c, want, f: (f(c) == f(F.lit(want))).cast("double")
    return t.customer.select("c_custkey", score(F.col("c_mktsegment"), "Building ", T.normalize_email).alias("a"), score(F.col("c_name"), "000000001", T.keep_digits).alias("b"))


@query(
    """WITH b AS (SELECT l_orderkey, count(*) FILTER (l_quantity > 25) AS o FROM lineitem GROUP BY 1), c AS (SELECT l_orderkey, count(*) FILTER (l_quantity > 20) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN n > o THEN 'other' ELSE 'baseline' END AS chosen FROM b JOIN c USING (l_orderkey)"""
)
def c24_compare_and_choose(t: Tables):
    """Two sets of results of the same documents: the other is chosen where it is strictly better."""
    n = lambda q, name: t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") > q).alias(name))
    return R.strict_join(n(25, "o"), n(20, "n"), "l_orderkey").select("l_orderkey", F.when(F.col("n") > F.col("o"), "other").otherwise("baseline").alias("chosen"))


@query()
def c10_decode_and_merge(t: Tables):
    """Work records repaired, merged with their neighbours, and replaced where that changed them."""
    k = F.col("o_orderkey")
    r = F.struct(F.when(k % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("job_title"), F.concat(F.lit("Firm "), "o_orderstatus").alias("company"), F.date_format("o_orderdate", "yyyy-MM").alias("start_date"), F.when(k % 2 == 0, "present").otherwise("").alias("end_date"), F.lit("").alias("duration"))
    d = t.orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", r.alias("r")))), lambda x: x["r"]).alias("work"))
    m = d.withColumn("merged", C.merge_work(F.col("work")))
    return m.select("o_custkey", F.size("work").alias("before"), F.size("merged").alias("after"), C.accept(F.col("work"), F.col("merged")).alias("better"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_id % 4 = 3 AS failed FROM events WHERE event_id % 4 <> 3 UNION ALL SELECT event_id, NULL, true FROM events WHERE event_id % 4 = 3")
def f25_repair_json(t: Tables):
    """Whole, fenced, cut-off and hopeless answers."""
    from quillon.functions.jsonfix import parsed

    k, head = F.col("event_id") % 4, F.concat(F.lit('{"email": "x", '), F.substring("props", F.lit(2), F.length("props") - 2))
    raw = F.when(k == 0, F.concat(head, F.lit("}"))).when(k == 1, F.concat(F.lit("```json\n"), head, F.lit("}\n```"))).when(k == 2, F.concat(head, F.lit(', "more": ["cut off'))).otherwise("nothing")
    x = t.events.select("event_id", parsed(raw).alias("x"))
    return x.select("event_id", F.get_json_object("x.json", "$.k").alias("k"), F.col("x.error").isNotNull().alias("failed"))


@query("SELECT item_id, length(text)::BIGINT AS n FROM benchmark")
def d5_batched_map(t: Tables):
    """A function of whole batches."""
    from quillon.functions import hooks

    return hooks.map_batched(t.benchmark.select("item_id", "text"), _lengths, "item_id bigint, n bigint")


def _lengths(b):
    return b.assign(n=b["text"].str.len())[["item_id", "n"]]


def _caller(x: str) -> str:
    if "3" in x:
        raise TimeoutError("no answer")
    return x.upper()


@query("SELECT s_suppkey, CASE WHEN contains(s_name, '3') THEN NULL ELSE upper(s_name) END AS answer, CASE WHEN contains(s_name, '3') THEN 'failed' ELSE 'completed' END AS status FROM supplier")
def d4_external_caller(t: Tables):
    """A caller that fails on some rows: tried thrice, then marked."""
    from quillon.functions import hooks

    return hooks.call_external(t.supplier, "s_suppkey", "s_name", _caller).select("s_suppkey", "answer", "status")


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def d7_table_function(t: Tables):
    """One row to many, by a table function in SQL."""
    from quillon.functions import hooks

    hooks.register(t.spark)
    t.part.select("p_partkey", "p_name").createOrReplaceTempView("quillon_parts")
    return t.spark.sql("SELECT p_partkey, w.word FROM quillon_parts, LATERAL word_spans(p_name) w")


@query("SELECT event_id, event_type, value FROM events")
def s8_json_lines(t: Tables):
    """JSON lines with their schema given."""
    path = FS.shared_folder(t.spark, "lines")
    t.events.select("event_id", "event_type", "value").write.json(path)
    return t.spark.read.schema("event_id bigint, event_type string, value double").json(path)


@query("SELECT r_regionkey, upper(r_name) AS r_name FROM region")
def k1_overwrite(t: Tables):
    """A second write takes the place of the first."""
    path = FS.shared_folder(t.spark, "overwritten")
    t.region.write.mode("overwrite").json(path)
    t.region.select("r_regionkey", F.upper("r_name").alias("r_name")).write.mode("overwrite").json(path)
    return t.spark.read.schema("r_regionkey int, r_name string").json(path)


@query("SELECT r_regionkey AS run, n_name AS artifact FROM nation JOIN region ON n_regionkey = r_regionkey")
def k9_append_artifacts(t: Tables):
    """Artifacts of runs, appended one batch after another."""
    path = FS.shared_folder(t.spark, "artifacts")
    rows = t.nation.select(F.col("n_regionkey").alias("run"), F.col("n_name").alias("artifact"))
    FS.append(rows.filter("run < 2"), path, "parquet")
    FS.append(rows.filter("run >= 2"), path, "parquet")
    return t.spark.read.parquet(path)


@query()
def c5_record_oracle(t: Tables):
    """Runs of labelled tokens to spans, spans to records, records against what they should be: fields found a document."""
    spans = Q.joined_spans(_candidates(t).withColumn("grp", F.lit(0)), ["doc"], "at", ["field", "grp"], "value")
    keyed = Q.repeated_key_sessions(spans, ["doc"], "first", "field", keep=("text",)).withColumnsRenamed({"at": "first", "grp": "idx"})
    made = C.assemble(keyed.withColumn("conf", F.lit(1.0)).withColumn("kind", F.lit("line")), "doc", "kind", "idx", "field", "text", "conf", "first")
    want = t.lineitem.groupBy(F.col("l_orderkey").alias("doc")).agg(F.count_distinct("l_returnflag").alias("wanted"))
    found = made.select("doc", F.size("records").alias("records"), F.size(F.array_distinct(F.flatten(F.transform("records", lambda r: F.transform(r["fields"], lambda e: e["key"]))))).alias("found"))
    return want.join(found, "doc", "left").select("doc", "records", (F.coalesce("found", F.lit(0)) / F.col("wanted")).alias("recall"))


def _project_candidates(t: Tables):
    """Lines of an order as candidates of projects: flags are fields, N the name; technologies are told in words."""
    path = F.when(F.col("l_returnflag") == "N", "name").when(F.col("l_returnflag") == "R", "technologies").otherwise("url")
    words = F.split("p_name", " ")
    told = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("built on "), F.array_join(F.reverse(words), " and "), F.lit(" with care and time"))).otherwise(F.concat_ws(", ", "p_name", "p_brand", "p_name"))
    value = F.when(path == "technologies", told).when(path == "name", F.concat("p_brand", F.lit(" "), "p_type")).otherwise(F.concat(F.lit("https://x.org/"), "p_name"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    # parts are joined first: from the window on all rows of an order stay where they are
    lines = R.dealt(t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", rows=t.lineitem.count()).withColumn("at", F.row_number().over(w))
    return lines.select(F.col("l_orderkey").alias("doc_id"), "at", F.concat(F.lit("projects.*."), path).alias("path"), value.alias("value"), F.col("l_discount").alias("confidence"), words.alias("words"), "l_linenumber", "p_partkey", "p_brand", "p_type", "p_name")


@query()
def c7_decode_projects(t: Tables):
    """Projects of an order with technologies by the known skills: the words of all its parts' names."""
    c = _project_candidates(t)
    skills = c.groupBy("doc_id").agg(F.array_sort(F.collect_set("words")).alias("s")).select("doc_id", F.array_sort(F.array_distinct(F.flatten("s"))).alias("skills"))
    each = D.decode_documents(c, split=False).select("doc_id", F.posexplode("projects").alias("at", "p")).join(skills, "doc_id")
    return each.select("doc_id", "at", "p.name", P.technologies(F.col("p.technologies"), F.col("skills")).alias("technologies"), "p.url")


@query(
    """WITH x AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), y AS (SELECT p_partkey, list_distinct(list_concat(w, ['absent', 'thing'])) AS s, lower(array_to_string(list_reverse(w), ' and ') || ' and more of it') AS raw FROM x)
    SELECT p_partkey, list_transform(list_sort(list_transform(list_filter(s, lambda k: contains(raw, lower(k))), lambda k: {'at': instr(raw, lower(k)), 'v': k})), lambda k: k.v) AS tools FROM y"""
)
def f21_known_skills(t: Tables):
    """Skills told in an enumeration of words, in order of appearance."""
    w = F.split("p_name", " ")
    raw = F.concat(F.array_join(F.reverse(w), " and "), F.lit(" and more of it"))
    return t.part.select("p_partkey", P.technologies(F.array(raw), F.concat(w, F.array(F.lit("absent"), F.lit("thing")))).alias("tools"))


@query()
def c11_repair_all_kinds(t: Tables):
    """Orders as documents: one work record, and records of three kinds decoded from their lines."""
    c = _project_candidates(t)
    kind = F.element_at(F.array(*[F.lit(k) for k in D.KIND_FIELDS]), (F.col("p_partkey") % 3 + 1).cast("int"))
    field = F.substring_index("path", ".", -1)
    second = F.when(kind == "education", "institution").when(kind == "projects", "technologies").otherwise("issuer")
    third = F.when(kind == "education", "graduation_date").when(kind == "projects", "url").otherwise("date")
    own = F.when(field == "name", F.when(kind == "education", "degree").otherwise("name")).when(field == "technologies", second).otherwise(third)
    candidates = c.select("doc_id", "at", F.concat_ws(".*.", kind, own).alias("path"), "value", "confidence")
    end = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("2001-01")
    job = F.struct(F.col("o_orderpriority").alias("job_title"), F.lit("Firm").alias("company"), F.date_format("o_orderdate", "yyyy-MM").alias("start_date"), end.alias("end_date"), F.lit("now").alias("duration"))
    none = {k: D._empty(k) for k in D.KIND_FIELDS}
    predictions = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.array(job).alias("work_experience"), none["education"].alias("education"), F.when(F.col("o_orderkey") % 3 == 0, none["projects"]).alias("projects"), F.lit(None).cast("array<struct<name: string, issuer: string, date: string>>").alias("certifications"))
    r = D.repair_documents(predictions, candidates)
    return r.select("doc_id", F.to_json("education").alias("education"), F.to_json("projects").alias("projects"), F.to_json("certifications").alias("certifications"), F.col("work_experience")[0]["duration"].alias("duration"), F.col("events.kind").alias("events"))


@query("WITH b AS (SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1) SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m') || ' - Present' AS duration FROM b")
def c8_decode_work_rows(t: Tables):
    """The most confident row of each record, repaired."""
    best = R.first_seen(t.orders, ["o_custkey", "o_orderstatus"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    r = F.struct(F.col("o_orderpriority").alias("job_title"), F.col("o_orderstatus").alias("company"), F.date_format("o_orderdate", "yyyy-MM").alias("start_date"), F.lit("now").alias("end_date"), F.lit("").alias("duration"))
    return best.select("o_custkey", "o_orderkey", C.repair_work(r)["record"]["duration"].alias("duration"))


@query("SELECT o_custkey, count(*) AS records, count(*) FILTER (o_orderkey % 2 = 0) AS open_, sum((o_orderkey % 2 = 0)::INT)::BIGINT AS events FROM orders GROUP BY 1")
def c11_repair_documents(t: Tables):
    """All work records of a document repaired, with the events of the document."""
    r = F.struct(F.col("o_orderpriority").alias("job_title"), F.lit("Firm").alias("company"), F.date_format("o_orderdate", "yyyy-MM").alias("start_date"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("2001-01").alias("end_date"), F.when(F.col("o_orderkey") % 2 == 0, "present").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit(" - 2001-01"))).alias("duration"))
    d = t.orders.groupBy("o_custkey").agg(F.collect_list(r).alias("work")).withColumn("x", F.transform("work", lambda w: C.repair_work(w)))
    events = F.flatten(F.transform("x", lambda x: x["events"]))
    return d.select("o_custkey", F.size("x").cast("long").alias("records"), F.size(F.filter("x", lambda x: x["record"]["end_date"] == "Present")).cast("long").alias("open_"), F.size(F.filter(events, lambda e: e == C.EVENTS[1])).cast("long").alias("events"))


def _conversation_graphs(t: Tables):
    """Conversations as documents of a page a turn, their units with fields, and the record made of their turns."""
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+"), lambda x: x != "")
    turns = t.conversations.select("conv_id", "turn", "text", w.alias("w"))
    line = F.array(F.struct(F.array(F.struct(F.col("text"), F.array(F.lit(0.0), F.lit(0.0), F.lit(900.0), F.lit(10.0)).alias("bbox"))).alias("spans"), F.lit(None).cast("array<double>").alias("bbox")))
    box = F.struct(line.alias("textlines"), F.lit(None).cast("struct<cells: array<array<array<double>>>, extract: array<array<string>>>").alias("table"))
    page = F.struct((F.col("turn") + 1).cast("int").alias("page_number"), F.lit(1000.0).alias("width"), F.lit(1000.0).alias("height"), F.array(box).alias("boxes"))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    job = F.struct(part(1, 3).alias("job_title"), part(2, 3).alias("company"), part(5, 2).alias("duration"))
    docs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", page.alias("p"), job.alias("j"), "w"))).alias("x"))
    docs = docs.select("conv_id", F.transform("x", lambda x: x["p"]).alias("pages"), F.struct(F.array_join(F.slice(F.col("x")[0]["w"], 3, 2), " ").alias("full_name"), F.transform("x", lambda x: x["j"]).alias("work_experience")).alias("truth"))
    notes = turns.select("conv_id", F.col("turn").alias("ord"), F.concat(F.lit("work_experience."), F.col("turn").cast("string"), F.lit(".job_title")).alias("path"), part(1, 3).alias("text"), (F.col("turn") + 1).alias("page"))
    true = docs.select("conv_id", F.posexplode(E.truth_annotations("truth", docs.schema["truth"].dataType)).alias("ord", "a")).select("conv_id", "ord", "a.*")
    return E.evidence_graphs(docs, notes, true, doc="conv_id"), docs


@query()
def c22_evidence_graphs(t: Tables):
    """Words in reading order, annotations of each turn's first words, then the values of a record made of the turns."""
    g = _conversation_graphs(t)[0].filter("field_path IS NOT NULL")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ")
    return g.groupBy("conv_id", "field_path", "record_index").agg(F.count("*").alias("units"), text.alias("text"))


@query()
def c5_labels_alone(t: Tables):
    """The record that the labels of a conversation's words spell, evaluated against one job a turn of its first three words."""
    graphs, docs = _conversation_graphs(t)
    jobs = graphs.filter("field_path IS NULL OR field_path = 'work_experience.*.job_title'").select("conv_id", "at", "text", "field_path", "record_index")
    blank = lambda *names: [F.lit("").alias(n) for n in names]
    work = F.transform("truth.work_experience", lambda j: F.struct(j["job_title"].alias("job_title"), *blank("company", "start_date", "end_date", "duration")))
    none = lambda n: F.lit(None).cast("string").alias(n)
    record = F.struct(*blank("full_name", "email", "location", "phone"), none("linkedin_url"), none("github_url"), *blank("summary"), F.array().cast("array<string>").alias("skills"), work.alias("work_experience"), F.array().cast("array<string>").alias("education"), none("projects"), none("certifications"))
    truths = docs.select("conv_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("truth"))
    e = V.record_oracle(jobs, truths, doc="conv_id")
    return e.select("conv_id", "json_valid", "schema_valid", F.round("macro", 6).alias("macro"), F.round("unsupported_rate", 6).alias("unsupported_rate"))


@query(f"WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {_RH.format(s='quick')}, doc_id) AS n, count(*) OVER (PARTITION BY toxic) AS c FROM labels WHERE toxic IS NOT NULL) SELECT doc_id, toxic, CASE WHEN n <= floor(c * 0.7) THEN 'train' WHEN n <= floor(c * 0.85) THEN 'validation' ELSE 'test' END AS split FROM r")
def c29_per_class_manifest(t: Tables):
    """70, 15 and 15 of a hundred of each class."""
    d = t.labels.filter("toxic IS NOT NULL").select("doc_id", "toxic")
    r = S.cut_by_hash(d, "doc_id", ["toxic"], T.stable_hash(F.col("doc_id"), seed="quick"), S.share_cuts(d, ["toxic"], [0.7, 0.85]))
    return r.select("doc_id", "toxic", F.when(F.col("cut") == 1, "train").when(F.col("cut") == 2, "validation").otherwise("test").alias("split"))


_tries: dict[int, int] = {}


def _flaky(x: str) -> str:
    """Fails at the first try of each text."""
    key = hash(x)
    _tries[key] = _tries.get(key, 0) + 1
    if _tries[key] == 1:
        raise TimeoutError("once")
    return x.lower()


@query("SELECT s_suppkey, lower(s_name) AS answer, 'completed' AS status FROM supplier")
def t5_retries(t: Tables):
    """A caller that fails once on every row, tried again."""
    from quillon.functions import hooks

    return hooks.call_external(t.supplier, "s_suppkey", "s_name", _flaky, tries=3).select("s_suppkey", "answer", "status")


@query("SELECT source, lang, n_chars >= 1000 AS long_, count(*) AS n FROM documents GROUP BY ALL")
def d2_strata_hook(t: Tables):
    """Strata given as a list of expressions."""
    strata = [F.col("source"), F.col("lang"), (F.col("n_chars") >= 1000).alias("long_")]
    return t.documents.groupBy(*strata).agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang || ':' || source AS label FROM documents")
def d6_row_function(t: Tables):
    """What a function of rows would build, as an expression."""
    return t.documents.select("doc_id", F.concat_ws(":", "lang", "source").alias("label"))


def _order_evaluation(t: Tables):
    """Orders as records: truth, a raw prediction that is broken in some and off in others, and the words of its lines' parts as evidence."""
    k = F.col("o_orderkey")
    line = F.struct(F.col("p_name").alias("job_title"), F.col("p_brand").alias("company"), F.date_format("l_shipdate", "yyyy-MM").alias("start_date"), F.lit("now").alias("end_date"), F.lit("").alias("duration"))
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("o_orderkey"))
    lines = lines.agg(F.array_sort(F.collect_list(line)).alias("work"), F.array_sort(F.collect_set("p_type")).alias("skills"), F.array_join(F.array_sort(F.collect_list("p_name")), " ").alias("words"))
    o = t.orders.join(lines, "o_orderkey", "left").withColumns({"work": F.coalesce("work", F.array().cast("array<struct<job_title: string, company: string, start_date: string, end_date: string, duration: string>>")), "skills": F.coalesce("skills", F.array().cast("array<string>"))})
    email = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@x.org"))
    record = lambda mail, work: F.struct(F.col("o_orderpriority").alias("full_name"), mail.alias("email"), F.col("o_orderstatus").alias("location"), F.lit("+1 212 555 0100").alias("phone"), F.lit("https://x.org").alias("linkedin_url"), F.lit(None).cast("string").alias("github_url"), F.lit("sum").alias("summary"), F.col("skills"), work.alias("work_experience"), F.array().cast("array<struct<degree: string>>").alias("education"), F.lit(None).cast("string").alias("projects"), F.lit(None).cast("string").alias("certifications"))
    js = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    mail = F.when(k % 4 == 1, F.lit("nobody")).otherwise(F.upper(email))
    raw = js(record(mail, F.reverse(F.col("work"))))
    raw = F.when(k % 5 == 2, F.concat(F.lit('{"zip": 1, '), F.substr(raw, F.lit(2)))).otherwise(raw)
    raw = F.when(k % 7 == 3, F.concat(F.lit("so "), raw)).otherwise(raw)
    return o.select(k.alias("doc_id"), js(record(email, F.col("work"))).alias("truth"), raw.alias("raw"), F.col("words").alias("evidence"))


@query()
def c1_evaluate_raw_predictions(t: Tables):
    """Every order's raw prediction against its record: validity, events, and each field by its own metric."""
    e = V.evaluate_documents(_order_evaluation(t))
    return e.select("doc_id", "json_valid", "schema_valid", F.size("missing_keys").alias("missing"), F.col("extra_keys"), F.col("events.kind").alias("events"), F.round("macro", 6).alias("macro"), F.round("unsupported_rate", 6).alias("unsupported_rate"))


@query()
def c2_evaluation_report(t: Tables):
    """The report of all orders: rates, scores, fields and events."""
    return V.corpus_report(V.evaluate_documents(_order_evaluation(t)))


@query(
    """WITH q AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations),
    a AS (SELECT conv_id, v AS variant, 'turn ' || (CASE WHEN n = 9 THEN 1 ELSE n END) AS question, n, total, CASE WHEN v = 'long' THEN length(text) > 200 ELSE role = 'user' END AS yes FROM q, (VALUES ('long'), ('user')) x(v)),
    l AS (SELECT conv_id, variant, question, total, arg_max(yes, n) AS yes FROM a GROUP BY ALL)
    SELECT conv_id, variant, round(count(*) FILTER (yes) / max(total), 6) AS score, count(*) FILTER (yes) AS yes_count, max(total) - count(*) FILTER (yes) AS no_count, count(*) AS evaluations FROM l GROUP BY ALL"""
)
def c31_judged_variants(t: Tables):
    """Turns as questions, judged in batches of eight and seven for two variants; the ninth answer is to the first question again."""
    c = t.conversations
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    q = c.select("conv_id", "text", "role", n.alias("n"))
    r = q.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("n")), lambda i: F.concat(F.lit("turn "), i.cast("string"))).alias("questions"))
    r = r.withColumn("variants", F.create_map(F.lit("long"), F.lit("a"), F.lit("user"), F.lit("b"), F.lit("blank"), F.lit(" ")))
    batches = J.question_batches(r, "conv_id", "questions").select("conv_id", "batch", F.explode("questions").alias("question"))
    told = batches.join(q.withColumn("question", F.concat(F.lit("turn "), F.col("n").cast("string"))), ["conv_id", "question"])
    asked = F.when(F.col("n") == 9, F.lit("turn 1")).otherwise(F.col("question"))
    item = lambda yes: F.struct("n", asked.alias("question"), yes.alias("satisfied"), F.lit("").alias("reasoning"))
    each = told.select("conv_id", "batch", F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), item(yes).alias("item")) for v, yes in (("long", F.length("text") > 200), ("user", F.col("role") == "user"), ("stranger", F.lit(True)))])).alias("x"))
    items = F.transform(F.array_sort(F.collect_list("x.item")), lambda i: F.struct(i["question"].alias("question"), i["satisfied"].alias("satisfied"), i["reasoning"].alias("reasoning")))
    answers = each.groupBy("conv_id", "x.variant", "batch").agg(items.alias("items"))
    got = J.judged_variants(r, answers, "conv_id", "questions", "variants")
    return got.select("conv_id", "variant", F.round("score", 6).alias("score"), "yes_count", "no_count", F.size("evaluations").cast("long").alias("evaluations"))


@query(
    """WITH w AS (SELECT l_orderkey, p_name, p_brand, p_type, row_number() OVER (PARTITION BY l_orderkey ORDER BY p_name, p_brand, p_type) AS n FROM lineitem JOIN part ON l_partkey = p_partkey),
    j AS (SELECT l_orderkey, string_agg('  ' || p_name || ' @ ' || p_brand || CASE WHEN p_type = '' THEN '' ELSE ' [' || p_type || ']' END, chr(10) ORDER BY n) AS jobs FROM w WHERE n <= 3 GROUP BY 1)
    SELECT o_orderkey, concat_ws(chr(10), 'Name: ' || o_orderpriority, 'Seniority: ' || o_orderstatus || ' | Experience: ' || (o_orderkey % 9) || ' years', jobs) AS body FROM orders LEFT JOIN j ON l_orderkey = o_orderkey"""
)
def f35_record_text(t: Tables):
    """Orders as nested records, told in lines; of their jobs the first three."""
    job = F.struct(F.col("p_name").alias("job_title"), F.col("p_brand").alias("company"), F.array("p_type").alias("technologies"), F.lit("").alias("description"))
    w = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(job)).alias("work"))
    o = t.orders.join(w, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    none = lambda kind: F.lit(None).cast(kind)
    r = F.struct(F.col("o_orderpriority").alias("full_name"), F.lit("").alias("location"), F.col("o_orderstatus").alias("seniority_level"), (F.col("o_orderkey") % 9).alias("years_of_experience"), none("string").alias("summary"), none("array<struct<skill_name: string, proficiency: string>>").alias("skills"), F.col("work").alias("work_experience"), none("array<struct<degree: string, field_of_study: string, institution: string>>").alias("education"), none("array<string>").alias("certifications"))
    return o.select("o_orderkey", J.record_text(r).alias("body"))


@query()
def c25_validate_split_files(t: Tables):
    """The nine splits of the documents written as files, one left out and one cut off, read one by one and held against all rules."""
    from quillon.plans.routing import _DEBUG, _OOD, _WORKING

    d = t.documents.select("doc_id", "lang", "source", F.when(F.col("n_chars") >= 1000, "long").otherwise("short").alias("long"))
    rows = SP.nine_splits(d, "doc_id", "lang", "source", "long", _OOD, _WORKING, 20, 20, _DEBUG).join(d, "doc_id")
    folder = FS.shared_folder(t.spark, "splits")
    for name in SP.NAMES:
        line = F.to_json(F.struct("doc_id", "lang", "source"))
        if name == "debug_250":
            line = F.expr(f"substr({'to_json(struct(doc_id, lang, source))'}, 1, 12)")
        if name != "id_test":
            rows.filter(F.col("split") == name).select(line.alias("value")).write.text(f"{folder}/{name}.jsonl")
    read, issues = SP.read_splits(t.spark, folder, "doc_id long, lang string, source string", "doc_id")
    return issues.unionByName(SP.validate_splits(read, "doc_id", "lang", "source", ood=_OOD))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'kept' WHEN o_orderkey % 3 = 1 THEN 'changed' ELSE 'new' END AS state FROM orders")
def k14_resume_configurations(t: Tables):
    """Runs made of orders, each begun again under its configuration: equal digests go on, others are told apart."""
    digest = lambda price: T.stable_hash(F.col("o_custkey"), F.col("o_orderstatus"), price)
    begun = t.orders.filter("o_orderkey % 3 <> 2").select(F.col("o_orderkey").alias("run"), digest(F.col("o_totalprice")).alias("digest"))
    again = t.orders.select(F.col("o_orderkey").alias("run"), digest(F.when(F.col("o_orderkey") % 3 == 1, -1.0).otherwise(F.col("o_totalprice"))).alias("digest"))
    return R.resume_states(begun, again, "run", "digest").select(F.col("run").alias("o_orderkey"), "state")
