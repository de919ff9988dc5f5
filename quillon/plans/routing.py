"""Features and requests of routed fields, and the nine-way splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import records as C
from quillon.operators import routing as G
from quillon.operators import splits as S
from quillon.plans.evaluation import _NORM
from quillon.plans.records import _REPAIR_CTE, _WORK_CTE, _work
from quillon.plans.registry import Tables, query

_KEYS = ("job_title", "company", "start_date", "end_date", "duration")
#: Evidence of a customer: the values of all orders but every eleventh.
_FEATURES_CTE = f"""leaf AS (SELECT o_custkey, unnest([{', '.join(_NORM.format(c=k) for k in _KEYS)}]) AS v FROM w),
ev AS (SELECT o_custkey, {_NORM.format(c="coalesce(string_agg(concat_ws(' ', " + ', '.join(_KEYS) + "), ' ' ORDER BY o_orderkey) FILTER (o_orderkey % 11 <> 0), '')")} AS ev FROM w GROUP BY 1),
sup AS (SELECT o_custkey, bool_and(contains(ev, v) OR len(list_intersect(list_distinct(string_split(v, ' ')), list_distinct(string_split(ev, ' ')))) / len(list_distinct(string_split(v, ' '))) >= 0.5) AS supported FROM leaf JOIN ev USING (o_custkey) WHERE v <> '' GROUP BY 1),
prim AS (SELECT o_custkey, count(*) AS n, sum(length(to_json(struct_pack({', '.join(f'{k} := {k}' for k in _KEYS)}))::VARCHAR)) + count(*) + 1 + 10 * count(*) - 1 AS characters FROM w GROUP BY 1)"""


def _pair(t: Tables):
    """Work records of a customer as first result, repaired ones as the second, and the evidence."""
    each = F.array_sort(F.collect_list(F.struct("o_orderkey", "r")))
    g = _work(t).groupBy("o_custkey").agg(each.alias("x"))
    first = F.transform("x", lambda x: x["r"])
    shown = F.transform(F.filter("x", lambda x: x["o_orderkey"] % 11 != 0), lambda x: F.concat_ws(" ", *[x["r"][k] for k in _KEYS]))
    return g.select("o_custkey", first.alias("first"), F.transform(first, lambda r: C.repair_work(r)["record"]).alias("second"), F.array_join(shown, " ").alias("evidence"))


@query(
    f"""WITH {_REPAIR_CTE}, {_FEATURES_CTE}, dis AS (SELECT o_custkey, bool_or(start_date <> s OR end_date <> e OR duration <> d2) AS disagrees FROM fin GROUP BY 1)
    SELECT o_custkey, disagrees, n AS primary_count, n AS specialist_count, characters::BIGINT AS primary_characters, coalesce(supported, false) AS primary_supported, disagrees AS routed, coalesce(supported, false) AND characters <= 383 AS routed_alone FROM prim JOIN dis USING (o_custkey) LEFT JOIN sup USING (o_custkey)"""
)
def c16_field_features(t: Tables):
    """Disagreement, counts, characters and support of the work field, and whether either rule routes it."""
    x = G.field_features(F.col("first"), F.col("second"), F.col("evidence"), _KEYS)
    f = _pair(t).select("o_custkey", *[(c if k in ("disagrees", "primary_supported") else c.cast("long")).alias(k) for k, c in x.items()])
    return f.select("*", C.route("work_experience", F.col("disagrees"), F.col("primary_count"), F.col("specialist_count")).alias("routed"), C.route_primary_only("work_experience", F.col("primary_count"), F.col("primary_characters"), F.col("primary_supported")).alias("routed_alone"))


@query(
    f"""WITH {_WORK_CTE}, {_FEATURES_CTE}, cert AS (SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS k FROM orders GROUP BY 1),
    r AS (SELECT o_custkey, coalesce(supported, false) AND characters <= 383 AS a, coalesce(supported, false) AND k > 0 AS b FROM prim JOIN cert USING (o_custkey) LEFT JOIN sup USING (o_custkey))
    SELECT o_custkey, c_name AS text, concat_ws(',', CASE WHEN a THEN 'work_experience' END, CASE WHEN b THEN 'certifications' END) AS routed_fields,
      '{{' || concat_ws(',', CASE WHEN a THEN '"work_experience":["job_title","company"]' END, CASE WHEN b THEN '"certifications":["name","issuer","date"]' END) || '}}' AS schema FROM r JOIN customer ON c_custkey = o_custkey WHERE a OR b"""
)
def c19_focused_requests(t: Tables):
    """Requests of customers with a routed field, with the schema of those fields alone."""
    x = G.field_features(F.col("first"), F.col("second"), F.col("evidence"), _KEYS)
    certs = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("k"))
    rows = _pair(t).select("o_custkey", *[c.alias(k) for k, c in x.items()]).join(certs, "o_custkey")
    routes = {f: C.route_primary_only(f, F.col(n), F.col("primary_characters"), F.col("primary_supported")) for f, n in (("work_experience", "primary_count"), ("certifications", "k"))}
    schemas = {"work_experience": ("job_title", "company"), "certifications": ("name", "issuer", "date")}
    asked = G.focused_requests(rows, t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("text")), "o_custkey", routes, schemas)
    return asked.select("o_custkey", "text", F.array_join("routed_fields", ",").alias("routed_fields"), F.to_json("schema").alias("schema"))


_JSON_LENGTH = r"length({j}) + 5 * length(regexp_replace({j}, '[\x00-\x7e]', '', 'g')) + 6 * length(regexp_replace({j}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g'))"


@query(
    f"""WITH g AS (SELECT conv_id, list(text ORDER BY turn, text) FILTER (role = 'user') AS asked, list(text ORDER BY turn, text) FILTER (role = 'assistant') AS answered, min(role) FILTER (turn > 3) AS late, count(*) AS n FROM conversations GROUP BY 1),
    l AS (SELECT conv_id, 'asked' AS field, len(asked) AS c, to_json(asked)::VARCHAR AS j, n FROM g UNION ALL SELECT conv_id, 'answered', len(answered), to_json(answered)::VARCHAR, n FROM g UNION ALL SELECT conv_id, 'late', (late <> '')::INT, to_json(late)::VARCHAR, n FROM g)
    SELECT conv_id, field, coalesce(c, 0)::BIGINT AS primary_count, CASE WHEN j IS NULL OR c IS NULL THEN 4 ELSE {_JSON_LENGTH.format(j='j')} END::BIGINT AS primary_characters, coalesce(c, 0) = 0 AS primary_empty, CASE WHEN conv_id % 3 = 0 THEN 0 ELSE n / 4 END AS primary_latency_seconds, n AS primary_output_tokens, n > 5 AS primary_truncated FROM l"""
)
def c20_field_features(t: Tables):
    """Six features of the user's and the assistant's turns and of a late role."""
    said = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text"))))
    g = t.conversations.groupBy("conv_id").agg(said("user").alias("u"), said("assistant").alias("a"), F.min(F.when(F.col("turn") > 3, F.col("role"))).alias("late"), F.count("*").alias("n"))
    texts = lambda c: F.when(F.size(c) > 0, F.transform(c, lambda x: x["text"]))
    rows = g.select("conv_id", texts("u").alias("asked"), texts("a").alias("answered"), "late", F.when(F.col("conv_id") % 3 != 0, F.col("n") / 4).alias("seconds"), "n", (F.col("n") > 5).alias("cut"))
    f = G.primary_features(rows, "conv_id", ("asked", "answered", "late"), "seconds", "n", "cut")
    return f.withColumns({k: F.col(k).cast("long") for k in ("primary_count", "primary_characters")})


_OOD, _WORKING, _DEBUG = {"src1": 6, "src2": 5}, {"en": 90, "de": 20, "fr": 12, "es": 10}, (3, 8)


def _choice_sql(name: str, rows: str, group: str, strata: str, quota: str, salt: str) -> str:
    """CTEs of the ids chosen from `rows`: the quota of each group shared over its strata."""
    return f"""{name}_d AS (SELECT doc_id, {group} AS g, concat_ws(chr(31), {strata}) AS s FROM ({rows})), {name}_c AS (SELECT g, s, count(*) AS c FROM {name}_d GROUP BY ALL),
    {name}_t AS (SELECT g, s, c, sum(c) OVER (PARTITION BY g) AS t, least(greatest(quota, 0), sum(c) OVER (PARTITION BY g)) AS q FROM {name}_c JOIN ({quota}) USING (g)), {name}_x AS (SELECT *, c * q / t AS x FROM {name}_t),
    {name}_q AS (SELECT g, s, floor(x) + (row_number() OVER (PARTITION BY g ORDER BY round(x - floor(x), 9) DESC, s) <= q - sum(floor(x)) OVER (PARTITION BY g))::INT AS take FROM {name}_x),
    {name} AS (SELECT doc_id FROM (SELECT doc_id, g, s, row_number() OVER (PARTITION BY g, s ORDER BY sha256(concat_ws(chr(31), '{salt}' || g, doc_id::VARCHAR)), doc_id) AS n FROM {name}_d) JOIN {name}_q USING (g, s) WHERE n <= take)"""


def _quota_sql(quotas: dict[str, int]) -> str:
    return " UNION ALL ".join(f"SELECT '{g}' AS g, {n} AS quota" for g, n in quotas.items())


_IN = "SELECT * FROM d WHERE doc_id IN (SELECT doc_id FROM {0})"
_LEFT = f"SELECT g, quota - coalesce(n, 0) AS quota FROM ({_quota_sql(_WORKING)}) LEFT JOIN (SELECT lang AS g, count(*) AS n FROM d JOIN ood USING (doc_id) GROUP BY 1) USING (g)"
_ALL = "lang, source, long"
_NINE_SQL = ", ".join([
    "d AS (SELECT doc_id, lang, source, CASE WHEN n_chars >= 1000 THEN 'long' ELSE 'short' END AS long FROM documents)",
    _choice_sql("ood", "SELECT * FROM d WHERE source IN ('src1', 'src2')", "source", "long", _quota_sql(_OOD), "ood:"),
    _choice_sql("wrk", "SELECT * FROM d WHERE source NOT IN ('src1', 'src2')", "lang", "source, long", _LEFT, "working:"),
    _choice_sql("val", _IN.format("wrk"), "''", _ALL, _quota_sql({"": 20}), "validation"),
    _choice_sql("idt", _IN.format("wrk") + " AND doc_id NOT IN (SELECT doc_id FROM val)", "''", _ALL, _quota_sql({"": 20}), "id_test"),
    "trn AS (SELECT doc_id FROM wrk EXCEPT SELECT doc_id FROM val EXCEPT SELECT doc_id FROM idt)",
    _choice_sql("big", _IN.format("trn"), "lang", "source, long", _quota_sql(dict.fromkeys(_WORKING, _DEBUG[1])), "debug250:"),
    _choice_sql("small", _IN.format("big"), "lang", "source, long", _quota_sql(dict.fromkeys(_WORKING, _DEBUG[0])), "debug50:"),
])
_SETS = {"validation": "val", "id_test": "idt", "template_ood_test": "ood", "train": "trn", "debug_250": "big", "debug_50": "small", "completed": "d", "working": "(SELECT doc_id FROM wrk UNION ALL SELECT doc_id FROM ood)", "locked_confirmation": "(SELECT doc_id FROM d EXCEPT SELECT doc_id FROM wrk EXCEPT SELECT doc_id FROM ood)"}


@query(f"WITH {_NINE_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS split, doc_id FROM {v}" for k, v in _SETS.items()))
def o11_split_builder(t: Tables):
    """The nine named sets over languages as tiers and sources as templates."""
    d = t.documents.select("doc_id", "lang", "source", F.when(F.col("n_chars") >= 1000, "long").otherwise("short").alias("long"))
    return S.nine_splits(d, "doc_id", "lang", "source", "long", _OOD, _WORKING, 20, 20, _DEBUG)
