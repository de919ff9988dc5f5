"""Search, ranking and lexical queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import retrieval as R
from quillon.operators.lanes import compare_on_profiles, profiles_digest
from quillon.operators.ranking import first_ranks, top_documents
from quillon.operators.relations import settled
from quillon.plans.registry import Tables, query

TOKENS = r"regexp_extract_all(lower(text), '[a-z0-9+#.]+')"

BM25_CTE = rf"""
d AS (SELECT doc_id, {TOKENS} AS toks FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM d),
p AS (SELECT doc_id, len(toks) AS l, term, count(*) AS tf FROM (SELECT doc_id, toks, unnest(toks) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * l / mean)) * qtf) AS score
  FROM p JOIN df USING (term) JOIN q USING (term) CROSS JOIN st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
"""


def _docs(t: Tables):
    return t.documents.filter("text IS NOT NULL").select("doc_id", "lang", "source", T.tokenize(F.col("text")).alias("tokens"))


def _queries(t: Tables):
    return t.benchmark.select(F.col("item_id").alias("query_id"), T.tokenize(F.col("text")).alias("tokens"))


def _ranked(t: Tables, most: int):
    return top_documents(_docs(t), _queries(t), most)


@query(f"WITH {BM25_CTE} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 25")
def a9_bm25(t: Tables):
    """BM25 of every benchmark text over all documents: the best 25 of each."""
    return _ranked(t, 25).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_IDEAL = "list_sum(list_transform(range(1, greatest(least(total, {k}), 1) + 1), lambda i: 1 / log2(i + 1)))"
_CUT = "sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END)"


@query(
    f"""WITH {BM25_CTE}, lab AS (SELECT doc_id, max(quality) AS rel FROM labels GROUP BY 1), tot AS (SELECT sum(rel)::BIGINT AS total FROM lab),
    j AS (SELECT r.query_id, r.rank, coalesce(lab.rel, 0) AS rel, total FROM r LEFT JOIN lab USING (doc_id) CROSS JOIN tot WHERE rank <= 50)
    SELECT query_id, round(coalesce(1.0 / min(CASE WHEN rel = 1 THEN rank END), 0), 6) AS mrr, """
    + ", ".join(
        f"round({_CUT.format(k=k)} / sum((rank <= {k})::INT), 6) AS p_at_{k}, round({_CUT.format(k=k)} / max(total), 6) AS r_at_{k}, round(sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0 END) / max({_IDEAL.format(k=k)}), 6) AS ndcg_at_{k}"
        for k in (10, 25, 50)
    )
    + " FROM j GROUP BY query_id"
)
def a10_ranking_metrics(t: Tables):
    """Precision, recall, nDCG and MRR of the BM25 rankings; labelled good documents are relevant."""
    rel = t.labels.groupBy("doc_id").agg(F.max("quality").alias("rel"))
    total = rel.agg(F.sum("rel").alias("total"))
    top = _ranked(t, 50).join(rel, "doc_id", "left").withColumn("rel", F.coalesce("rel", F.lit(0))).join(F.broadcast(total))
    m = R.ranking_metrics(top, "rel", "total")
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in m.columns if c != "query_id"])


@query(f"WITH {BM25_CTE}, lab AS (SELECT doc_id, max(quality) AS rel FROM labels GROUP BY 1) SELECT query_id, min(rank) AS first_rank FROM r JOIN lab USING (doc_id) WHERE rel = 1 GROUP BY 1")
def w3_first_relevant_rank(t: Tables):
    """The rank of each query's first document of quality 1 among all documents that share a term with it."""
    return first_ranks(_docs(t), _queries(t), t.labels.filter("quality = 1"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL")
def a5_term_frequency(t: Tables):
    return R.postings(_docs(t), "doc_id", "tokens").select(F.col("key").alias("doc_id"), "term", "tf")


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL")
def a4_document_frequency(t: Tables):
    return _docs(t).select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@query(f"SELECT lang, count(*) AS docs, sum((len({TOKENS}) = 0)::INT)::BIGINT AS empty_docs, round(avg(len({TOKENS})), 6) AS mean_tokens FROM documents WHERE text IS NOT NULL GROUP BY lang")
def a8_lane_diagnostics(t: Tables):
    n = F.size("tokens")
    return _docs(t).groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(n == 0).alias("empty_docs"), F.round(F.avg(n), 6).alias("mean_tokens"))


@query(f"SELECT lang, round(avg(len({TOKENS})) OVER (), 6) AS global_mean, doc_id FROM documents WHERE text IS NOT NULL")
def a7_global_mean(t: Tables):
    d = _docs(t)
    mean = d.agg(F.avg(F.size("tokens")).alias("m"))
    return d.join(F.broadcast(mean)).select("lang", F.round("m", 6).alias("global_mean"), "doc_id")


@query(
    f"""WITH o AS (SELECT DISTINCT lang, doc_id, term FROM (SELECT lang, doc_id, unnest({TOKENS}) AS term FROM documents)),
    n AS (SELECT count(DISTINCT doc_id) AS n FROM o), sz AS (SELECT lang, count(DISTINCT doc_id) AS size FROM o GROUP BY 1),
    df AS (SELECT term, count(*) AS df FROM o GROUP BY 1), c AS (SELECT lang, term, count(*) AS c FROM o GROUP BY ALL),
    s AS (SELECT lang, term, df, c / size * ln((n + 1) / (df + 1)) AS score FROM c JOIN sz USING (lang) JOIN df USING (term) CROSS JOIN n)
    SELECT lang, term, df, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(score, 9) DESC, df DESC, term) AS rank FROM s) WHERE rank <= 12"""
)
def a6_profiles(t: Tables):
    """The 12 terms that tell each language."""
    return R.profiles(_docs(t), "lang", "tokens").select("lang", F.col("skill").alias("term"), "df", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_NORM = r"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _sentences(t: Tables):
    """Every sentence of every benchmark text, in normal form."""
    return t.benchmark.select("item_id", F.explode(F.split("text", r"\.")).alias("s")).select("item_id", T.normalize_text(F.col("s")).alias("phrase")).filter("phrase <> ''")


@query(
    f"""WITH d AS (SELECT doc_id, {_NORM.format(c='text')} AS body FROM documents), f AS (SELECT item_id, {_NORM.format(c='sentence')} AS phrase FROM (SELECT item_id, unnest(string_split(text, '.')) AS sentence FROM benchmark) WHERE {_NORM.format(c='sentence')} <> '')
    SELECT item_id, doc_id, count(DISTINCT phrase) AS score FROM f JOIN d ON contains(' ' || body || ' ', ' ' || phrase || ' ') GROUP BY ALL"""
)
def j15_phrase_screen(t: Tables):
    """Documents that hold sentences of a benchmark text as phrases, and how many."""
    d = t.documents.select("doc_id", T.normalize_text(F.col("text")).alias("body"))
    f = _sentences(t)
    return R.phrase_screen(d, f, "doc_id", "body", "item_id", "phrase")


@query(
    f"""WITH d AS (SELECT doc_id, {_NORM.format(c='text')} AS body FROM documents), f AS (SELECT item_id, {_NORM.format(c='sentence')} AS phrase FROM (SELECT item_id, unnest(string_split(text, '.')) AS sentence FROM benchmark) WHERE {_NORM.format(c='sentence')} <> ''),
    h AS (SELECT DISTINCT d.doc_id FROM f JOIN d ON contains(' ' || body || ' ', ' ' || phrase || ' '))
    SELECT lang, source, grouping_id(lang, source)::BIGINT AS level, count(*) AS relevant, round(avg((h.doc_id IS NULL)::INT), 6) AS false_rejection
    FROM documents LEFT JOIN h USING (doc_id) GROUP BY GROUPING SETS ((lang), (source))"""
)
def a3_false_rejection_cube(t: Tables):
    """Share of documents without any hit, by language and by source."""
    d = t.documents.select("doc_id", "lang", "source", T.normalize_text(F.col("text")).alias("body"))
    f = _sentences(t)
    hit = R.phrase_hits(d, f, "doc_id", "body", "phrase").select("doc_id", F.lit(1).alias("hit")).distinct()
    rows = d.select("doc_id", "lang", "source").join(hit, "doc_id", "left").withColumn("miss", F.col("hit").isNull().cast("int"))
    g = rows.groupingSets([["lang"], ["source"]], "lang", "source").agg(F.grouping_id("lang", "source").alias("level"), F.count("*").alias("relevant"), F.round(F.avg("miss"), 6).alias("false_rejection"))
    return g.select("lang", "source", "level", "relevant", "false_rejection")


@query(
    f"""WITH x AS (SELECT doc_id, source, list_distinct(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ')) AS w FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM x), p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.w AS x, b.w AS y FROM r a JOIN r b ON a.source = b.source AND b.n = a.n + 1)
    SELECT a, b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM p"""
)
def a60_pair_jaccard(t: Tables):
    """Word set overlap of neighbouring documents of a source."""
    from quillon.functions.sets import jaccard
    from quillon.operators.sequences import neighbours

    x = t.documents.filter("source IS NOT NULL").select("doc_id", "source", F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), " ")).alias("w"))
    p = neighbours(x, "source", "doc_id", "w")
    return p.select(F.col("doc_id").alias("a"), F.col("next.doc_id").alias("b"), F.round(jaccard(F.col("w"), F.col("next.w")), 6).alias("jaccard"))


@query()
def c24_lanes_on_frozen_profiles(t: Tables):
    """Texts as predictions of documents in their languages, compared by both methods on the twelve terms of each language, frozen first."""
    p = R.profiles(_docs(t), "lang", "tokens").groupBy(F.col("lang").alias("domain")).agg(F.array_sort(F.collect_list("skill")).alias("phrases"))
    p = settled(p.filter("domain IS NOT NULL").select(F.concat(F.lit("profile-"), F.col("domain")).alias("profile_id"), "domain", "phrases"))
    d = t.documents.select("doc_id", F.col("lang").alias("domain"), T.normalize_text(F.col("text")).alias("text"))
    return compare_on_profiles(d, d, p, profiles_digest(p))
