"""Counts, metrics, pivots and reports over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import sets as S
from quillon.functions import text as T
from quillon.operators import manifest as H
from quillon.operators import metrics as M
from quillon.operators import relations as R
from quillon.operators import resampling as B
from quillon.plans.registry import Tables, query

# a score of every labelled document that any engine computes alike: the share of its text's letters a-m
_SCORE = "round(length(regexp_replace(lower(text), '[^a-m]', '', 'g')) / greatest(length(text), 1), 4)"
SCORED_CTE = f"sc AS (SELECT l.doc_id, d.lang, d.source, l.quality, l.toxic, {_SCORE} AS score FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL)"


def scored(t: Tables):
    s = F.round(F.length(F.regexp_replace(F.lower("text"), "[^a-m]", "")) / F.greatest(F.length("text"), F.lit(1)), 4)
    return t.labels.filter("quality IS NOT NULL AND toxic IS NOT NULL").join(t.documents, "doc_id").select("doc_id", "lang", "source", "quality", "toxic", s.alias("score"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def a1_count_by_key(t: Tables):
    return t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT event_type, round(avg(coalesce(CASE WHEN value > 50 THEN value END, 0)), 6) AS mean_value, count(*) AS n FROM events GROUP BY 1")
def a2_mean_with_missing_as_zero(t: Tables):
    return t.events.groupBy("event_type").agg(F.round(F.avg(F.coalesce(F.when(F.col("value") > 50, F.col("value")), F.lit(0))), 6).alias("mean_value"), F.count("*").alias("n"))


@query(f"WITH {SCORED_CTE} SELECT lang, round(avg((score = 0)::INT), 6) AS zero_rate, count(*) AS n FROM sc WHERE quality = 1 GROUP BY 1")
def a11_zero_score_rate(t: Tables):
    return scored(t).filter("quality = 1").groupBy("lang").agg(F.round(F.avg((F.col("score") == 0).cast("int")), 6).alias("zero_rate"), F.count("*").alias("n"))


@query(
    f"""WITH {SCORED_CTE}, per AS (SELECT source, avg(score) AS m, sum(score) AS s, count(*) AS n FROM sc GROUP BY 1)
    SELECT round(sum(s) / sum(n), 6) AS micro, round(avg(m), 6) AS macro, count(*) AS groups FROM per"""
)
def a12_micro_and_macro(t: Tables):
    per = scored(t).groupBy("source").agg(F.avg("score").alias("m"), F.sum("score").alias("s"), F.count("*").alias("n"))
    return per.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("micro"), F.round(F.avg("m"), 6).alias("macro"), F.count("*").alias("groups"))


@query("SELECT d.source, round(coalesce(avg((1 - l.toxic)::DOUBLE), 0), 6) AS unsupported_rate FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def a13_unsupported_rate(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(F.round(F.coalesce(F.avg((1 - F.col("toxic")).cast("double")), F.lit(0.0)), 6).alias("unsupported_rate"))


@query("SELECT d.source, d.lang, bool_and(l.quality = 1) AS all_good FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL")
def a14_and_ignoring_nulls(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left").groupBy("source", "lang").agg(F.bool_and(F.col("quality") == 1).alias("all_good"))


@query("SELECT event_type, round(avg(coalesce(CASE WHEN value >= 10 THEN value END, 0)), 6) AS mean_latency FROM events GROUP BY 1")
def a15_mean_latency(t: Tables):
    return t.events.groupBy("event_type").agg(F.round(F.avg(F.coalesce(F.when(F.col("value") >= 10, F.col("value")), F.lit(0.0))), 6).alias("mean_latency"))


@query("SELECT user_id, count(*) AS routed, round(avg((event_type = 'purchase')::INT), 6) AS escalation_rate FROM events GROUP BY 1")
def a16_escalation_rate(t: Tables):
    return t.events.groupBy("user_id").agg(F.count("*").alias("routed"), F.round(F.avg((F.col("event_type") == "purchase").cast("int")), 6).alias("escalation_rate"))


_FOLD = "list_reduce(list_transform(string_split(sha256(concat_ws(chr(31), '20260609', doc_id::VARCHAR)), ''), lambda c: (instr('0123456789abcdef', c) - 1)::BIGINT), lambda a, d: (a * 16 + d) % 5)"
_OUT = "CASE WHEN abs(score - 0.45) <= 1e-9 THEN 'tie' WHEN score > 0.45 THEN 'win' ELSE 'loss' END"


@query(
    f"""WITH {SCORED_CTE}, o AS (SELECT {_FOLD} AS fold, {_OUT} AS outcome FROM sc)
    SELECT f.fold::BIGINT AS fold, count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'loss') AS losses, count(*) FILTER (outcome = 'tie') AS ties
    FROM range(5) f(fold) LEFT JOIN o USING (fold) GROUP BY 1"""
)
def a17_outcomes_by_fold(t: Tables):
    """Wins, losses and ties against a baseline of 0.45, for each stable fold, zero-filled."""
    d = F.col("score") - 0.45
    outcome = F.when(F.abs(d) <= 1e-9, "tie").when(d > 0, "win").otherwise("loss")
    o = scored(t).select(T.stable_fold(T.stable_hash(F.col("doc_id")), 5).alias("fold"), outcome.alias("outcome"))
    per = o.groupBy("fold").pivot("outcome", ["win", "loss", "tie"]).count()
    folds = t.spark.range(5).withColumnRenamed("id", "fold")
    return folds.join(per, "fold", "left").select("fold", *[F.coalesce(c, F.lit(0)).alias(n) for c, n in (("win", "wins"), ("loss", "losses"), ("tie", "ties"))])


@query(
    f"""WITH {SCORED_CTE}, th AS (SELECT score AS threshold FROM (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT score FROM sc)) WHERE i % greatest(ceil(n / 20.0), 1) = 0)
    SELECT threshold, count(*) AS routed, sum(quality)::BIGINT AS wins, sum(1 - quality)::BIGINT AS losses, round(count(*) / (SELECT count(*) FROM sc), 6) AS coverage, round(avg(quality), 6) AS precision_, round(sum(quality) / (SELECT sum(quality) FROM sc), 6) AS recall_
    FROM th JOIN sc ON sc.score <= threshold GROUP BY threshold"""
)
def a18_threshold_sweep(t: Tables):
    """Twenty thresholds at most: what is at or below each. Cumulative sums over distinct scores, no join of rows and thresholds."""
    per = scored(t).groupBy(F.col("score").alias("threshold")).agg(F.count("*").alias("n"), F.sum("quality").alias("w"), F.lit(1).cast("long").alias("one"))
    c = M.running(per, [F.col("threshold")], {"routed": "n", "wins": "w", "place": "one"})
    ends = c.agg(F.max("routed").alias("total"), F.max("wins").alias("good"), F.max("place").alias("k"))
    c = c.join(F.broadcast(ends)).filter((F.col("place") - 1) % F.greatest(F.ceil(F.col("k") / 20), F.lit(1)) == 0)
    return c.select("threshold", "routed", "wins", (F.col("routed") - F.col("wins")).alias("losses"), F.round(F.col("routed") / F.col("total"), 6).alias("coverage"), F.round(F.col("wins") / F.col("routed"), 6).alias("precision_"), F.round(F.col("wins") / F.col("good"), 6).alias("recall_"))


@query(
    """WITH p AS (SELECT l_orderkey, avg(l_discount) AS a, avg(l_tax) AS b FROM lineitem GROUP BY 1)
    SELECT round(avg(b - a), 6) AS mean_delta, sum((b - a > 1e-9)::INT)::BIGINT AS wins, sum((a - b > 1e-9)::INT)::BIGINT AS losses, sum((abs(a - b) <= 1e-9)::INT)::BIGINT AS ties FROM p"""
)
def a19_paired_comparison(t: Tables):
    p = t.lineitem.groupBy("l_orderkey").agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    d = F.col("b") - F.col("a")
    return p.agg(F.round(F.avg(d), 6).alias("mean_delta"), F.count_if(d > 1e-9).alias("wins"), F.count_if(d < -1e-9).alias("losses"), F.count_if(F.abs(d) <= 1e-9).alias("ties"))


@query()
def a20_bootstrap(t: Tables):
    """95 of a hundred means of order prices in 2,000 resamples, by a Poisson weight of each order in each."""
    return B.poisson_intervals(t.orders, "o_totalprice", "o_orderkey")


@query("SELECT source, max_by(doc_id, n_chars * 1000000 - doc_id) AS best FROM documents GROUP BY 1")
def a21_arg_max_first_wins(t: Tables):
    return R.first_seen(t.documents, ["source"], [F.col("n_chars").desc(), F.col("doc_id")]).select("source", F.col("doc_id").alias("best"))


@query(
    """SELECT source, list_sort(list_distinct(list_filter(flatten(list(list_transform(string_split_regex(text, '[,;|]'), lambda x: trim(lower(x))))), lambda x: x <> '' AND length(x) < 12))) AS vals FROM documents GROUP BY 1"""
)
def a22_sorted_set(t: Tables):
    parts = t.documents.select("source", F.explode(F.split("text", r"[,;|]")).alias("x")).select("source", F.trim(F.lower("x")).alias("x"))
    return parts.filter("x <> '' AND length(x) < 12").groupBy("source").agg(F.array_sort(F.collect_set("x")).alias("vals"))


@query(
    """WITH f AS (SELECT conv_id, role, min(turn) AS a FROM conversations GROUP BY ALL) SELECT conv_id, list(role ORDER BY a) AS roles FROM f GROUP BY 1"""
)
def a23_ordered_distinct(t: Tables):
    f = t.conversations.groupBy("conv_id", "role").agg(F.min("turn").alias("a"))
    return f.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "role"))), lambda x: x["role"]).alias("roles"))


@query(
    """WITH l AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
    SELECT o_custkey, count(*) AS orders, sum(n)::BIGINT AS lines, round(sum(q), 2) AS quantity, list(o_orderkey ORDER BY o_orderkey) AS keys FROM orders JOIN l ON l_orderkey = o_orderkey GROUP BY 1"""
)
def a24_nested_assembly(t: Tables):
    """Customer, order, line: three levels put together."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    j = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("n").alias("lines"), F.round(F.sum("q"), 2).alias("quantity"), F.array_sort(F.collect_list("o_orderkey")).alias("keys"))


_BUCKET = "CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 2000 THEN 1 ELSE 2 END"


@query(
    f"""WITH x AS (SELECT d.doc_id, lang, source, {_BUCKET} AS b, quality FROM documents d LEFT JOIN labels l USING (doc_id)),
    a AS (SELECT lang, source, b, sum(quality) AS y, count(quality) AS n FROM x GROUP BY ALL), c AS (SELECT lang, b, sum(quality) AS y, count(quality) AS n FROM x GROUP BY ALL)
    SELECT doc_id, round(CASE WHEN a.n >= 8 THEN (a.y + 1) / (a.n + 2) WHEN c.n >= 8 THEN (c.y + 1) / (c.n + 2) END, 6) AS p
    FROM x LEFT JOIN a USING (lang, source, b) LEFT JOIN c USING (lang, b)"""
)
def a25_smoothed_back_off(t: Tables):
    """Smoothed share of good documents of a bucket, of the wider bucket where the first has fewer than 8, else null."""
    b = F.when(F.col("n_chars") < 500, 0).when(F.col("n_chars") < 2000, 1).otherwise(2)
    x = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "lang", "source", b.alias("b"), "quality")
    stat = lambda keys, n: x.groupBy(*keys).agg(F.sum("quality").alias(f"y{n}"), F.count("quality").alias(f"n{n}"))
    j = x.join(stat(["lang", "source", "b"], 1), ["lang", "source", "b"], "left").join(stat(["lang", "b"], 2), ["lang", "b"], "left")
    p = lambda n: F.when(F.col(f"n{n}") >= 8, (F.col(f"y{n}") + 1) / (F.col(f"n{n}") + 2))
    return j.select("doc_id", F.round(F.coalesce(p(1), p(2)), 6).alias("p"))


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def a27_events_by_kind(t: Tables):
    return t.events.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


@query(
    """SELECT p_partkey, ((p_name IS NOT NULL AND p_name <> '')::INT + (p_brand IS NOT NULL)::INT + (p_type IS NOT NULL)::INT + (p_size > 25)::INT)::BIGINT AS complete,
    regexp_matches(p_name, '[0-9]') AS suspicious FROM part"""
)
def a28_completeness(t: Tables):
    n = (F.coalesce(F.col("p_name"), F.lit("")) != "").cast("int") + F.col("p_brand").isNotNull().cast("int") + F.col("p_type").isNotNull().cast("int") + (F.col("p_size") > 25).cast("int")
    return t.part.select("p_partkey", n.cast("long").alias("complete"), F.col("p_name").rlike("[0-9]").alias("suspicious"))


@query(
    """WITH c AS (SELECT source, lang, avg(n_chars) AS m FROM documents GROUP BY ALL) SELECT source, lang, round(m, 4) AS m, abs(m - max(m) OVER (PARTITION BY lang)) < 1e-9 AS best FROM c"""
)
def a31_best_per_column(t: Tables):
    c = t.documents.groupBy("source", "lang").agg(F.avg("n_chars").alias("m"))
    return c.select("source", "lang", F.round("m", 4).alias("m"), (F.abs(F.col("m") - F.max("m").over(Window.partitionBy("lang"))) < 1e-9).alias("best"))


@query(
    """WITH u AS (SELECT source, unnest(['quality', 'toxic']) AS check_, unnest([quality, toxic]) AS v FROM labels JOIN documents USING (doc_id))
    SELECT source, check_, round(avg((v = 1)::INT), 6) AS pass_rate, count(v) AS judged FROM u GROUP BY ALL"""
)
def a32_pass_rates(t: Tables):
    u = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").unpivot(["source"], ["quality", "toxic"], "check_", "v")
    return u.groupBy("source", "check_").agg(F.round(F.avg((F.col("v") == 1).cast("int")), 6).alias("pass_rate"), F.count("v").alias("judged"))


@query("SELECT conv_id, sum((role = 'assistant')::INT)::BIGINT AS yes, count(*) AS total, round(sum((role = 'assistant')::INT) / count(*), 6) AS score FROM conversations GROUP BY 1")
def a33_rubric_score(t: Tables):
    yes = F.count_if(F.col("role") == "assistant")
    return t.conversations.groupBy("conv_id").agg(yes.alias("yes"), F.count("*").alias("total"), F.round(yes / F.count("*"), 6).alias("score"))


@query(f"WITH {SCORED_CTE}, r AS (SELECT quality AS y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM sc) SELECT round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM r")
def a35_roc_auc(t: Tables):
    return M.auc(scored(t), "quality", "score").select(F.round("auc", 6).alias("auc"))


@query(
    f"""WITH {SCORED_CTE}, g AS (SELECT lang, quality AS y, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS rk FROM sc)
    SELECT lang, round(CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) ELSE 0.5 END, 6) AS auc FROM g GROUP BY 1"""
)
def a35_auc_by_group(t: Tables):
    return M.auc(scored(t), "quality", "score", ["lang"]).select("lang", F.round("auc", 6).alias("auc"))


_ROC = f"""{SCORED_CTE}, q AS (SELECT score, sum(quality) AS p, sum(1 - quality) AS n FROM sc GROUP BY 1),
c0 AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM q WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
c1 AS (SELECT *, tp - coalesce(lag(tp) OVER w, 0) AS a, lead(tp) OVER w - tp AS b, fp - coalesce(lag(fp) OVER w, 0) AS c, lead(fp) OVER w - fp AS d FROM c0 WINDOW w AS (ORDER BY score DESC)),
roc AS (SELECT score AS threshold, tp / max(tp) OVER () AS tpr, fp / max(fp) OVER () AS fpr FROM (SELECT score, tp, fp FROM c1 WHERE coalesce(a <> b OR c <> d, true) UNION ALL SELECT 'inf'::DOUBLE, 0, 0))"""


@query(f"WITH {_ROC} SELECT round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM roc")
def w11_roc_points(t: Tables):
    return M.roc_points(scored(t), "quality", "score").select(F.round("threshold", 6).alias("threshold"), F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query(f"WITH {_ROC} SELECT round(fpr, 6) AS eer, round((fpr + 1 - tpr) / 2, 6) AS eer_mean FROM roc ORDER BY round(abs(fpr - (1 - tpr)), 12), -threshold LIMIT 1")
def a36_equal_error_rate(t: Tables):
    e = M.equal_error_rate(M.roc_points(scored(t), "quality", "score"))
    return e.select(F.round("eer", 6).alias("eer"), F.round("eer_mean", 6).alias("eer_mean"))


@query(
    f"""WITH {_ROC}, i AS (SELECT *, row_number() OVER (ORDER BY threshold DESC) - 1 AS i, lag(fpr) OVER (ORDER BY threshold DESC) AS f0, lag(tpr) OVER (ORDER BY threshold DESC) AS t0 FROM roc),
    f AS (SELECT fpr, tpr FROM i WHERE i = 1), g AS (SELECT * FROM i WHERE fpr >= 0.01 AND i >= 1 ORDER BY i LIMIT 1)
    SELECT round(CASE WHEN f.fpr >= 0.01 THEN f.tpr ELSE coalesce(t0 + (g.tpr - t0) * (0.01 - f0) / nullif(g.fpr - f0, 0), g.tpr) END, 6) AS tpr FROM f, g"""
)
def a37_tpr_at_fpr(t: Tables):
    return M.tpr_at_fpr(M.roc_points(scored(t), "quality", "score")).select(F.round("tpr", 6).alias("tpr"))


@query(
    f"""WITH {SCORED_CTE}, x AS (SELECT lang, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn
      FROM (SELECT lang, quality AS y, (score >= 0.4)::INT AS p FROM sc) GROUP BY 1)
    SELECT lang, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity,
      round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * (tp + fn) + coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) * (tn + fp)) / (tp + fp + fn + tn), 6) AS weighted_f1 FROM x"""
)
def a38_confusion(t: Tables):
    x = scored(t).withColumn("p", (F.col("score") >= 0.4).cast("int")).groupBy("lang").agg(*M.confusion("quality", "p"))
    whole = {"lang", "tp", "fp", "fn", "tn"}
    return x.select(*[F.col(c) if c in whole else F.round(c, 6).alias(c) for c in x.columns])


@query(f"WITH {SCORED_CTE}, b AS (SELECT least(floor(score * 10), 9) AS b, count(*) AS n, avg(score) AS s, avg(quality) AS y FROM sc GROUP BY 1) SELECT round(sum(n * abs(s - y)) / sum(n), 6) AS ece FROM b")
def a39_calibration_error(t: Tables):
    return M.calibration_error(scored(t), "quality", "score").select(F.round("ece", 6).alias("ece"))


_SEQ = """g AS (SELECT user_id, count(*) AS frames, avg(value / 100) AS m, stddev_pop(value / 100) AS sd, regr_slope(value / 100, i) AS k FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) GROUP BY 1),
f AS (SELECT user_id, frames, m, CASE WHEN frames >= 2 AND sd < 0.1 THEN greatest(m, 0.7) ELSE m END AS gated, CASE WHEN frames < 2 THEN m ELSE 1 / (1 + exp(-(m + 3 * greatest(0, coalesce(k, 0))))) END AS drift FROM g)"""


def _frames(t: Tables):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t.events.select("user_id", (F.row_number().over(w) - 1).alias("i"), (F.col("value") / 100).alias("s"))


@query(f"WITH {_SEQ} SELECT user_id, frames, round(m, 6) AS mean_score, round(gated, 6) AS gated_score, round(drift, 6) AS drift_score FROM f")
def a40_sequence_scores(t: Tables):
    """Events of a user as frames of a clip: mean, gated and drift scores."""
    s = M.sequence_scores(_frames(t), "user_id", "i", "s")
    return s.select("user_id", "frames", *[F.round(c, 6).alias(c) for c in ("mean_score", "gated_score", "drift_score")])


@query(
    f"""WITH {_SEQ}, y AS (SELECT user_id, (count(*) FILTER (event_type = 'purchase') > 20)::INT AS y FROM events GROUP BY 1),
    z AS (SELECT th, y, (gated >= th)::INT AS p FROM f JOIN y USING (user_id) CROSS JOIN (SELECT unnest([0.40, 0.45, 0.50, 0.55, 0.60]) AS th))
    SELECT round(th, 2) AS threshold, round(avg((y = p)::INT), 6) AS accuracy, sum(p)::BIGINT AS flagged FROM z GROUP BY th"""
)
def a41_sweep_of_sequences(t: Tables):
    y = t.events.groupBy("user_id").agg((F.count_if(F.col("event_type") == "purchase") > 20).cast("int").alias("y"))
    s = M.sequence_scores(_frames(t), "user_id", "i", "s").join(y, "user_id")
    z = s.select("y", "gated_score", F.explode(F.array(*[F.lit(x) for x in (0.40, 0.45, 0.50, 0.55, 0.60)])).alias("th")).withColumn("p", (F.col("gated_score") >= F.col("th")).cast("int"))
    return z.groupBy("th").agg(F.round(F.avg((F.col("y") == F.col("p")).cast("int")), 6).alias("accuracy"), F.sum("p").alias("flagged")).select(F.round("th", 2).alias("threshold"), "accuracy", "flagged")


@query(
    f"""WITH {SCORED_CTE}, p AS (SELECT source, coalesce(avg(score) FILTER (lang = 'en'), 0) AS en, coalesce(avg(score) FILTER (lang = 'fr'), 0) AS fr, coalesce(avg(score) FILTER (lang = 'de'), 0) AS de, coalesce(avg(score) FILTER (lang = 'es'), 0) AS es FROM sc GROUP BY 1)
    SELECT source, round(en, 6) AS en, round(fr, 6) AS fr, round(de, 6) AS de, round(es, 6) AS es, round(en - (fr + de + es) / 3, 6) AS gap FROM p"""
)
def a42_pivot_matrix(t: Tables):
    """Source by language, with the gap between one language and the rest."""
    langs = ["en", "fr", "de", "es"]
    p = scored(t).groupBy("source").pivot("lang", langs).agg(F.avg("score")).na.fill(0.0, langs)
    return p.select("source", *[F.round(c, 6).alias(c) for c in langs], F.round(F.col("en") - (F.col("fr") + F.col("de") + F.col("es")) / 3, 6).alias("gap"))


@query("SELECT o_orderkey, unnest(['price', 'status_length']) AS measure, unnest([o_totalprice, length(o_orderstatus)::DOUBLE]) AS v FROM orders")
def a43_melt(t: Tables):
    return t.orders.select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), F.length("o_orderstatus").cast("double").alias("status_length")).unpivot(["o_orderkey"], ["price", "status_length"], "measure", "v")


@query("SELECT source, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def a44_two_key_counts(t: Tables):
    return t.documents.join(t.labels, "doc_id").groupBy("source", "quality").agg(F.count("*").alias("n"))


@query("SELECT round(avg((nullif(trim(text), '') IS NULL)::INT) * 100, 4) AS text_, round(avg((nullif(lang, 'es') IS NULL)::INT) * 100, 4) AS lang_, round(avg((quality IS NULL)::INT) * 100, 4) AS quality_ FROM documents LEFT JOIN labels USING (doc_id)")
def a45_null_percentages(t: Tables):
    j = t.documents.join(t.labels, "doc_id", "left")
    share = lambda c: F.round(F.avg(c.isNull().cast("int")) * 100, 4)
    return j.agg(share(F.nullif(F.trim("text"), F.lit(""))).alias("text_"), share(F.nullif(F.col("lang"), F.lit("es"))).alias("lang_"), share(F.col("quality")).alias("quality_"))


_WORDS = r"CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END"


@query(f"WITH w AS (SELECT lang, {_WORDS} AS n FROM documents WHERE text IS NOT NULL) SELECT lang, round(avg(n), 6) AS mean_words, max(n)::BIGINT AS max_words, min(n)::BIGINT AS min_words FROM w GROUP BY 1")
def a46_word_statistics(t: Tables):
    w = t.documents.filter("text IS NOT NULL").select("lang", T.word_count(F.col("text")).cast("long").alias("n"))
    return w.groupBy("lang").agg(F.round(F.avg("n"), 6).alias("mean_words"), F.max("n").alias("max_words"), F.min("n").alias("min_words"))


@query(
    """WITH w AS (SELECT source, term, count(*) AS n, min(doc_id) AS first FROM (SELECT source, doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9+#.]+')) AS term FROM documents) GROUP BY ALL)
    SELECT source, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first, term) AS rank FROM w) WHERE rank <= 10"""
)
def a47_top_terms(t: Tables):
    x = t.documents.select("source", "doc_id", F.explode(T.tokenize(F.col("text"))).alias("term")).groupBy("source", "term").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    w = Window.partitionBy("source").orderBy(F.col("n").desc(), "first", "term")
    return x.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 10").select("source", "term", "n", "rank")


@query("SELECT k, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM events), 4) AS pct FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def a49_key_coverage(t: Tables):
    total = t.events.agg(F.count("*").alias("t"))
    k = t.events.select(F.explode(F.json_object_keys("props")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return k.join(F.broadcast(total)).select("k", "n", F.round(F.col("n") * 100 / F.col("t"), 4).alias("pct"))


@query(
    """WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT lang, max(n_chars) FILTER (i = least(floor(n * 0.5), n - 1)) AS p50, max(n_chars) FILTER (i = least(floor(n * 0.95), n - 1)) AS p95 FROM r GROUP BY 1"""
)
def a50_picked_quantiles(t: Tables):
    return M.picked_quantiles(t.documents, "n_chars", ["lang"])


@query("WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT lang, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c")
def a51_class_weights(t: Tables):
    c, all_ = t.documents.groupBy("lang").agg(F.count("*").alias("n")), Window.partitionBy()
    return c.select("lang", F.round(F.sum("n").over(all_) / (F.count("*").over(all_) * F.col("n")), 6).alias("weight"))


@query(f"WITH {SCORED_CTE} SELECT lang, quality, round(avg(abs(quality - score)), 6) AS mae FROM sc GROUP BY ALL")
def a52_mean_absolute_error(t: Tables):
    return scored(t).groupBy("lang", "quality").agg(F.round(F.avg(F.abs(F.col("quality") - F.col("score"))), 6).alias("mae"))


@query(
    """WITH a AS (SELECT source, count(*) AS n, avg(n_chars) AS mean, avg((lang = 'en')::INT) AS share FROM documents GROUP BY 1)
    SELECT source, n, round(mean, 4) AS mean_chars, round(share, 6) AS share_en, CASE WHEN share >= 0.6 THEN 'include' ELSE 'exclude' END AS decision FROM a"""
)
def a53_dataset_audit(t: Tables):
    a = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean"), F.avg((F.col("lang") == "en").cast("int")).alias("share"))
    return a.select("source", "n", F.round("mean", 4).alias("mean_chars"), F.round("share", 6).alias("share_en"), F.when(F.col("share") >= 0.6, "include").otherwise("exclude").alias("decision"))


@query("SELECT count(DISTINCT doc_id) AS docs, sum(len(regexp_extract_all(lower(text), '[a-z0-9+#.]+')))::BIGINT AS tokens, count(DISTINCT source) AS sources FROM documents")
def a54_totals(t: Tables):
    return t.documents.agg(F.count_distinct("doc_id").alias("docs"), F.sum(F.size(T.tokenize(F.col("text")))).alias("tokens"), F.count_distinct("source").alias("sources"))


@query(H.root_sql("documents", "source", "doc_id", "sha256(concat_ws(chr(31), doc_id::VARCHAR, text))"))
def a55_manifest_hash(t: Tables):
    """The digest of each source's documents: the root of a tree over ranges of ids."""
    leaf = F.sha2(F.concat_ws("\x1f", F.col("doc_id").cast("string"), "text"), 256)
    return H.roots(H.merkle_nodes(t.documents, "source", "doc_id", leaf))


@query(
    f"""WITH {SCORED_CTE}, f AS (SELECT lang, avg(score) AS raw, avg(score) FILTER (toxic = 0) AS clean FROM sc GROUP BY 1) SELECT round(avg(raw), 6) AS raw_macro, round(avg(clean), 6) AS clean_macro FROM f"""
)
def a56_clean_macro(t: Tables):
    f = scored(t).groupBy("lang").agg(F.avg("score").alias("raw"), F.avg(F.when(F.col("toxic") == 0, F.col("score"))).alias("clean"))
    return f.agg(F.round(F.avg("raw"), 6).alias("raw_macro"), F.round(F.avg("clean"), 6).alias("clean_macro"))


@query("SELECT lang, round(avg((NOT contains(lower(text), 'the'))::INT), 6) AS absent_rate, count(*) AS n FROM documents GROUP BY 1")
def a57_evidence_absence(t: Tables):
    return t.documents.groupBy("lang").agg(F.round(F.avg((~F.lower("text").contains("the")).cast("int")), 6).alias("absent_rate"), F.count("*").alias("n"))


@query("SELECT source, sum(quality)::BIGINT AS good, sum(1 - quality)::BIGINT AS bad, round(sum(quality) / count(*), 6) AS balance FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def a59_class_balance(t: Tables):
    j = t.labels.join(t.documents, "doc_id")
    return j.groupBy("source").agg(F.sum("quality").cast("long").alias("good"), F.sum(1 - F.col("quality")).cast("long").alias("bad"), F.round(F.sum("quality") / F.count("*"), 6).alias("balance"))


_KEYS = "list_distinct(list_filter(list_transform(string_split_regex({c}, '[,;|\n]'), lambda x: lower(trim(x))), lambda x: x <> ''))"


@query(f"SELECT doc_id, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS f1 FROM (SELECT doc_id, {_KEYS.format(c='d.text')} AS a, coalesce({_KEYS.format(c='b.text')}, []) AS b FROM documents d LEFT JOIN benchmark b ON d.doc_id % 40 = b.item_id)")
def f33_keyword_f1(t: Tables):
    """Keyword sets of a whole document and the benchmark text of its number modulo 40."""
    keys = lambda c: S.clean_set(F.split(c, r"[,;|\n]"))
    b = t.benchmark.select("item_id", keys("text").alias("b"))
    j = t.documents.select("doc_id", keys("text").alias("a")).join(R.maybe_broadcast(b), F.col("doc_id") % 40 == F.col("item_id"), "left")
    m = S.set_metrics(F.col("a"), F.coalesce("b", F.array().cast("array<string>")))
    return j.select("doc_id", F.round(m["f1"], 6).alias("f1"))
