"""URL filters: rules indexed by their rarest literal token [native].

A rule is a regular expression over ``host + path`` together with the literal tokens every
matching URL must hold. Each rule is filed under the one of its tokens that the fewest URLs hold;
a URL fetches the rules filed under its own tokens, and only those run their expression.

Defined results: null url, or one without ``://``: empty host and path, no rule, the default
verdict. Repeated rows and ids: each row is judged on its own. Ties: the longest rule wins, then
the smaller rule string. An empty table gives an empty result. Extra columns pass through, but for those
with a result's name, which the result's replace.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.base import BROADCAST_ROWS, materialize, maybe_broadcast

#: Rules over host and path: (rule string, verdict); the host and all its subdomains, paths that start so.
SITE_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: The method's own rules where no site rule fits: (expression, literal tokens, verdict).
PATTERN_RULES = (
    (r"(^|[.-])cheap-pills[.]", ("cheap", "pills"), "block"),
    (r"(^|[.-])adult-[a-z0-9]+[.]", ("adult",), "block"),
    (r"(^|[.-])free-bets[.]", ("free", "bets"), "block"),
)
#: Filed under this token where a rule has no literal token of its own; every URL carries it.
ANY = "*"
SALTS = 32


def site_rule(rule: str, verdict: str, rank: int = 1) -> tuple[str, str, list[str], str, int]:
    """(name, expression, tokens, verdict, rank) of a rule like example.org/es/."""
    host, slash, path = rule.partition("/")
    ends = [t for t in re.split(r"[^a-z0-9]+", host) if t] + [t for t in re.split(r"[^A-Za-z0-9]+", (slash + path).rpartition("/")[0]) if t]
    # re.escape's backslashes are read alike by Java; the last, unfinished path token is no whole token
    return rule, rf"^(?:[^/]*[.])?{re.escape(host)}{re.escape(slash + path)}", ends, verdict, rank


def rules_table(spark, site=SITE_RULES, patterns=PATTERN_RULES) -> DataFrame:
    """Rules as a table: rule, pattern, tokens, verdict, rank (site rules before patterns)."""
    rows = [site_rule(*x) for x in site] + [(p, p, list(t), v, 0) for p, t, v in patterns]
    return spark.createDataFrame(rows, "rule string, pattern string, tokens array<string>, verdict string, rank int")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(key: Column) -> Column:
    return F.array_union(F.array(F.lit(ANY)), F.split(key, r"[^A-Za-z0-9]+"))


def index_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """File each rule under the literal token that the fewest distinct URLs hold."""
    own = rules.select("rule", F.explode_outer("tokens").alias("token")).distinct()
    own = own.withColumn("token", F.coalesce("token", F.lit(ANY)))
    wanted = maybe_broadcast(own.select("token").distinct())
    seen = urls.select(F.explode(F.array_distinct(tokens_of(F.concat("__h", "__p")))).alias("token")).join(wanted, "token").groupBy("token").count()
    best = own.join(seen, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("b"))
    return rules.join(best.select("rule", F.col("b.token").alias("token")), "rule")


def filter_urls(pages: DataFrame, rules: DataFrame | None = None, url: str = "url", default: str = "allow", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add host, path, rule, verdict and rule_kind to every row of pages.

    Rules are broadcast only when counted within `broadcast_rows`; beyond that both sides meet on
    (token, salt), so that a token most URLs hold is spread over SALTS tasks.
    """
    spark = pages.sparkSession
    rules = rules_table(spark) if rules is None else rules
    judged = pages.withColumns({"__h": host_of(F.col(url)), "__p": path_of(F.col(url))})
    keys = materialize(judged.select("__h", "__p").distinct(), "urls")
    filed = materialize(index_rules(keys, rules), "rules")
    n = filed.count()
    tokens = keys.filter(F.col("__h") != "").select("__h", "__p", F.explode(F.array_distinct(tokens_of(F.concat("__h", "__p")))).alias("token"))
    if n <= broadcast_rows:
        fetched = tokens.join(F.broadcast(filed), "token")
    else:
        salted = filed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        fetched = tokens.withColumn("salt", F.pmod(F.hash("__h", "__p"), F.lit(SALTS))).join(salted, ["token", "salt"])
    hits = fetched.filter(F.expr("rlike(concat(__h, __p), pattern)"))
    order = F.struct("rank", F.length("rule").alias("l"), F.translate(F.hex("rule"), "0123456789ABCDEF", "FEDCBA9876543210").alias("t"), "rule", F.col("verdict").alias("v"))
    best = hits.groupBy("__h", "__p").agg(F.max(order).alias("__b"))
    joined = judged.join(best, ["__h", "__p"], "left")
    is_site = F.col("__b.rank") >= 1
    return joined.select(
        *[F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict", "rule_kind")],
        F.col("__h").alias("host"), F.col("__p").alias("path"),
        F.when(is_site, F.col("__b.rule")).alias("rule"),
        F.coalesce(F.col("__b.v"), F.lit(default)).alias("verdict"),
        F.when(is_site, "site").when(F.col("__b").isNotNull(), "pattern").otherwise("default").alias("rule_kind"),
    )


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "rule_kind")


OP1_SQL = r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT host, path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v
  FROM (SELECT DISTINCT host, path FROM p) d JOIN r ON (d.host = rh OR ends_with(d.host, '.' || rh)) AND starts_with(d.path, rp)
  GROUP BY host, path)
SELECT p.page_id, p.host, p.path, m.rule AS rule,
       coalesce(m.v, CASE WHEN b THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN m.rule IS NOT NULL THEN 'site' WHEN b THEN 'pattern' ELSE 'default' END AS rule_kind
FROM (SELECT *, host <> '' AND regexp_matches(host || path, '(^|[.-])(cheap-pills[.]|adult-[a-z0-9]+[.]|free-bets[.])') AS b FROM p) p
LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""
