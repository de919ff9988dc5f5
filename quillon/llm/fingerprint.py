"""Document fingerprints by consistent weighted sampling [native].

Terms are words, their weights the numbers of occurrences. For sample k each term draws, from
hashes of (term, k), r and c from Gamma(2, 1) and b from U(0, 1); with
t = floor(ln w / r + b) its value is ln c - r (t - b + 1), and the term with the least value is
the sample. The value identifies (term, t), so two texts agree on a sample with a probability
that equals the generalised Jaccard similarity of their weights.

Defined results: null and blank texts have no terms and an empty fingerprint, which is like another
empty one (1.0) and unlike any other (0.0). Documents with the same doc_id stand in one place of
the order: the next document of each is the next smaller id; of several texts of a neighbour the one with the
smallest 64-bit hash is compared, and the smallest head replaces the end. Null ids come last, as one place, and an id of
-2^63 counts as null.
A single document is its own next. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.base import SPACE_SQL, materialize

SAMPLES = 32
_TWO32 = float(2**32)


def _unit(h: Column, shift: int, bits: int) -> Column:
    """Bits of h as a number in (0, 1)."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(0.5)) / F.lit(float(1 << bits))


def sample_value(term: Column, lnw: Column, k: int) -> Column:
    """The value of a term under sample k."""
    x, y = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.ln(_unit(x, 0, 31) * _unit(x, 32, 31))
    c = -F.ln(_unit(y, 0, 24) * _unit(y, 24, 24))
    b = _unit(y, 48, 16)
    return F.ln(c) - r * (F.floor(lnw / r + b) - b + 1)


def term_runs(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, term, lnw, head: each distinct word of a text with the logarithm of its weight; head is 1 once a text.

    The words are counted inside the row, sorted, where runs become (term, weight); a text
    without words keeps one row of nulls.
    """
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE_SQL), lambda w: w != "")
    s = texts.select(*keys, F.sort_array(F.transform(words, lambda w: F.xxhash64(w))).alias("s"))
    first = lambda i: (i == 0) | (F.col("s")[i] != F.col("s")[F.greatest(i - 1, F.lit(0))])
    s = s.withColumn("at", F.when(F.size("s") > 0, F.filter(F.sequence(F.lit(0), F.size("s") - 1), first)).otherwise(F.array(F.lit(0))))
    s = s.select(*keys, "s", "at", F.concat(F.slice(F.col("at"), F.lit(2), F.size("at")), F.array(F.size("s"))).alias("to"))
    return s.select(*keys, F.inline(F.zip_with("at", "to", lambda a, b: F.struct(F.get(F.col("s"), a).alias("term"), F.when(b > a, F.ln((b - a).cast("double"))).alias("lnw"), (a == 0).cast("int").alias("head")))))


def fingerprinted(texts: DataFrame, keys: list[str], text: str, n: int) -> DataFrame:
    """keys, f (the fingerprint) and times (equal rows): one pass of partial minima, in the task that holds the text."""
    least = term_runs(texts, keys, text).groupBy(*keys).agg(F.sum("head").cast("int").alias("times"), *[F.min(sample_value(F.col("term"), F.col("lnw"), k)).alias(f"m{k}") for k in range(n)])
    return least.select(*keys, "times", F.when(F.col("m0").isNull(), F.lit("")).otherwise(packed(n)).alias("f"))


def packed(n: int = SAMPLES) -> Column:
    """Each sample as four hex digits."""
    return F.concat(*[F.lpad(F.hex(F.pmod(F.xxhash64(F.col(f"m{k}")), F.lit(65536))), 4, "0") for k in range(n)])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SAMPLES) -> DataFrame:
    """doc_id and fingerprint of each document; repeated rows give one row."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("r"), F.col(text).alias("text"))
    return fingerprinted(d, ["doc_id", "r"], "text", n).select("doc_id", F.col("f").alias("fingerprint"))


def likeness(a: Column, b: Column, n: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    same = sum((F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4)).cast("int") for k in range(n))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(same / F.lit(float(n)))


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, cut, next, prev over distinct ids in descending order, the last followed by the first.

    Ids are dealt into ranges, each is ordered on its own, and only the first id of every range is
    carried to the range before it: no task orders all ids.
    """
    ids = docs.select(F.coalesce(F.col(doc_id), F.lit(-(2**63))).alias("id"), F.floor(F.coalesce(F.length(text), F.lit(0)) / 3).cast("int").alias("cut"))
    ids = ids.groupBy("id").agg(F.max("cut").alias("cut"))
    ids = materialize(ids.repartitionByRange(F.col("id").desc()).withColumn("part", F.spark_partition_id()), "ids")
    w = Window.partitionBy("part").orderBy(F.col("id").desc())
    ends = ids.groupBy("part").agg(F.max("id").alias("top"), F.min("id").alias("low"))
    around = Window.orderBy("part")  # one row a partition
    ends = ends.select("part", F.lead("top").over(around).alias("nt"), F.lag("low").over(around).alias("pl"), F.first("top").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("t0"), F.last("low").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("l0"))
    inner = ids.withColumns({"n": F.lead("id").over(w), "p": F.lag("id").over(w)})
    return inner.join(F.broadcast(ends), "part").select("id", "cut", F.coalesce("n", "nt", "t0").alias("next"), F.coalesce("p", "pl", "l0").alias("prev"))


def edit_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text, of its edit with the next text's beginning, and how alike they and the next are."""
    base = docs.select(F.coalesce(F.col(doc_id), F.lit(-(2**63))).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = materialize(neighbours(docs, doc_id, text), "order")
    cuts = order.select(F.col("id").alias("cid"), F.col("cut").alias("pcut"))
    plan = materialize(order.join(cuts, order.prev == cuts.cid).select("id", "next", "prev", "pcut"), "cuts")
    here = base.join(plan, "id")
    heads = here.groupBy(F.col("prev").alias("id")).agg(F.min(F.expr("substring(text, 1, pcut)")).alias("head"))
    both = here.select("id", "next", "text", F.length("text").alias("n_chars")).join(heads, "id")
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, n_chars - cast(floor(n_chars / 3) as int))"), F.substring("head", F.lit(1), cut)))
    both = both.select("id", "next", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("id", "text").alias("r"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("x"))
    keys = ["id", "next", "n_chars", "edited_sha256", "r", "which"]
    flat = both.select(*keys[:-1], F.col("x.which").alias("which"), F.col("x.t").alias("t"))
    prints = fingerprinted(flat, keys, "t", n)
    rows = prints.groupBy(*keys[:-1]).agg(F.max(F.when(F.col("which") == 0, F.col("f"))).alias("fingerprint"), F.max(F.when(F.col("which") == 1, F.col("f"))).alias("edited_fingerprint"), F.max("times").alias("times"))
    rows = materialize(rows, "prints")
    nexts = rows.groupBy(F.col("id").alias("next")).agg(F.min(F.struct("r", F.col("fingerprint").alias("f"))).alias("nf"))
    out = rows.join(nexts, "next").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select(F.when(F.col("id") == F.lit(-(2**63)), F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint"), n).alias("near_edited"), likeness(F.col("fingerprint"), F.col("nf.f"), n).alias("near_next"))


def op10_fingerprint(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return edit_likeness(docs)
