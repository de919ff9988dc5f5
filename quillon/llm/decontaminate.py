"""Benchmark decontamination by spaced seeds [native].

Fixed masks ignore some positions of a window of tokens. Windows of benchmark items and documents
that agree on a mask's kept positions meet by hash; around each meeting the whole item is laid
over the document at that offset and the equal tokens are counted, so substituted tokens cost
their share only. Offsets at most SHIFT apart are one meeting with words put in or left out: the
tokens that stand among equal ones (6 of 9) at any of them are counted once. Documents with `least`
of an item's tokens, or with EQUAL of PART following tokens at one offset, are contaminated.

Items of LONG tokens and more are sought under MASKS, those of MIDDLE tokens and more under the lighter
SHORT_MASKS, those of SHORT tokens and more under TINY_MASKS, which keep any three of five neighbours, and
items of one to three tokens whole. Masks for which the benchmark has no item aren't laid.
With just the required 60 % of an item's tokens equal, at random places, items of 4 to 7 tokens
are always found, longer ones with a probability of 0.9 or more (tests/llm measures it).
Of a document only as many tokens as the item has are laid beside a place.

Defined results: null and blank texts have no windows and are clean; a null doc_id or item_id is not reported by `overlaps` and such
documents are kept by `clean`; repeated rows give one row per id pair, the best; empty tables give
empty results. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.base import BROADCAST_ROWS, materialize

#: Kept positions are 1.
MASKS = ("1111", "11011", "101101", "1100011")
SHORT_MASKS = ("111", "1101", "10101", "11001")
TINY_MASKS = ("111", "1101", "1011", "11001", "10011", "10101")
#: Items with fewer tokens are sought under SHORT_MASKS, under TINY_MASKS, or whole.
LONG, MIDDLE, SHORT = 12, 8, 4
#: Share of an item's tokens that makes a document contaminated.
LEAST = 0.6
#: So many equal tokens among so many following ones of an item make a document contaminated, however long the item.
EQUAL, PART = 16, 20
#: Tokens put in or left out between two parts of an item.
SHIFT = 8


def tokens(text: Column) -> Column:
    """Hashes of the words: lower case, without punctuation at either end."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[^\p{P}\x20\x09-\x0D](?:[^\x20\x09-\x0D]*[^\p{P}\x20\x09-\x0D])?"), F.lit(0))
    return F.coalesce(F.transform(found, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def seeds(hashed: DataFrame, masks: dict[int, str], h: str = "h") -> DataFrame:
    """Rows of hashed with at (window start), no (the mask's) and key for every window under every mask.

    The token array is laid beside itself, shifted; a row of the exploded arrays is a window, and
    its hashes are plain columns.
    """
    keep = [c for c in hashed.columns if c != h]
    reach = range(max(map(len, masks.values())))
    beside = hashed.select(*keep, *[F.slice(h, F.lit(k + 1), F.size(h)).alias(f"t{k}") for k in reach])
    rows = beside.select(*keep, F.posexplode(F.arrays_zip(*[f"t{k}" for k in reach])).alias("at", "z"))
    key = lambda n, m: F.when(F.col(f"z.t{len(m) - 1}").isNotNull(), F.xxhash64(F.lit(n), *[F.col(f"z.t{k}") for k, x in enumerate(m) if x == "1"]))
    flat = rows.select(*keep, "at", F.posexplode(F.array(*[key(n, m) for n, m in masks.items()])).alias("k", "key")).filter("key IS NOT NULL")
    return flat.select(*keep, "at", F.element_at(F.array(*[F.lit(n) for n in masks]), F.col("k") + 1).alias("no"), "key")


def laid_masks(sizes: list[int], long=MASKS, short=SHORT_MASKS) -> dict[int, str]:
    """number: mask, of the masks that items of these sizes (LONG for all longer ones) are sought under."""
    out = {}
    if any(n >= LONG for n in sizes):
        out |= dict(enumerate(long, 100))
    if any(MIDDLE <= n < LONG for n in sizes):
        out |= dict(enumerate(short, 200))
    if any(SHORT <= n < MIDDLE for n in sizes):
        out |= dict(enumerate(TINY_MASKS, 300))
    return out | {n: "1" * n for n in sizes if n < SHORT}


def overlaps(docs: DataFrame, bench: DataFrame, masks=MASKS, short_masks=SHORT_MASKS, least: float = LEAST, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, item_words, matched, overlap, start: the best place of each item in each contaminated document.

    Sides of joins are broadcast when counted within `broadcast_rows`; beyond it the same joins shuffle.
    """
    items = materialize(bench.select(F.col(item_id).alias("item_id"), tokens(F.col(item_text)).alias("h")).filter("item_id IS NOT NULL AND size(h) > 0").distinct(), "items")
    # at most LONG values, whatever the size of the benchmark
    sizes = sorted(r[0] for r in items.select(F.least(F.size("h"), F.lit(LONG)).alias("n")).distinct().collect())
    every = laid_masks(sizes, masks, short_masks) or {LONG: "1" * LONG}
    n_of, no = F.size("hh"), F.col("no")
    fits = ((no >= 300) & n_of.between(SHORT, MIDDLE - 1)) | (no.between(200, 299) & n_of.between(MIDDLE, LONG - 1)) | ((no >= 100) & (no < 200) & (n_of >= LONG)) | ((no < 100) & (n_of == no))
    placed = seeds(items.withColumn("hh", F.col("h")), every).filter(fits)
    placed = materialize(placed.select("item_id", F.size("hh").alias("n"), F.col("at").alias("j"), "key").distinct(), "seeds")
    n = placed.count()
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL")
    sought = base.select("doc_id", tokens(F.col("text")).alias("h"))
    found = seeds(sought, every).drop("no").join(F.broadcast(placed) if n <= broadcast_rows else placed, "key")
    places = materialize(found.select("doc_id", "item_id", "n", (F.col("at") - F.col("j")).alias("start")).distinct(), "hits")
    # each place is verified on the whole item, beside as many tokens of the document
    ids = places.select("doc_id").distinct()
    few = F.broadcast if places.count() <= broadcast_rows else (lambda x: x)
    texts = base.join(few(ids), "doc_id", "left_semi").select("doc_id", tokens(F.col("text")).alias("d"))
    texts = texts.withColumn("r", F.xxhash64("d"))  # rows of one doc_id are parts, told apart by their tokens
    beside = F.expr("slice(d, greatest(start, 0) + 1, greatest(n + least(start, 0), 0))")
    laid = texts.join(few(places), "doc_id").select("doc_id", "r", "item_id", "n", "start", beside.alias("d"))
    laid = laid.join(F.broadcast(items) if n <= broadcast_rows else items, "item_id").filter("size(h) = n").withColumn("o", F.expr("greatest(-start, 0)"))
    equal = F.expr("filter(sequence(0, size(h) - 1), i -> i >= o AND i - o < size(d) AND d[greatest(i - o, 0)] = h[i])")
    laid = laid.select("doc_id", "r", F.xxhash64("h").alias("v"), "item_id", F.size("h").alias("item_words"), equal.alias("p"), "start")
    among = F.expr("CASE WHEN size(p) >= 6 THEN transform(filter(sequence(0, size(p) - 1), k -> exists(sequence(greatest(k - 5, 0), least(k, size(p) - 6)), j -> p[j + 5] - p[j] < 9)), k -> p[k]) ELSE array() END")
    part = F.expr(f"CASE WHEN size(p) >= {EQUAL} THEN exists(sequence(0, size(p) - {EQUAL}), j -> p[j + {EQUAL - 1}] - p[j] < {PART}) ELSE false END")
    judged = laid.select("doc_id", "r", "v", "item_id", "item_words", "start", F.size("p").alias("matched"), among.alias("among"), part.alias("part"))
    judged = judged.filter((F.size("among") > 0) | (F.col("matched") / F.col("item_words") >= least))
    w = Window.partitionBy("doc_id", "item_id", "r", "v").orderBy("start")
    judged = judged.withColumn("new", F.coalesce((F.col("start") - F.lag("start").over(w) > SHIFT).cast("int"), F.lit(1))).withColumn("no", F.sum("new").over(w))
    met = judged.groupBy("doc_id", "item_id", "r", "v", "no").agg(F.first("item_words").alias("item_words"), F.max(F.struct("matched", (-F.col("start")).alias("s"))).alias("one"), F.size(F.array_distinct(F.flatten(F.collect_set("among")))).alias("sum"), F.max("part").alias("part"))
    met = met.select("doc_id", "item_id", "item_words", F.greatest("one.matched", "sum").alias("matched"), F.col("one.s").alias("s"), "part")
    met = met.withColumn("overlap", F.col("matched") / F.col("item_words")).filter((F.col("overlap") >= least) | F.col("part"))
    best = met.groupBy("doc_id", "item_id").agg(F.max(F.struct("overlap", F.col("item_words").alias("w"), "matched", "s")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.w").alias("item_words"), F.col("b.matched").alias("matched"), F.col("b.overlap").alias("overlap"), (-F.col("b.s")).alias("start"))


def clean(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """docs without the contaminated documents, whatever their number."""
    doc_id = options.get("doc_id", "doc_id")
    bad = materialize(overlaps(docs, bench, **options).select(F.col("doc_id").alias("__bad")).distinct(), "leaks")
    n = bad.count()
    return docs.join(F.broadcast(bad) if n <= options.get("broadcast_rows", BROADCAST_ROWS) else bad, F.col(doc_id) == F.col("__bad"), "left_anti")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return overlaps(docs, bench)
