"""Substring de-duplication by content-defined chunks.

A gear hash rolls over the bytes of the words, joined by single spaces. A chunk begins at a word whose first WIDTH bytes
have the least hash of some WINDOW following words, so boundaries depend on the text from there on only, settle again
right after an insertion or deletion, and stand at most WINDOW words apart. A chunk is identified
by a digest of the RUN words that begin at its boundary; the first and last RUN words of a text count as chunks too.
Any passage of RUN + WINDOW - 1 = 50 words holds a chunk as a whole.

A chunk is matched with the smallest document that has its digest, or, in that document, with the
greatest. A digest stands for as many words as a repeated passage needs, so whichever partner is
taken has a passage with the document, however many others quote parts of it. Chunks that follow each
other with the same partner at the same distance are a run, which is extended word by word, up
to MARGIN words on either side, as long as both texts agree. Runs of `run` words and more are repeated passages.

Defined results: null, blank and short texts have no repeated passages; a passage repeated inside
one document only isn't reported; rows with the same doc_id are parts of one document, told apart
by a 64-bit hash; exact repeated rows are one document; rows without an id are no document to share
a passage with and have no result; a document that shares a passage with several others has a row
for each run and partner; an empty table gives an empty result; a very long text is chunked whole, and the words around its runs are asked for by
stretches of STRETCH words. Of a document that has a digest twice, the smallest (row, place) is matched. Extra columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.base import BROADCAST_ROWS, IS_SPACE, blocks, map_batches, materialize, mix64, span_hashes, text_bytes, word_spans

#: Bytes that decide on a boundary, a power of two.
WIDTH = 16
#: Words among which one begins a chunk at least.
WINDOW = 11
#: Words that both texts must share for a repeated passage, and that identify a chunk.
RUN = 40
#: Words by which a run of chunks is extended at most on either side.
MARGIN = 64
#: Words of a text whose neighbours are asked for in one row.
STRETCH = 1024

_GEAR = np.random.default_rng(31).integers(0, 2**32, 256, dtype=np.uint32)
_COEF = np.random.default_rng(32).integers(1, 2**63, RUN, dtype=np.uint64) | np.uint64(1)


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the hash of the WIDTH bytes up to it: sums of shifted gears by doubling."""
    h, w = _GEAR[data], 1
    while w < WIDTH:
        shifted = np.zeros_like(h)
        shifted[w:] = h[:-w]
        h = h + (shifted << np.uint32(w))
        w *= 2
    return h


def boundaries(data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each word begins a chunk: its hash is the least of a window of its document."""
    n = len(starts)
    out = np.zeros(n, bool)
    if n < WINDOW:
        return out
    space = IS_SPACE[data]
    kept = ~space
    kept[1:] |= ~space[:-1]
    place = np.cumsum(kept) - 1
    plain = np.where(space, np.uint8(32), data)[kept]
    # the hash of a word's first bytes, mixed so that the least one is any; 0 is kept for windows over the edge of a document
    at = np.minimum(place[starts] + WIDTH - 1, len(plain) - 1)
    v = (mix64(gear(plain)[at].astype(np.uint64)) >> np.uint64(2)).astype(np.int64) + 1
    least = np.lib.stride_tricks.sliding_window_view(v, WINDOW).min(1)
    doc = np.repeat(np.arange(len(counts)), counts)
    least[doc[: n - WINDOW + 1] != doc[WINDOW - 1 :]] = 0
    around = np.concatenate([np.zeros(WINDOW - 1, np.int64), least, np.zeros(WINDOW - 1, np.int64)])
    return np.lib.stride_tricks.sliding_window_view(around, WINDOW).max(1) == v


def units(data: np.ndarray, off: np.ndarray):
    """(word, digest) of all chunks, chunks a document, and words a document."""
    starts, ends, counts = word_spans(data, off)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(counts), np.int64), counts
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    begin = boundaries(data, starts, counts)
    long = counts >= RUN
    begin[first[long]] = True
    begin[(first + counts - RUN)[long]] = True
    left = np.repeat(first + counts, counts) - np.arange(len(starts))  # words from here to the end of the document
    at = np.flatnonzero(begin & (left >= RUN))
    words = span_hashes(data, starts, ends)
    total = np.zeros(len(at), np.uint64)
    for j in range(RUN):
        total += words[at + j] * _COEF[j]
    per = np.diff(np.searchsorted(at, np.append(first, len(starts))))
    return at - np.repeat(first, per), mix64(total), per, counts


def _chunked(batches):
    for batch in batches:
        data, off = text_bytes(batch.column(2))
        for a, b in blocks(off):
            word, digest, per, counts = units(data[off[a] : off[b]], off[a : b + 1] - off[a])
            last = (word + RUN == np.repeat(counts, per)).astype(np.int64)
            lists = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
            one = lambda x: pa.ListArray.from_arrays(lists, x)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), one(digest.view(np.int64)), one((2 * word + last).astype(np.int32))], ["doc_id", "row", "digest", "place"])


def _sliced(batches):
    """Rows (row, text, asked) to the hashed words before (side 0, backwards) or from (side 1) each place that is asked for."""
    for batch in batches:
        row = batch.column(0).to_pylist()
        data, off = text_bytes(batch.column(1))
        out: list[tuple] = []
        for i, asked in enumerate(batch.column(2).to_pylist()):
            d = data[off[i] : off[i + 1]]
            starts, ends, _ = word_spans(d, np.array([0, len(d)]))
            h = (span_hashes(d, starts, ends) & np.uint64(0x7FFFFFFF)).astype(np.int32)
            for x in asked:
                at = x["at"]
                out.append((row[i], x["side"], at, h[at : at + MARGIN].tolist() if x["side"] else h[max(0, at - MARGIN) : at][::-1].tolist()))
                if len(out) == 1024:
                    yield _slices(out)
                    out = []
        if out:
            yield _slices(out)


_SLICES = "row bigint, side int, at int, near array<int>"


def _slices(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["row", "side", "at", "near"])


def _row(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


def _common(a: str, b: str) -> Column:
    """How many leading elements two arrays share."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.coalesce(F.when(at == 0, F.greatest(F.size(a), F.size(b))).otherwise(at - 1).cast("int"), F.lit(0))


def shared_runs(docs: DataFrame, run: int = RUN, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, row, start_word, end_word (exclusive), other_doc, other_start of each passage that another document has too.

    A row of the first shuffle is a digest with its least and greatest document, summed up within
    each task, so a passage that a third of all documents share is one row a task. Only chunks whose
    digest two documents have go further. Joins by digest are split by AQE where a digest is frequent.
    """
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    base = docs.select(F.col(doc_id).alias("doc_id"), _row(doc_id, text).alias("row"), F.col(text).alias("text")).filter("doc_id IS NOT NULL")
    chunked = materialize(map_batches(base, _chunked, "doc_id bigint, row bigint, digest array<bigint>, place array<int>"), "chunks")
    flat = chunked.select("doc_id", "row", F.explode(F.arrays_zip("digest", "place")).alias("x")).select("doc_id", "row", F.col("x.digest").alias("digest"), F.col("x.place").alias("place"))
    twice = flat.groupBy("digest").agg(F.min("doc_id").alias("f"), F.max("doc_id").alias("l")).filter("f <> l").select("digest")
    kept = materialize(flat.join(materialize(twice, "repeats"), "digest"), "kept")
    who = F.struct("doc_id", "row", "place")
    ends = materialize(kept.groupBy("digest").agg(F.min(who).alias("f"), F.max(who).alias("l")), "ends")
    other = F.when(F.col("doc_id") == F.col("f.doc_id"), F.col("l")).otherwise(F.col("f"))
    met = kept.join(ends, "digest").select("doc_id", "row", F.shiftright("place", 1).alias("word"), F.col("place").bitwiseAND(F.lit(1)).alias("last"), other.alias("o"))
    met = met.select("doc_id", "row", "word", "last", F.col("o.doc_id").alias("other"), F.col("o.row").alias("orow"), (F.col("word") - F.shiftright("o.place", 1)).alias("shift"))
    w = Window.partitionBy("row", "orow", "shift").orderBy("word")
    met = met.withColumn("new", F.coalesce((F.col("word") - F.lag("word").over(w) > RUN).cast("int"), F.lit(1))).withColumn("no", F.sum("new").over(w))
    whole = ["doc_id", "row", "other", "orow", "shift"]
    runs = met.groupBy(*whole, "no").agg(F.min("word").alias("a"), (F.max("word") + RUN).alias("b"), F.max("last").alias("last")).drop("no")
    runs = materialize(runs, "runs")
    # both ends of each run, unless it begins or ends with its text, and the words beyond them in both texts
    end = lambda side, c: F.struct(F.lit(side).alias("side"), F.col(c).alias("at"), (F.col(c) - F.col("shift")).alias("oat"))
    open_ = F.array_compact(F.array(F.when((F.col("a") > 0) & (F.col("a") > F.col("shift")), end(0, "a")), F.when(F.col("last") == 0, end(1, "b"))))
    ended = runs.select(*whole, "a", "b", F.explode(open_).alias("e")).select(*whole, "a", "b", "e.*")
    asked = ended.select("row", "side", "at").union(ended.select("orow", "side", "oat")).distinct()
    asked = asked.groupBy("row", F.floor(F.col("at") / STRETCH).alias("k")).agg(F.collect_list(F.struct("side", "at")).alias("asked"))  # 2 * STRETCH at most
    asked = materialize(asked.select("row", "asked"), "asked")
    texts = base.select("row", "text").join(small(asked.select("row").distinct()), "row", "left_semi")
    near = materialize(map_batches(texts.join(asked, "row").select("row", "text", "asked"), _sliced, _SLICES), "slices")
    theirs = near.select(F.col("row").alias("orow"), "side", F.col("at").alias("oat"), F.col("near").alias("far"))
    grown = ended.join(near, ["row", "side", "at"]).join(theirs, ["orow", "side", "oat"]).withColumn("n", _common("near", "far"))
    grown = grown.groupBy(*whole, "a", "b").agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("pre"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("post"))
    both = runs.join(grown, [*whole, "a", "b"], "left")
    both = both.select("doc_id", "row", "other", "shift", (F.col("a") - F.coalesce("pre", F.lit(0))).alias("a"), (F.col("b") + F.coalesce("post", F.lit(0))).alias("b"))
    # several rows of one partner, or two runs that grow together, give one passage
    out = both.groupBy("doc_id", "row", "other", "shift", "a").agg(F.max("b").alias("b")).groupBy("doc_id", "row", "other", "shift", "b").agg(F.min("a").alias("a"))
    return out.filter(F.col("b") - F.col("a") >= run).select("doc_id", "row", F.col("a").alias("start_word"), F.col("b").alias("end_word"), F.col("other").alias("other_doc"), (F.col("a") - F.col("shift")).alias("other_start"))


def repeated_passages(docs: DataFrame, run: int = RUN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start_word, end_word (exclusive), other_doc, other_start of each passage that another document has too."""
    return shared_runs(docs, run, doc_id, text).drop("row")


def drop_repeats(docs: DataFrame, run: int = RUN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the passages that a document with a smaller id has too.

    Every word that goes stands in a smaller document as well, and the smallest keeps it, so no
    passage is lost from all documents. Cuts belong to a text, not to all rows of its id.
    """
    cols = docs.columns
    cuts = shared_runs(docs, run, doc_id, text).filter("other_doc < doc_id").groupBy(F.col("row").alias("__row")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("__cuts"))

    def cut(batches):
        for batch in batches:
            texts = []
            i, j = cols.index(text), len(cols)
            for t, c in zip(batch.column(i).to_pylist(), batch.column(j).to_pylist(), strict=True):
                if t and c:
                    raw = t.encode()
                    starts, ends, _ = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    out, at = [], 0
                    for x in sorted(c, key=lambda x: (x["start_word"], x["end_word"])):
                        begin, end = int(starts[x["start_word"]]), int(ends[x["end_word"] - 1])
                        if begin > at:
                            out.append(raw[at:begin])
                        at = max(at, end)
                    t = b"".join([*out, raw[at:]]).decode()
                texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == i else batch.column(k) for k in range(len(cols))], cols)

    # a null id has a row of its own, so that no key gathers them
    key = F.when(F.col(doc_id).isNull(), F.xxhash64(F.monotonically_increasing_id(), F.lit("null"))).otherwise(_row(doc_id, text))
    joined = docs.withColumn("__key", key).join(cuts, F.col("__key") == F.col("__row"), "left").select(*[F.col(f"`{c}`") for c in cols], "__cuts")
    return map_batches(joined, cut, docs.schema)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_passages(docs)
