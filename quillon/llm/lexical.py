"""Ranked lexical search by Block-Max WAND over sharded posting blocks.

Indexing: a task turns the documents of its partition into shards, without a shuffle. A shard numbers its
documents by id and keeps, for each term, blocks of BLOCK postings: gaps of document numbers and term
frequencies in as few bytes as each block needs, with the block's last document and the pairs of
frequency and document length that could give its highest impact. Pairs, not impacts, are kept because
impacts depend on the number and mean length of all documents, which are known once every shard is written.

Searching: a shard is one group. Lists of a query's terms stand at their next documents; the pivot is the
first document at which the sum of the lists' maxima passes the k-th best score so far. The lists up to it
move shallowly: only block ends and block maxima are read, those of lists that begin before the first block
end included. If they don't pass the threshold, all documents up to that end are skipped and nothing is
decompressed. Otherwise lists whose next document isn't known are moved to it, which decompresses the
block at the pivot; if that leaves the pivot, a new one is sought, else the documents from the pivot to the
first block end, STRIDE at least, are scored together. Of each shard and query k
rows are left, and Spark ranks those.

Queries reach the shards as broadcasts of QUERY_TERMS terms at most; more queries are taken in several such
parts. Where all queries together have no more terms than that, only these are indexed, else every term.

Defined results: a null text, or one without terms, is no document (it isn't counted either) or has no results as a query;
rows with the same id are documents of their own, as are those with a null id, which come first among equal scores; rows of one
query id are one query with the terms of all; scores of 0 are left out; an empty table gives an empty
result. A document counts whole, however long. Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.base import ascii_lower, blocks, map_batches, materialize, span_hashes, text_bytes, word_spans
from quillon.shipping import ship

#: Postings of a block.
BLOCK = 128
#: Documents and postings of a shard, about; a shard is searched in one task.
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 1 << 22
#: Documents that are scored at a time, at least, once a pivot's blocks have passed.
STRIDE = 512
#: Terms of queries that are broadcast at once.
QUERY_TERMS = 200_000

#: Letters, digits and all beyond ASCII are parts of terms.
TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_APART = np.ones(256, bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_INDEX = "shard bigint, term string, n int, last int, pairs binary, payload binary, ids array<bigint>, lengths array<bigint>"
_NAMES = [x.split()[0] for x in _INDEX.split(", ")]
_KINDS = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def terms_of(text: Column) -> Column:
    """Terms in order, with repeats; none for null."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(TERM_SQL), F.lit(0)), F.array().cast("array<string>"))


# --- the index --------------------------------------------------------------------------------


def pack(places: np.ndarray, tf: np.ndarray) -> bytes:
    """Gaps and frequencies, each in the narrowest unsigned integers that hold the block's."""
    gaps = np.diff(places, prepend=0)
    a, b = (np.min_scalar_type(int(x.max())) for x in (gaps, tf))
    return bytes([a.itemsize, b.itemsize]) + gaps.astype(a).tobytes() + tf.astype(b).tobytes()


def unpack(payload: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = payload[0], payload[1]
    gaps = np.frombuffer(payload, f"<u{a}", n, 2)
    return np.cumsum(gaps, dtype=np.int64), np.frombuffer(payload, f"<u{b}", n, 2 + a * n).astype(np.int64)


def competitive(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pairs of which no other has as high a frequency in as short a document."""
    order = np.lexsort((length, -tf))
    n = length[order]
    keep = np.ones(len(n), bool)
    keep[1:] = n[1:] < np.minimum.accumulate(n)[:-1]
    return np.stack([tf[order][keep], n[keep]], 1)


class _Shard:
    """Postings of documents as they come in."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.lengths: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.words: dict[int, bytes] = {}
        self.postings = 0

    def add(self, ids: list, data: np.ndarray, off: np.ndarray, wanted: np.ndarray | None) -> None:
        starts, ends, counts = word_spans(data, off, _APART)
        doc = np.repeat(np.arange(len(ids)) + len(self.ids), counts)
        h = span_hashes(data, starts, ends, lower=True)
        if wanted is not None and len(wanted):
            among = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
            h, doc, starts, ends = h[among], doc[among], starts[among], ends[among]
        elif wanted is not None:
            h, doc = h[:0], doc[:0]
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        self.parts.append((h[at], doc[at], np.diff(at, append=len(h))))
        first = np.ones(len(at), bool)
        first[1:] = h[at][1:] != h[at][:-1]
        for k in at[first]:
            if (key := int(h[k])) not in self.words:
                self.words[key] = data[starts[order[k]] : ends[order[k]]].tobytes().lower()
        self.ids += ids
        self.lengths.append(counts)
        self.postings += len(at)

    def rows(self, shard: int):
        """The shard's row of documents, then its blocks, term by term."""
        order = np.array(sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i] or 0)), np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        length = np.concatenate(self.lengths)[order]
        out = [(shard, None, None, None, None, None, [self.ids[i] for i in order], length.tolist())]
        h, doc, tf = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        doc = rank[doc]
        by = np.lexsort((doc, h))
        h, doc, tf = h[by], doc[by], tf[by]
        edges = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        for a, b in zip(edges, np.append(edges[1:], len(h))[: len(edges)], strict=True):
            term = self.words[int(h[a])].decode("utf-8", "replace")
            for i in range(a, b, BLOCK):
                j = min(b, i + BLOCK)
                pairs = competitive(tf[i:j], length[doc[i:j]]).astype("<i8").tobytes()
                out.append((shard, term, j - i, int(doc[j - 1]), pairs, pack(doc[i:j], tf[i:j]), None, None))
                if len(out) == 4096:
                    yield _batch(out)
                    out = []
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)


def _hashes(terms: list[str]) -> np.ndarray:
    data, off = text_bytes(pa.array(terms, pa.string()))
    return np.unique(span_hashes(data, off[:-1], off[1:]))


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: list[str] | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Rows of shards: one of its documents (ids, lengths), and one a block (term, n, last, pairs, payload).

    vocabulary: the only terms to keep, a bounded list; all if None. Terms of a shard are told apart by 64-bit hashes.
    """
    wanted = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(_hashes(vocabulary))

    def built(batches):
        shard, no = _Shard(), TaskContext.get().partitionId() << 24
        for batch in batches:
            ids, (data, off) = batch.column(0), text_bytes(batch.column(1))
            for a, b in blocks(off, min(1 << 18, shard_docs << 10)):
                shard.add(ids.slice(a, b - a).to_pylist(), data[off[a] : off[b]], off[a : b + 1] - off[a], None if wanted is None else wanted.value)
                if len(shard.ids) >= shard_docs or shard.postings >= SHARD_POSTINGS:
                    yield from shard.rows(no)
                    shard, no = _Shard(), no + 1
        if shard.ids:
            yield from shard.rows(no)

    return map_batches(docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")), built, _INDEX)


# --- the search -------------------------------------------------------------------------------


class Postings:
    """A term's blocks in a shard; a block is decompressed when it is first asked for."""

    def __init__(self, last: list[int], most: list[int], n: list[int], payload: list[bytes], length: np.ndarray):
        self.last, self.most, self.top, self.n, self.payload, self.length = last, most, max(most), n, payload, length
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts."""
        if b not in self.opened:
            places, tf = unpack(self.payload[b], self.n[b])
            self.opened[b] = places, impact(tf, self.length[places])
        return self.opened[b]


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's weight is multiplied by in a document of norm m."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def norms(length: np.ndarray, n: int, total: int) -> np.ndarray:
    """50 and 50 times the length over the mean length, by whole numbers."""
    if int(length.max(initial=0)) * 50 * n < 2**63:
        return 50 + (50 * length * n) // max(1, total)
    return np.array([50 + (50 * int(x) * n) // total for x in length], np.int64)


def best(lists: list[Postings], weights: list[int], docs: int, k: int, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the k best documents, ties to the smaller number, by Block-Max WAND."""
    most = [w * x.top for w, x in zip(weights, lists, strict=True)]
    at, block, known = [0] * len(lists), [0] * len(lists), [False] * len(lists)  # known: a list stands at a posting, not just before it
    live = list(range(len(lists)))
    threshold, top, score = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    while live:
        live.sort(key=at.__getitem__)
        total, pivot = 0, -1
        for i in live:
            total += most[i]
            if total > threshold:
                pivot = at[i]
                break
        if pivot < 0:
            break
        # shallow: block ends and maxima of the lists up to the pivot, then of those that begin before the first end
        bound, end, heads = 0, docs - 1, 0
        for i in live:
            if at[i] > pivot:
                break
            last, b = lists[i].last, block[i]
            if last[b] < pivot:
                block[i] = b = bisect_left(last, pivot, b)
                known[i] = False
                if b == len(last):
                    at[i] = docs
                    continue
            heads += 1
            bound += weights[i] * lists[i].most[b]
            end = min(end, last[b])
        here = [i for i in live if at[i] <= end]
        for i in here:
            if at[i] > pivot and bound <= threshold:
                a = block[i]
                bound += weights[i] * max(lists[i].most[a : bisect_left(lists[i].last, end, a) + 1])
        if bound <= threshold:
            for i in here:
                at[i], known[i] = end + 1, False
            live = [i for i in live if at[i] < docs]
            continue
        # deep: lists that stand before the pivot's block move to their true next posting
        moved = False
        for i in here:
            if at[i] <= pivot and not known[i]:
                places = lists[i].block(block[i])[0]
                at[i], known[i] = int(places[places.searchsorted(pivot)]), True
                moved |= at[i] > pivot
        if moved:
            live = [i for i in live if at[i] < docs]
            continue
        end = min(docs - 1, max(end, pivot + stride - 1))
        sums = np.zeros(end - pivot + 1, np.int64)
        for i in live:
            if at[i] > end:
                continue
            b, last = block[i], lists[i].last
            while True:
                places, values = lists[i].block(b)
                a, z = places.searchsorted((pivot, end + 1))
                sums[places[a:z] - pivot] += weights[i] * values[a:z]
                if z < len(places):
                    at[i], known[i] = int(places[z]), True
                    break
                b += 1
                if b == len(last):
                    at[i] = docs
                    break
                if last[b - 1] >= end:
                    at[i], known[i] = end + 1, False
                    break
            block[i] = b
        live = [i for i in live if at[i] < docs]
        hits = np.flatnonzero(sums > threshold)
        if len(hits):
            top, score = np.concatenate([top, hits + pivot]), np.concatenate([score, sums[hits]])
            if len(top) >= k:
                keep = np.lexsort((top, -score))[:k]
                top, score = top[keep], score[keep]
                threshold = int(score[-1])
    return top, score


def open_shard(table: pa.Table, n: int, total: int) -> tuple[list, dict[str, Postings]]:
    """Document ids by number, and the lists of the shard's terms."""
    term = table["term"].to_pylist()
    head = term.index(None)
    ids = table["ids"][head].as_py()
    length = norms(np.array(table["lengths"][head].as_py(), np.int64), n, total)
    counts, last, pairs, payload = (table[c].to_pylist() for c in ("n", "last", "pairs", "payload"))
    rows = sorted((i for i in range(len(term)) if i != head), key=lambda i: (term[i], last[i]))
    sizes = [len(pairs[i]) // 16 for i in rows]
    flat = np.frombuffer(b"".join(pairs[i] for i in rows), "<i8").reshape(-1, 2)
    each = impact(flat[:, 0], norms(flat[:, 1], n, total))
    most = np.maximum.reduceat(each, np.concatenate([[0], np.cumsum(sizes)[:-1]])).tolist() if rows else []
    lists: dict[str, list[int]] = {}
    for k, i in enumerate(rows):
        lists.setdefault(term[i], []).append(k)
    made = {t: Postings([last[rows[k]] for k in ks], [most[k] for k in ks], [counts[rows[k]] for k in ks], [payload[rows[k]] for k in ks], length) for t, ks in lists.items()}
    return ids, made


def search(docs: DataFrame, queries: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", qkey: str = "item_id", qtext: str = "text", query_terms: int = QUERY_TERMS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query."""
    asked = queries.select(F.col(qkey).cast("bigint").alias("item_id"), F.explode(terms_of(F.col(qtext))).alias("term")).distinct()
    asked = materialize(asked, "asked")
    size = asked.count()
    # a list of no more than query_terms
    vocabulary = [r[0] for r in asked.select("term").distinct().collect()] if size <= query_terms else None
    table = materialize(index(docs, key, text, vocabulary, shard_docs), "index")
    n, total = table.filter("term IS NULL").agg(F.sum(F.size(F.filter("lengths", lambda x: x > 0))), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, x: s + x))).first()
    n, total = int(n or 0), int(total or 0)
    df = table.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * n + 2).cast("double") / (2 * F.col("df") + 1))).cast("bigint")
    weighted = asked.join(df, "term").withColumn("w", weight).filter("w > 0")
    weighted = materialize(weighted.groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("terms")), "weights")
    ship(docs.sparkSession)
    parts = max(1, -(-size // query_terms))
    out = None
    for part in range(parts):  # one, unless there are more than query_terms query terms
        mine = weighted if parts == 1 else weighted.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        shared = docs.sparkSession.sparkContext.broadcast([(r.item_id, [(t.term, t.w) for t in r.terms]) for r in mine.collect()])
        found = table.groupBy("shard").applyInArrow(_searcher(shared, n, total, k), "item_id bigint, doc_id bigint, score bigint")
        out = found if out is None else out.union(found)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first()))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _searcher(shared, n: int, total: int, k: int):
    def searched(table: pa.Table) -> pa.Table:
        ids, lists = open_shard(table, n, total)
        items, found, scores = [], [], []
        for item, terms in shared.value:
            here = [(lists[t], w) for t, w in terms if t in lists]
            if here:
                top, score = best([x for x, _ in here], [w for _, w in here], len(ids), k)
                items += [item] * len(top)
                found += [ids[i] for i in top.tolist()]
                scores += score.tolist()
        return pa.table([pa.array(x, pa.int64()) for x in (items, found, scores)], ["item_id", "doc_id", "score"])

    return searched


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (SELECT doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * s.n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, s.n),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * p.n * s.n) // s.l))))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 50
"""
