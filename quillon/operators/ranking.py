"""Best documents of many queries in one scan: bounds by term and block of documents, k rows a query and task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.relations import settled
from quillon.operators.retrieval import K1, B
from quillon.shipping import ship

#: Documents of a block, neighbours in length.
BLOCK = 256
#: Rows (query, term) that go to the tasks at once; more queries are taken in several parts.
QUERY_TERMS = 200_000
#: Scores are compared to so many decimal places; equal ones go by key.
PLACES = 9
_SLACK = 10.0**-PLACES


class Model:
    """Terms, their weights, and the queries that have them, as arrays."""

    def __init__(self, queries: list[tuple[int, list[tuple[str, int]]]], idf: dict[str, float], mean: float):
        self.mean = mean
        self.terms = sorted(idf)
        self.idf = np.array([idf[t] for t in self.terms])
        number = {t: i for i, t in enumerate(self.terms)}
        kept = [(q, [(number[t], n) for t, n in ts if t in number]) for q, ts in queries]
        kept = [(q, ts) for q, ts in kept if ts]
        self.queries = [q for q, _ in kept]
        self.term = np.array([i for _, ts in kept for i, _ in ts], np.int64)
        self.times = np.array([n for _, ts in kept for _, n in ts], np.float64)
        self.start = np.cumsum([0, *[len(ts) for _, ts in kept]])

    def blocks(self, tokens: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of a block, numbers of the terms that it has, and weights (term, row)."""
        size, doc, term = _places(tokens, self.terms)
        rank = np.empty(len(size), np.int64)
        by_length = np.argsort(size, kind="stable")
        rank[by_length] = np.arange(len(size))
        code, tf = np.unique(rank[doc] * len(self.terms) + term, return_counts=True)
        at, term = code // len(self.terms), code % len(self.terms)
        length = size[by_length][at]
        weight = self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))
        cuts = np.searchsorted(at, np.arange(0, len(size) + BLOCK, BLOCK))
        for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if i < j:
                rows = by_length[b * BLOCK : (b + 1) * BLOCK]
                here, no = np.unique(term[i:j], return_inverse=True)
                dense = np.zeros((len(here), len(rows)))
                dense[no, at[i:j] - b * BLOCK] = weight[i:j]
                yield rows, here, dense

    def scored(self, tokens: pa.ListArray, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Query number, rows and scores of each block in which the query may pass its number in `least`, which may rise meanwhile.

        A block's bound is the sum of each term's greatest weight in it; blocks below the least score are not scored.
        """
        if not len(self.terms):
            return
        for rows, here, dense in self.blocks(tokens):
            place = np.full(len(self.terms), -1)
            place[here] = np.arange(len(here))
            top = np.zeros(len(self.terms))
            top[here] = dense.max(1)
            bound = np.add.reduceat(top[self.term] * self.times, self.start[:-1])
            for q in np.flatnonzero((bound > 0) & (bound >= least - _SLACK)):
                a, b = self.start[q], self.start[q + 1]
                some = place[self.term[a:b]]
                has = some >= 0
                yield int(q), rows, self.times[a:b][has] @ dense[some[has]]


def _best(keys: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by falling score, then key."""
    return np.lexsort((keys, -np.round(scores, PLACES)))[:k]


def _places(tokens: pa.ListArray, terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of each row, and row and term number of each token that is one of the terms."""
    size = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)).astype(np.int64)
    doc = np.repeat(np.arange(len(size)), size)
    term = np.asarray(pc.fill_null(pc.index_in(tokens.flatten(), value_set=pa.array(terms, pa.string())), -1)).astype(np.int64)
    return size, doc[term >= 0], term[term >= 0]


def _statistics(held: DataFrame, terms: list[str]) -> tuple[dict[str, float], float]:
    """Weight of each term that documents have, and their mean length, by one scan whose tasks emit counts only."""
    shared = held.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        names, df, n, total = shared.value, np.zeros(len(shared.value), np.int64), 0, 0
        for batch in batches:
            size, doc, term = _places(batch.column(1), names)
            n, total = n + len(size), total + int(size.sum())
            df += np.bincount(np.unique(doc * max(1, len(names)) + term) % max(1, len(names)), minlength=len(names))[: len(names)]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([None, *(names[i] for i in some)], pa.string()), pa.array([n, *df[some]], pa.int64()), pa.array([total] + [0] * len(some), pa.int64())], ["term", "df", "total"])

    sums = held.mapInArrow(count, "term string, df bigint, total bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).collect()
    n, total = next(((r["df"], r.total) for r in sums if r.term is None), (0, 0))
    return {r.term: float(np.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5))) for r in sums if r.term is not None}, total / n if total else 1.0


def _model(held: DataFrame, terms: DataFrame):
    """The broadcast model of a part of the queries."""
    rows = [(r["query"], [(t.term, t.times) for t in r.t]) for r in terms.groupBy("query").agg(F.collect_list(F.struct("term", "times")).alias("t")).collect()]
    idf, mean = _statistics(held, sorted({t for _, ts in rows for t, _ in ts}))
    return held.sparkSession.sparkContext.broadcast(Model(rows, idf, mean))


def _parts(queries: DataFrame, qkey: str, qtokens: str, query_terms: int) -> Iterator[DataFrame]:
    """The queries' terms (query, term, times), in parts of about `query_terms` rows."""
    terms = settled(queries.select(F.col(qkey).alias("query"), F.explode(qtokens).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times")))
    parts = max(1, -(-terms.count() // query_terms))
    for p in range(parts):
        yield terms if parts == 1 else terms.filter(F.pmod(F.xxhash64("query"), F.lit(parts)) == p)


def _pair(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.ListArray]:
    return np.asarray(batch.column(0)), batch.column(1)


def top_candidates(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", tokens: str = "tokens", qkey: str = "query_id", qtokens: str = "tokens", query_terms: int = QUERY_TERMS) -> DataFrame:
    """qkey, key, score: the k best documents of each query in each task. Rows without a key take no part."""

    def task(model):
        def run(batches):
            m = model.value
            least = np.full(len(m.queries), -np.inf)
            held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(m.queries)
            for batch in batches:
                keys, lists = _pair(batch)
                for q, rows, s in m.scored(lists, least):
                    hit = (s > 0) & (s >= least[q] - _SLACK)
                    if hit.any():
                        keys_, scores = np.concatenate([held[q][0], keys[rows[hit]]]), np.concatenate([held[q][1], s[hit]])
                        keep = _best(keys_, scores, k)
                        held[q] = keys_[keep], scores[keep]
                        if len(keep) == k:
                            least[q] = scores[keep[-1]]
            sizes = [len(x) for x, _ in held]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(m.queries, np.int64), sizes)), pa.array(np.concatenate([x for x, _ in held])), pa.array(np.concatenate([s for _, s in held]))], ["query", "key", "score"])

        return run

    ship(docs.sparkSession)
    held = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(tokens).alias("tokens"))
    parts = [held.mapInArrow(task(_model(held, terms)), "query bigint, key bigint, score double") for terms in _parts(queries.filter(F.col(qkey).isNotNull()), qkey, qtokens, query_terms)]
    return reduce(DataFrame.unionByName, parts).select(F.col("query").alias(qkey), F.col("key").alias(key), "score")


def top_documents(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", tokens: str = "tokens", qkey: str = "query_id", qtokens: str = "tokens", query_terms: int = QUERY_TERMS) -> DataFrame:
    """qkey, key, score, rank: the k best documents of each query by BM25; a repeated query term counts each time.

    What is shuffled is k rows a query and task. A task keeps the k best scores of each query and
    scores only blocks of documents whose bound passes the worst of them.
    """
    found = top_candidates(docs, queries, k, key, tokens, qkey, qtokens, query_terms)
    rank = F.row_number().over(Window.partitionBy(qkey).orderBy(F.round("score", PLACES).desc(), F.col(key)))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def first_ranks(docs: DataFrame, queries: DataFrame, wanted: DataFrame | None = None, key: str = "doc_id", tokens: str = "tokens", qkey: str = "query_id", qtokens: str = "tokens", query_terms: int = QUERY_TERMS, group: str | None = None, zeros: bool = False) -> DataFrame:
    """qkey, first_rank: the rank of each query's best wanted document in the ranking of all.

    Wanted are the documents of `wanted` (key), or those whose column `group` has the query's value.
    The best wanted document is a search of its own; then each task counts the documents before it,
    and again only blocks are scored that can have one. No ranking is made. With `zeros`, documents
    that share no term with a query are ranked too, behind all others and by key.
    """
    ship(docs.sparkSession)
    mark = F.col(group).cast("string") if group else F.lit("1")
    marked = docs.withColumn("__mark", mark) if wanted is None else docs.join(wanted.select(key).distinct().withColumn("__mark", mark), key, "left")
    held = settled(marked.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(tokens).alias("tokens"), "__mark"))
    asked = queries.filter(F.col(qkey).isNotNull())
    sc, parts = docs.sparkSession.sparkContext, []
    for terms in _parts(asked, qkey, qtokens, query_terms):
        model = _model(held, terms)
        known = {q: "1" for q in model.value.queries}
        if group:
            known = {r[0]: r[1] for r in asked.join(terms.select(F.col("query").alias(qkey)).distinct(), qkey, "left_semi").select(qkey, F.col(group).cast("string")).distinct().collect()}  # one a query of the part
        best = held.mapInArrow(_best_wanted(model, sc.broadcast(known)), "query bigint, key bigint, score double")
        best = best.groupBy("query").agg(F.min(F.struct((-F.col("score")).alias("s"), "key")).alias("b"))
        bests = {r["query"]: (r.b.key, -r.b.s) for r in best.collect()}  # one a query of the part
        if zeros:
            least = {r["__mark"]: r.k for r in held.filter(F.col("__mark").isin(*set(known.values()))).groupBy("__mark").agg(F.min("key").alias("k")).collect()} if known else {}
            bests = {q: (least[m], 0.0) for q, m in known.items() if m in least} | bests
        counted = held.mapInArrow(_before(model, sc.broadcast(bests)), "query bigint, n bigint")
        parts.append(counted.groupBy("query").agg(F.sum("n").alias("n")))
    return reduce(DataFrame.unionByName, parts).select(F.col("query").alias(qkey), (F.col("n") + 1).alias("first_rank"))


def _best_wanted(model, marks):
    """A task: the best document of each query among those with its mark."""

    def run(batches):
        m = model.value
        least = np.full(len(m.queries), -np.inf)
        held: list[tuple | None] = [None] * len(m.queries)
        for batch in batches:
            keys, lists = _pair(batch)
            chosen: dict[str, np.ndarray] = {}
            for q, rows, s in m.scored(lists, least):
                mark = marks.value.get(m.queries[q])
                if mark not in chosen:
                    chosen[mark] = np.asarray(pc.fill_null(pc.equal(batch.column(2), pa.scalar(mark, pa.string())), False))
                hit = (s > 0) & chosen[mark][rows] & (s >= least[q] - _SLACK)
                if hit.any():
                    k, v = keys[rows[hit]], np.round(s[hit], PLACES)
                    i = np.lexsort((k, -v))[0]
                    if held[q] is None or (-v[i], k[i]) < (-held[q][1], held[q][0]):
                        held[q] = int(k[i]), float(v[i])
                        least[q] = held[q][1]
        rows = [(m.queries[q], *h) for q, h in enumerate(held) if h]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["query", "key", "score"])

    return run


def _before(model, bests):
    """A task: how many documents come before each query's best wanted one; one of score 0 comes after all scored ones, by key among the rest."""

    def run(batches):
        m = model.value
        asked = list(bests.value.items())
        mine = [bests.value.get(q) for q in m.queries]
        least = np.array([h[1] if h else np.inf for h in mine])
        n = dict.fromkeys(bests.value, 0)
        for batch in batches:
            keys, lists = _pair(batch)
            order = np.sort(keys)
            for q, (k, v) in asked:
                if v == 0:
                    n[q] += int(np.searchsorted(order, k))
            for i, rows, s in m.scored(lists, least):
                if mine[i]:
                    k, v = mine[i]
                    x, other = np.round(s, PLACES), keys[rows]
                    n[m.queries[i]] += int(((x > v) | ((x == v) & (x > 0) & (other < k))).sum()) if v > 0 else int(((s > 0) & (other >= k)).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], ["query", "n"])

    return run
