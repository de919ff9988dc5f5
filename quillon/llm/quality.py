"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into bins. Shallow trees over one feature's bins, boosted in a cycle
over the features with a small rate, add up to one lookup table a feature; then trees over the
bins of the most useful pairs add up to two-way tables. A score is the logistic of the sum of the
looked-up values: for a batch, an addition of indexed tables.

Labels are learnt from at most `sample` labelled rows that are not held out, taken in the order of
a hash of their id (a documented bound); everything else covers all rows.

Defined results: null and blank texts have features of zero and a score like any other; null
labels and ids aren't learnt from; repeated rows score alike; without labels of both kinds every
score is the share of label 1 (0.5 without labels); an empty table gives an empty result. Extra
columns pass through, but for one with the name of the score, which the result's replaces.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.base import blocks, held_out, map_batches, materialize, span_hashes, text_bytes, word_spans

#: Labelled rows that training uses at most.
SAMPLE = 12_000
BINS = 32
ROUNDS = 60
RATE = 0.15
PAIRS = 6
PAIR_BINS = 8
FEATURES = ("log_bytes", "log_words", "word_length", "upper", "digits", "marks", "symbols", "bangs", "pipes", "plain_ends", "distinct_words", "distinct_pairs", "repeats", "lines", "line_words", "distinct_lines", "long_words", "top_word")

_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[48:58] = 2
for _c in b".,;:'\"-()?":
    _KIND[_c] = 3
for _c in b"#%&$*@^~=+<>{}[]\\/_`":
    _KIND[_c] = 4
_KIND[33], _KIND[124], _KIND[10] = 5, 6, 7
_KIND[128:192] = 8  # continuation bytes


def text_features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES a document."""
    n = len(off) - 1
    out = np.zeros((n, len(FEATURES)))
    starts, ends, counts = word_spans(data, off)
    h = span_hashes(data, starts, ends, True)
    kinds = _KIND[data]
    last = data[ends - 1] if len(ends) else data[:0]
    clean = np.isin(_KIND[last], (0, 1, 8)) | np.isin(last, np.frombuffer(b".,", np.uint8))
    size = ends - starts
    at = 0
    for i, m in enumerate(counts.tolist()):
        a, b = off[i], off[i + 1]
        out[i, 0], out[i, 1] = np.log1p(b - a), np.log1p(m)
        if m:
            k = np.bincount(kinds[a:b], minlength=9)
            bytes_ = max(1, b - a)
            w, z = h[at : at + m], size[at : at + m]
            u, c = np.unique(w, return_counts=True)
            lines = np.flatnonzero(data[a:b] == 10)
            line_starts = np.concatenate([[0], lines + 1])
            pairs = w[1:] * np.uint64(0x9E3779B97F4A7C15) + w[:-1]
            out[i, 2] = z.mean()
            out[i, 3:9] = k[1] / bytes_, k[2] / bytes_, k[3] / bytes_, k[4] / bytes_, k[5] / bytes_, k[6] / bytes_
            out[i, 9] = clean[at : at + m].mean()
            out[i, 10] = len(u) / m
            out[i, 11] = len(np.unique(pairs)) / max(1, m - 1)
            out[i, 12] = (w[1:] == w[:-1]).mean() if m > 1 else 0.0
            out[i, 13] = np.log1p(len(lines))
            out[i, 14] = m / (len(lines) + 1)
            cum = np.searchsorted(starts[at : at + m] - a, line_starts)
            sums = np.add.reduceat(w, np.minimum(cum, m - 1)) if len(cum) else w[:0]
            out[i, 15] = len(np.unique(sums)) / max(1, len(sums))
            out[i, 16] = (z > 14).mean()
            out[i, 17] = c.max() / m
        at += m
    return out


@dataclass
class AdditiveModel:
    """Lookup tables of single features and of pairs."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    squares: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        z = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            z += t[at[j]]
        for (i, j), t in zip(self.pairs, self.squares, strict=True):
            z += t[self.coarse[i][at[i]], self.coarse[j][at[j]]]
        return 1 / (1 + np.exp(-z))


def _step(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Values of a tree of a few leaves over ordered bins with gradient and curvature sums g and h."""
    parts, value = [(0, len(g))], np.zeros(len(g))
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + 1.0)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for q, (a, b) in enumerate(parts):
            if b - a > 1:
                m = np.arange(a + 1, b)
                got = gain(a, m) + gain(m, b) - gain(a, b)
                k = int(np.argmax(got))
                best = max(best, (float(got[k]), q, int(m[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    for a, b in parts:
        value[a:b] = (G[b] - G[a]) / (H[b] - H[a] + 1.0)
    return value


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, n_pairs: int = PAIRS) -> AdditiveModel:
    """Cyclic boosting of single features, then of the pairs that explain most of what is left."""
    m = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0) for j in range(m)]
    sizes = [len(c) + 1 for c in cuts]
    model = AdditiveModel(cuts, [np.zeros(s) for s in sizes], [(np.arange(s) * PAIR_BINS) // s for s in sizes])
    p = float(y.mean()) if len(y) else 0.5
    if not len(y) or p in (0.0, 1.0):
        p = min(max(p, 1e-3), 1 - 1e-3) if len(y) else 0.5
        model.base = float(np.log(p / (1 - p)))
        return model
    model.base = float(np.log(p / (1 - p)))
    at, z = model.bins(x), np.full(len(y), model.base)
    for _ in range(rounds):
        for j in range(m):
            q = 1 / (1 + np.exp(-z))
            v = rate * _step(np.bincount(at[j], y - q, sizes[j]), np.bincount(at[j], q * (1 - q), sizes[j]))
            model.tables[j] += v
            z += v[at[j]]
    q = 1 / (1 + np.exp(-z))
    small = [model.coarse[j][at[j]] for j in range(m)]

    def cells(i: int, j: int, w: np.ndarray) -> np.ndarray:
        return np.bincount(small[i] * PAIR_BINS + small[j], w, PAIR_BINS**2)

    use = sorted(((float((cells(i, j, y - q) ** 2 / (cells(i, j, q * (1 - q)) + 1)).sum()), i, j) for i in range(m) for j in range(i)), reverse=True)[:n_pairs]
    model.pairs = [(i, j) for _, i, j in use]
    model.squares = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in use]
    for _ in range(rounds // 3):
        for t, (i, j) in enumerate(model.pairs):
            q = 1 / (1 + np.exp(-z))
            g, h = cells(i, j, y - q).reshape(PAIR_BINS, PAIR_BINS), cells(i, j, q * (1 - q)).reshape(PAIR_BINS, PAIR_BINS)
            # one cut of the first feature, then a small tree of the second on either side
            G, H = np.cumsum(g.sum(1)), np.cumsum(h.sum(1))
            k = int(np.argmax(G[:-1] ** 2 / (H[:-1] + 1) + (G[-1] - G[:-1]) ** 2 / (H[-1] - H[:-1] + 1))) + 1
            v = np.zeros((PAIR_BINS, PAIR_BINS))
            v[:k], v[k:] = rate * _step(g[:k].sum(0), h[:k].sum(0)), rate * _step(g[k:].sum(0), h[k:].sum(0))
            model.squares[t] += v
            z += v[small[i], small[j]]
    return model


def _featured(batches):
    for batch in batches:
        data, off = text_bytes(batch.column(0))
        for a, b in blocks(off):
            x = text_features(data[off[a] : off[b]], off[a : b + 1] - off[a])
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.FixedSizeListArray.from_arrays(x.reshape(-1), x.shape[1]).cast(pa.list_(pa.float64()))], ["y", "x"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, doc_id: str = "doc_id", text: str = "text", most_bytes: int | None = None) -> DataFrame:
    """text and y of at most `sample` labelled documents that aren't held out, one row an id.

    They are taken in the order of a hash of the id, as long as their texts have `most_bytes` together.
    An id with several texts is learnt from by the one with the least hash.
    """
    order = F.xxhash64(F.lit("fit"), "doc_id")
    some = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL").filter(~held_out(F.col("doc_id")))
    some = some.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(order, "doc_id").limit(sample)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # `some` holds `sample` rows at most
    rows = base.join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    if most_bytes is not None:
        w = Window.orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # `sample` rows at most
        rows = materialize(rows, "sample")
        sizes = rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
        within = sizes.withColumn("sum", F.sum("size").over(w)).filter(F.col("sum") <= most_bytes).select("doc_id")
        rows = rows.join(F.broadcast(within), "doc_id")
    return rows.select("text", "y")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> AdditiveModel:
    """The model learnt from the labelled sample; `sample` rows of features come to the driver at most."""
    rows = map_batches(labelled_sample(docs, labels, label, sample, doc_id, text), _featured, "y int, x array<double>").toPandas()
    x = np.vstack(rows.x.to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)))
    order = np.lexsort(x.T[::-1]) if len(rows) else []
    y = rows.y.to_numpy(float)
    return fit(x[order], y[order]) if len(rows) else fit(x, np.zeros(0))


def add_scores(docs: DataFrame, model: AdditiveModel, text: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with the score of every text."""
    cols = [c for c in (docs.columns if keep is None else keep) if c != name]
    sent = docs.select(*[F.col(f"`{c}`") for c in cols], F.col(text).alias("__text"))

    def scored(batches):
        for batch in batches:
            data, off = text_bytes(batch.column(len(cols)))
            s = [model.score(text_features(data[off[a] : off[b]], off[a : b + 1] - off[a])) for a, b in blocks(off)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], pa.array(np.concatenate(s) if s else np.zeros(0))], [*cols, name])

    schema = sent.select(*[F.col(f"`{c}`") for c in cols], F.lit(0.0).alias(name)).schema
    return map_batches(sent, scored, schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = add_scores(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
