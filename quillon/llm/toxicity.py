"""Toxic spans by a linear-chain conditional random field.

Tokens are words; two tags, clean and toxic. A token's emission is the sum of learnt weights of
its features: the word, its first three and four letters and its last three. Labels exist for documents
only, so token labels are made from them: within the training rows, words (or their first four
letters) whose log-odds of standing in a toxic document surely exceed ODDS mark the toxic tokens of
toxic documents, and all tokens of clean documents are clean. The CRF (emission weights over hashed features and a 2 x 2
transition table) is fitted to those tokens by gradient steps on the exact likelihood with
forward-backward expectations.

A document's marginals give its score, a logistic (fitted on the training rows) of the summed
log-odds of the tokens that are rather toxic than not, and its spans: runs of tokens whose marginal
is at least 0.5, as code point offsets.

Long texts are handled in pieces of PIECE tokens side by side; the messages that pass from piece to
piece are products of the pieces' transfer matrices, so the marginals are those of the whole text.

Training is bounded by documented parameters: `sample` labelled documents with `most_bytes` of text
together, in the order of a hash of their id, and, for the gradient steps, the documents with toxic tokens and
CLEAN_RATIO times as many clean ones (CLEAN_LEAST at least), in the order of a hash of their words.
The order of the rows has no influence.

Defined results: null and blank texts have no tokens and the score of a document without toxic
tokens; null labels and ids aren't learnt from; without labels of both kinds every score is that
of the prior; repeated rows score alike; an empty table gives an empty result. Extra columns pass through,
but for `toxicity` and `toxic_spans` of the input's, which the result's replace.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.base import blocks, held_out, map_batches, mix64, span_hashes, text_bytes, word_spans
from quillon.llm.quality import labelled_sample

#: Labelled rows that training uses at most.
SAMPLE = 8_000
#: Bytes of their texts together; a token is two bytes at least and comes to the driver as 16.
MOST_BYTES = 32 << 20
#: Features share a table of 2 ** BITS weights.
BITS = 18
#: A word marks toxic tokens if its log-odds exceed ODDS and chance explains it with exp(-SURE) at most, over all words.
ODDS = 2.0
SURE = 1.0
STEPS = 60
PIECE = 512
#: Clean documents that the chains are fitted to, for each one with toxic tokens, and at least.
CLEAN_RATIO = 1.0
CLEAN_LEAST = 50

_MASK = np.uint64((1 << BITS) - 1)
_WORD_BYTE = np.ones(256, bool)
for _c in b" \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>|*&%$#@/\\_=+-~^`0123456789":
    _WORD_BYTE[_c] = False


def token_features(data: np.ndarray, off: np.ndarray):
    """Feature slots (tokens x 4), starts, ends in bytes and tokens a document; a token is a run of letters."""
    plain = np.where(_WORD_BYTE[data], data, 32).astype(np.uint8) if len(data) else data
    starts, ends, counts = word_spans(plain, off)
    n = ends - starts
    parts = [
        span_hashes(data, starts, ends, True),
        span_hashes(data, starts, starts + np.minimum(n, 3), True) ^ np.uint64(0x1111),
        span_hashes(data, starts, starts + np.minimum(n, 4), True) ^ np.uint64(0x3333),
        span_hashes(data, ends - np.minimum(n, 3), ends, True) ^ np.uint64(0x7777),
    ]
    return np.stack([(p & _MASK).astype(np.int32) for p in parts], 1), starts, ends, counts


@dataclass
class Field:
    """weights over slots (log-odds of toxic), transitions, start, and the logistic over documents."""

    weights: np.ndarray
    trans: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0
    prior: float = 0.5

    def marginals(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return chain_marginals(self.weights[slots].sum(1) + self.bias, counts, self.trans)


def chain_marginals(e: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(toxic) of every token by forward-backward; e: emission log-odds, all chains side by side.

    Chains are cut into pieces, which advance together, one step for each position. What a piece
    does to the message that reaches it is a 2 x 2 matrix; these are multiplied along each chain
    first, so that every piece starts from its exact forward and backward messages.
    """
    total = len(e)
    if not total:
        return np.zeros(0)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    n = -(-counts // PIECE)
    doc = np.repeat(np.arange(len(counts)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    a = first[doc] + piece * PIECE
    b = np.minimum(a + PIECE, first[doc] + counts[doc])
    p = np.exp(trans - trans.max())
    x = np.exp(np.clip(e, -30, 30))  # odds of toxic at each token
    enters, leaves = _messages(x, p, a, b, doc, piece, n)
    order = np.argsort(-(b - a), kind="stable")
    a, length, enters, leaves = a[order], (b - a)[order], enters[order], leaves[order]
    width = int(length[0])
    live = np.searchsorted(-length, -np.arange(width), "left")  # pieces longer than each position
    forward = np.zeros((width, len(a)))
    f = None
    for t in range(width):
        o = x[a[: live[t]] + t]
        if f is None:
            inner = ~np.isnan(enters)
            f = np.where(inner, o * (p[0, 1] + enters * p[1, 1]) / (p[0, 0] + enters * p[1, 0]), o)
        else:
            f = o * (p[0, 1] + f[: live[t]] * p[1, 1]) / (p[0, 0] + f[: live[t]] * p[1, 0])
        forward[t, : live[t]] = f
    out = np.zeros(total)
    back = leaves.copy()
    for t in range(width - 1, -1, -1):
        k = live[t]
        if t + 1 < width:
            j = live[t + 1]
            o = x[a[:j] + t + 1] * back[:j]
            back[:j] = (p[1, 0] + o * p[1, 1]) / (p[0, 0] + o * p[0, 1])
        odds = forward[t, :k] * back[:k]
        out[a[:k] + t] = odds / (1 + odds)
    return out


def _messages(x: np.ndarray, p: np.ndarray, a: np.ndarray, b: np.ndarray, doc: np.ndarray, piece: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forward odds that reach each piece (nan for a chain's first) and the backward odds at its last token."""
    enters, leaves = np.full(len(a), np.nan), np.ones(len(a))
    some = np.flatnonzero(n[doc] > 1)
    if not len(some):
        return enters, leaves
    # the product of (transitions, emissions) over each piece; a chain starts without a transition
    m = np.tile(np.eye(2), (len(some), 1, 1))
    start, stop, inner = a[some], b[some], piece[some] > 0
    for t in range(int((stop - start).max())):
        on = np.flatnonzero(start + t < stop)
        step = m[on] @ p
        if t == 0:
            step[~inner[on]] = m[on][~inner[on]]
        step[:, :, 1] *= x[start[on] + t][:, None]
        m[on] = step / step.max((1, 2), keepdims=True)
    end = np.flatnonzero(np.append(piece[some][1:] == 0, True))
    for lo, hi in zip(np.concatenate([[0], end[:-1] + 1]).tolist(), end.tolist(), strict=True):
        v = np.ones(2)
        for k in range(lo, hi):
            v = v @ m[k]
            v = v / v.max()
            enters[some[k + 1]] = v[1] / max(v[0], 1e-300)
        v = np.ones(2)
        for k in range(hi, lo, -1):
            v = m[k] @ v
            v = v / v.max()
            leaves[some[k - 1]] = v[1] / max(v[0], 1e-300)
    return enters, leaves


def pair_sums(e: np.ndarray, m: np.ndarray, inner: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Expected numbers of neighbouring tags, from the marginals of both and their odds ratio.

    In a chain the four probabilities of neighbours have the odds ratio of the transitions, so the
    joint table follows from the two marginals.
    """
    ratio = float(np.exp(trans[0, 0] + trans[1, 1] - trans[0, 1] - trans[1, 0]))
    a, b = m[:-1], m[1:]
    if abs(ratio - 1) < 1e-6:
        both = a * b
    else:
        s = 1 + (a + b) * (ratio - 1)
        both = (s - np.sqrt(np.maximum(s * s - 4 * ratio * (ratio - 1) * a * b, 0))) / (2 * (ratio - 1))
    both = np.where(inner, both, 0.0)
    a, b = np.where(inner, a, 0.0), np.where(inner, b, 0.0)
    return np.array([[inner.sum() - a.sum() - b.sum() + both.sum(), b.sum() - both.sum()], [a.sum() - both.sum(), both.sum()]])


def document_scores(m: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The evidence of each document: the log-odds of its tokens that are rather toxic, summed up."""
    m = np.clip(m, 1e-6, 1 - 1e-6)
    cum = np.concatenate([[0], np.cumsum(np.maximum(np.log(m) - np.log1p(-m), 0))])
    stop = np.cumsum(counts)
    return cum[stop] - cum[stop - counts]


def distinct_documents(slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Documents that are no near copies of earlier ones: no two of three minimal word hashes agree."""
    keep, seen = np.zeros(len(counts), bool), set()
    stop = np.cumsum(counts)
    mul = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint64)
    for i, (a, b) in enumerate(zip((stop - counts).tolist(), stop.tolist(), strict=True)):
        if b > a:
            w = slots[a:b, 0].astype(np.uint64)
            x, y, z = (int(((w * m) & np.uint64(0xFFFFFFFF)).min()) for m in mul)
            pairs = {(0, x, y), (1, x, z), (2, y, z)}
            keep[i] = not pairs & seen
            seen |= pairs
    return keep


def by_words(slots: np.ndarray, counts: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents in the order of a hash of their words, whatever order they come in."""
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    h = np.zeros(len(counts), np.uint64)
    np.add.at(h, doc, mix64(slots[:, 0].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(BITS))))
    order = np.lexsort((y, counts, h))
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    rows = np.repeat(first[order], counts[order]) + np.arange(len(doc)) - np.repeat(np.cumsum(counts[order]) - counts[order], counts[order])
    return slots[rows], counts[order], y[order]


def fit(slots: np.ndarray, counts: np.ndarray, y: np.ndarray, steps: int = STEPS) -> Field:
    """The field learnt from documents: tokens' slots, tokens a document, toxic 0/1 a document."""
    size = 1 << BITS
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    off = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max() or not len(slots):
        return Field(np.zeros(size), np.zeros((2, 2)), -20.0, 0.0, off, prior)
    slots, counts, y = by_words(slots, counts, y)
    own = distinct_documents(slots, counts)  # groups of copies would lend their words weight
    if 0 < y[own].sum() < own.sum():
        slots, counts, y = slots[np.repeat(own, counts)], counts[own], y[own]
    doc = np.repeat(np.arange(len(counts)), counts)
    # each slot counts once a document
    n1, n0 = y.sum() + 1.0, (1 - y).sum() + 1.0
    told = []
    for c in (0, 2):  # the word itself, or else how it begins
        u = np.unique(doc * np.int64(size) + slots[:, c])
        d, s = u // size, u % size
        pos, neg = np.bincount(s[y[d] == 1], minlength=size), np.bincount(s[y[d] == 0], minlength=size)
        odds = np.log((pos + 0.5) / n1) - np.log((neg + 0.5) / n0)
        # a likelihood ratio test against the share of toxic documents, as many times as there are words
        ratio = pos * np.log(np.maximum(pos, 1e-9) / np.maximum((pos + neg) * prior, 1e-9)) + neg * np.log(np.maximum(neg, 1e-9) / np.maximum((pos + neg) * (1 - prior), 1e-9))
        told.append((odds > ODDS) & (ratio > np.log(max(1, np.count_nonzero(pos + neg))) + SURE))
    label = ((told[0][slots[:, 0]] | told[1][slots[:, 2]]) & (y[doc] == 1)).astype(float)
    # the chains that are fitted: all documents with a toxic token, and as many clean ones
    marked = np.bincount(doc, label, len(counts)) > 0
    clean = np.flatnonzero((y == 0) & (counts > 0))
    chosen = marked.copy()
    chosen[clean[: max(CLEAN_LEAST, int(CLEAN_RATIO * marked.sum()))]] = True  # documents stand in the order of a hash
    take = chosen[doc]
    some, label, lens = slots[take], label[take], counts[chosen]
    part = np.repeat(np.arange(len(lens)), lens)
    prev, nxt, inner = label[:-1], label[1:], part[:-1] == part[1:]
    seen = np.array([[((1 - prev) * (1 - nxt) * inner).sum(), ((1 - prev) * nxt * inner).sum()], [(prev * (1 - nxt) * inner).sum(), (prev * nxt * inner).sum()]])
    w, trans, bias = np.zeros(size), np.zeros((2, 2)), -4.0
    flat, inv = np.unique(some, return_inverse=True)
    inv = inv.reshape(some.shape)
    v, ada = np.zeros(len(flat)), np.full(len(flat), 1e-6)
    ada_b, ada_t = 1e-6, np.full((2, 2), 1e-6)
    for _ in range(steps):
        e = v[inv].sum(1) + bias
        m = chain_marginals(e, lens, trans)
        g_tok = label - m
        g = np.bincount(inv.reshape(-1), np.repeat(g_tok, inv.shape[1]), len(flat)) - 0.05 * v
        ada += g * g
        v += 0.5 * g / np.sqrt(ada)
        gb = g_tok.sum()
        ada_b += gb * gb
        bias += 0.3 * gb / np.sqrt(ada_b)
        want = pair_sums(e, m, inner, trans)
        gt = seen - want
        ada_t += gt * gt
        trans = trans + 0.1 * gt / np.sqrt(ada_t)
    w[flat] = v
    field = Field(w, trans, bias, prior=prior)
    s = np.log1p(document_scores(field.marginals(slots, counts), counts))
    a, b = 1.0, off
    for _ in range(200):  # Newton steps of a logistic in one variable
        q = 1 / (1 + np.exp(-(a * s + b)))
        h = q * (1 - q) + 1e-6
        g = np.array([((y - q) * s).sum() - 1e-2 * a, (y - q).sum()])
        hess = np.array([[(h * s * s).sum() + 1e-2, (h * s).sum()], [(h * s).sum(), h.sum()]])
        step = np.linalg.solve(hess, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    field.a, field.b = float(a), float(b)
    return field


def score_documents(field: Field, data: np.ndarray, off: np.ndarray, spans: bool = True):
    """Scores of the documents and, for each, its toxic spans as (start, end) in bytes."""
    slots, starts, ends, counts = token_features(data, off)
    m = field.marginals(slots, counts)
    s = 1 / (1 + np.exp(-(field.a * np.log1p(document_scores(m, counts)) + field.b)))
    found: list[list[tuple[int, int]]] = [[] for _ in range(len(counts))]
    if spans:
        hit = np.flatnonzero(m >= 0.5)
        doc = np.searchsorted(np.cumsum(counts), hit, "right")
        for d, t in zip(doc.tolist(), hit.tolist(), strict=True):
            run = found[d]
            if run and run[-1][2] == t - 1:
                run[-1] = (run[-1][0], int(ends[t] - off[d]), t)
            else:
                run.append((int(starts[t] - off[d]), int(ends[t] - off[d]), t))
    return s, [[(a, b) for a, b, _ in run] for run in found]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, most_bytes: int = MOST_BYTES, doc_id: str = "doc_id", text: str = "text") -> Field:
    """The field learnt from the labelled sample; the sample's token slots come to the driver."""

    def slotted(batches):
        for batch in batches:
            data, off = text_bytes(batch.column(0))
            for a, b in blocks(off):
                slots, _, _, counts = token_features(data[off[a] : off[b]], off[a : b + 1] - off[a])
                at = np.concatenate([[0], np.cumsum(counts)]) * slots.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(at.astype(np.int32), slots.reshape(-1))], ["y", "s"])

    rows = map_batches(labelled_sample(docs, labels, label, sample, doc_id, text, most_bytes), slotted, "y int, s array<int>").toArrow()
    y = rows["y"].to_numpy().astype(float)
    lists = rows["s"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    counts = np.diff(lists.offsets.to_numpy()) // 4
    slots = lists.flatten().to_numpy().reshape(-1, 4)
    return fit(slots, counts.astype(np.int64), y)


def add_toxicity(docs: DataFrame, field: Field, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with toxicity and toxic_spans, code point offsets, ends exclusive."""
    cols = [c for c in (docs.columns if keep is None else keep) if c not in ("toxicity", "toxic_spans")]
    sent = docs.select(*[F.col(f"`{c}`") for c in cols], F.col(text).alias("__text"))

    def scored(batches):
        for batch in batches:
            data, off = text_bytes(batch.column(len(cols)))
            score, spans = [], []
            for a, b in blocks(off):
                s, found = score_documents(field, data[off[a] : off[b]], off[a : b + 1] - off[a])
                score.append(s)
                for i, run in enumerate(found):
                    if run:
                        cp = np.concatenate([[0], np.cumsum((data[off[a + i] : off[a + i + 1]] & 0xC0) != 0x80)])
                        run = [{"start": int(cp[x]), "end": int(cp[y])} for x, y in run]
                    spans.append(run)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], pa.array(np.concatenate(score) if score else np.zeros(0)), pa.array(spans, kind)], [*cols, "toxicity", "toxic_spans"])

    empty = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))
    schema = sent.select(*[F.col(f"`{c}`") for c in cols], F.lit(0.0).alias("toxicity"), empty.alias("toxic_spans")).schema
    return map_batches(sent, scored, schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    field = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = add_toxicity(docs, field, keep=["doc_id"])
    spans = F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"), spans.alias("spans"))
