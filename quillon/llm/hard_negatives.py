"""Hard negatives by distributed radix selection.

Scores of anchors against all rows are made cell by cell: a cell is a block of anchors and a block of
rows, met by a co-grouped shuffle, and scores never leave their cell. What leaves it is, for each
window of an anchor (all rows of its label, or the rows of other labels whose scores lie between two
shares of a positive's), a histogram of the leading bits of the integer scores, cut where the cell
alone has enough rows. Histograms are summed; the bucket that holds the k-th score becomes the
window's new interval, and the next round refines it by the following bits, until an interval ends
with exactly as many rows as are wanted. Rows that tie at the k-th score are told apart by further rounds
over the bits of their ids. A last pass gathers the rows above the located places: k a window at most.

A round shuffles the vectors once a block of the other side and at most k buckets a window and cell.

Defined results: rows with a null id, label, vector or component, or a component that is not finite,
take no part; of rows that share an id the one with the least (label, vector) counts; vectors of
different lengths are filled up with zeros; ties go to the smaller id; scores beyond 64 bits count as
the nearest number of 64 bits; an anchor without other rows of its label, and a positive without rows in its window,
give no row; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.base import materialize
from quillon.shipping import ship

#: Rows and anchors of a cell, about.
ROWS, ANCHORS = 512, 1024
#: Leading bits that a round tells apart.
DIGIT = 10
_TOP = 2**63 - 1

_STATE = "win bigint, same boolean, top bigint, lo bigint, hi bigint, ilo bigint, ihi bigint, need bigint, open int"
_HIST = "aid bigint, win bigint, bucket bigint, blo bigint, bhi bigint, n bigint"
_FOUND = "aid bigint, win bigint, id bigint, score bigint"


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """Components as floor(scale * x); null where a component is null or not finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


# --- a cell -----------------------------------------------------------------------------------


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = lists.combine_chunks()
    size = np.asarray(pa.compute.list_value_length(lists))
    flat = np.asarray(lists.flatten())
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in doubles where no sum can pass 2^53."""
    most = int(max(abs(int(a.min(initial=0))), int(a.max(initial=0)))) * max(abs(int(b.min(initial=0))), int(b.max(initial=0))) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -_TOP - 1, _TOP).astype(np.int64) if exact.size else np.zeros(exact.shape, np.int64)


def _cell(rows: pa.Table, anchors: pa.Table):
    """Windows of the cell as arrays, and for each its row of scores, with the rows that its labels admit."""
    width = max(int(pa.compute.max(pa.compute.list_value_length(t["v"])).as_py() or 0) for t in (rows, anchors))
    scores = _scores(_matrix(anchors["v"], width), _matrix(rows["v"], width))
    wins = anchors["wins"].combine_chunks()
    per = np.asarray(pa.compute.list_value_length(wins))
    at = np.repeat(np.arange(len(per)), per)
    w = {f.name: np.asarray(wins.flatten().field(f.name)) for f in wins.type.value_type}
    ids, label = np.asarray(rows["id"]), np.asarray(rows["label"])
    w["aid"], own = np.asarray(anchors["aid"])[at], np.asarray(anchors["label"])[at]
    fits = (label[None, :] == own[:, None]) == w["same"][:, None]
    fits &= ids[None, :] != w["aid"][:, None]
    return w, scores[at], ids, fits


def _histogram(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    kinds = [pa.int64()] * 6
    names = [x.split()[0] for x in _HIST.split(", ")]
    empty = pa.table([pa.array([], k) for k in kinds], names)
    if not rows.num_rows or not anchors.num_rows:
        return empty
    w, s, ids, fits = _cell(rows, anchors)
    by_id = w["open"] == 2
    fits &= (s >= w["lo"][:, None]) & (s <= w["hi"][:, None])
    if by_id.any():
        fits &= ~by_id[:, None] | ((ids[None, :] >= w["ilo"][:, None]) & (ids[None, :] <= w["ihi"][:, None]))
    win, row = np.nonzero(fits)
    if not len(win):
        return empty
    low, high = np.where(by_id, w["ilo"], w["lo"]), np.where(by_id, w["ihi"], w["hi"])
    shift = np.array([max(0, (int(b) - int(a)).bit_length() - DIGIT) for a, b in zip(low, high, strict=True)], np.uint64)
    u = lambda x: x.astype(np.uint64)  # differences of signed numbers, whatever their size
    away = np.where(by_id[win], u(ids[row]) - u(low[win]), u(high[win]) - u(s[win, row]))
    key, n = np.unique((u(win) << np.uint64(DIGIT)) | (away >> shift[win]), return_counts=True)
    win, bucket = (key >> np.uint64(DIGIT)).astype(np.int64), key & np.uint64((1 << DIGIT) - 1)
    upto = np.cumsum(n)
    before = upto - n
    before = before - before[np.searchsorted(win, win)]
    keep = before < w["need"][win]
    win, bucket, n = win[keep], bucket[keep], n[keep]
    step, size = (bucket << shift[win]).astype(np.int64), (np.uint64(1) << shift[win]).astype(np.int64)
    blo = np.where(by_id[win], low[win] + step, np.maximum(low[win], high[win] - step - size + 1))
    bhi = np.where(by_id[win], np.minimum(high[win], low[win] + step + size - 1), high[win] - step)
    return pa.table([pa.array(x, k) for x, k in zip((w["aid"][win], w["win"][win], bucket.astype(np.int64), blo, bhi, n), kinds, strict=True)], names)


def _gather(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    names = [x.split()[0] for x in _FOUND.split(", ")]
    if not rows.num_rows or not anchors.num_rows:
        return pa.table([pa.array([], pa.int64())] * 4, names)
    w, s, ids, fits = _cell(rows, anchors)
    lo = w["lo"][:, None]
    fits &= (s <= w["top"][:, None]) & ((s > lo) | ((s == lo) & (ids[None, :] <= w["ihi"][:, None])))
    win, row = np.nonzero(fits)
    return pa.table([pa.array(x, pa.int64()) for x in (w["aid"][win], w["win"][win], ids[row], s[win, row])], names)


# --- rounds -----------------------------------------------------------------------------------


class _Grid:
    """Rows and anchors, each with the block that it belongs to."""

    def __init__(self, rows: DataFrame, anchor: str, rows_a_cell: int, anchors_a_cell: int):
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
        self.rows = materialize(rows.select("id", "label", "v"), "vectors")
        n, self.norm, self.least, self.most = self.rows.agg(F.count("*"), F.max(norm), F.min("id"), F.max("id")).first()
        self.anchors = materialize(self.rows.filter(anchor).select(F.col("id").alias("aid"), "label", "v", norm.alias("norm")), "anchors")
        self.row_blocks, self.anchor_blocks = max(1, -(-n // rows_a_cell)), max(1, -(-self.anchors.count() // anchors_a_cell))
        ship(rows.sparkSession)

    def met(self, state: DataFrame, function, schema: str) -> DataFrame:
        """function of every cell: its rows, and its anchors with their windows."""
        names = [x.split()[0] for x in _STATE.split(", ")]
        wins = state.groupBy("aid").agg(F.collect_list(F.struct(*names)).alias("wins"))  # as many as an anchor has positives
        block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
        a = self.anchors.join(wins, "aid").select("aid", "label", "v", "wins", block("aid", self.anchor_blocks).alias("ab"), every(self.row_blocks).alias("rb"))
        r = self.rows.select("id", "label", "v", block("id", self.row_blocks).alias("rb"), every(self.anchor_blocks).alias("ab"))
        return r.groupBy("ab", "rb").cogroup(a.groupBy("ab", "rb")).applyInArrow(function, schema)

    def select(self, state: DataFrame) -> DataFrame:
        """aid, win, id, score of the `need` first rows of each window: highest score, then least id."""
        state = materialize(state.withColumns({"ilo": F.lit(self.least or 0).cast("bigint"), "ihi": F.lit(self.most or 0).cast("bigint")}), "windows")
        while not (left := state.filter("open > 0")).isEmpty():
            state = materialize(_narrowed(state, self.met(left, _histogram, _HIST)), "windows")
        return self.met(state, _gather, _FOUND)


def _narrowed(state: DataFrame, histograms: DataFrame) -> DataFrame:
    """Each open window with the bucket in which its wanted rows end as its interval."""
    upto = Window.partitionBy("aid", "win").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = histograms.groupBy("aid", "win", "bucket", "blo", "bhi").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(upto))
    hit = sums.join(state.select("aid", "win", F.col("need").alias("k")), ["aid", "win"]).filter("upto >= k AND upto - n < k").drop("bucket", "k")
    s = state.join(hit, ["aid", "win"], "left")
    score, by_id, more = F.expr("open = 1 AND n IS NOT NULL"), F.expr("open = 2 AND n IS NOT NULL"), F.expr("upto > need")
    opened = F.when(score & more & F.expr("blo < bhi"), 1).when(score & more, 2).when(by_id & more & F.expr("blo < bhi"), 2).otherwise(0)
    return s.withColumns({
        "lo": F.when(score, F.col("blo")).otherwise(F.col("lo")), "hi": F.when(score, F.col("bhi")).otherwise(F.col("hi")),
        "ilo": F.when(by_id, F.col("blo")).otherwise(F.col("ilo")), "ihi": F.when(by_id, F.col("bhi")).otherwise(F.col("ihi")),
        "need": F.when(more, F.expr("need - (upto - n)")).otherwise(F.col("need")), "open": opened,
    }).drop("n", "upto", "blo", "bhi")


def _window(same: bool, low: Column, high: Column, need: int) -> list[Column]:
    long = lambda x: F.lit(x).cast("bigint")
    return [F.lit(same).alias("same"), high.alias("top"), low.alias("lo"), high.alias("hi"), long(0).alias("ilo"), long(0).alias("ihi"), long(need).alias("need"), F.lit(1).alias("open")]


def mine(rows: DataFrame, anchor: str, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, id: str = "vec_id", label: str = "label", vector: str = "vector", rows_a_cell: int = ROWS, anchors_a_cell: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: an id, a label and a vector of integers. `anchor` is an SQL condition on `id`; an anchor's
    positives are its first rows of the same label, and a positive's negatives the first rows of other
    labels that score between `least` and `most` hundredths of its score.
    """
    sound = rows.select(F.col(id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).alias("v"))
    sound = sound.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(~F.exists("v", lambda x: x.isNull()))
    one = sound.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    grid = _Grid(one, anchor, rows_a_cell, anchors_a_cell)
    # no score passes the product of the norms
    bound = F.least(F.col("norm") * F.lit(float(grid.norm or 0.0)) * (1 + 1e-9) + 1, F.lit(9.2e18)).cast("bigint")
    bound = F.when(bound >= 9_200_000_000_000_000_000, F.lit(_TOP)).otherwise(bound)
    first = grid.anchors.select("aid", F.col("aid").alias("win"), *_window(True, -bound, bound, positives))
    found = materialize(grid.select(first).select("aid", F.col("id").alias("win"), F.col("score").alias("ps")), "positives")
    # shares of a hundred parts and the rest, so that nothing overflows
    rest = F.pmod("ps", F.lit(100))
    whole = F.expr("ps div 100 - CASE WHEN ps < 0 AND ps % 100 <> 0 THEN 1 ELSE 0 END")
    low, high = whole * least + F.ceil(rest * least / 100), whole * most + F.floor(rest * most / 100)
    windows = found.select("aid", "win", *_window(False, low, high, negatives)).filter("lo <= hi")
    got = grid.select(windows).join(found, ["aid", "win"])
    rank = F.row_number().over(Window.partitionBy("aid", "win").orderBy(F.col("score").desc(), "id"))
    return got.select(F.col("aid").alias("anchor_id"), F.col("win").alias("positive_id"), rank.alias("rank"), F.col("id").alias("negative_id"), F.col("ps").alias("positive_score"), F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), quantised(F.col("embedding")).alias("vector")), "id % 50 = 0")


OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b AS p, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p AS positive_id, row_number() OVER (PARTITION BY p.a, p ORDER BY score DESC, b)::INTEGER AS rank, b AS negative_id, ps AS positive_score, score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT same AND 50 * ps <= 100 * score AND 100 * score <= 95 * ps
QUALIFY rank <= 3
"""
