"""MinHash near-duplicate detection by min-max hashing.

Every permutation gives two values of a document's shingle set, its minimum and its maximum, so
the signature costs half the hash evaluations. Bands of ROWS values bring likely pairs together.
Equal sets are one class from the start, represented by the smallest id, so thousands of copies
cost one row.

No step lists the pairs of a bucket, and no task takes more than some BLOCK members of one. A task
joins members whose signatures agree in nearly the required share (less SIGMAS standard errors) to
trees, found breadth first; the trees of all buckets make groups. In the same way the full sets of
a group's texts are compared, and n - 1 exact links are kept for each component of n.

A larger bucket or group is settled in rounds (`settled_labels`), each of which costs its members
a few rows: its members are dealt into blocks, and PIVOTS of them, drawn by hash, stand in every
block. If they aren't all connected by then, the members with the most links are the next pivots;
then, in buckets, the members meet again under pairs of bands (documents with the required similarity share
two bands and more). Only what is still apart is compared in full: every member outside the
largest component of its key with all members of the key, block by block.

With BANDS = 32 bands of ROWS = 5 values, a pair of similarity 0.85 shares no band with a
probability of 7e-9 (0.8: 3e-6), and fewer than two with 2e-7 (0.8: 5e-5).

Defined results: null or blank texts have an empty set, link with nothing and stay; a text with
fewer words than a shingle has one shingle; a null id links with nothing, has a null component
and stays; rows with the same id are one document, linked through its texts, and are all returned;
an empty table gives an empty result. Extra columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.base import BROADCAST_ROWS, blocks, map_batches, materialize, mix64, shingle_sets, text_bytes
from quillon.llm.components import components

BANDS = 32
ROWS = 5
#: Standard errors by which a signature may fall short of the required share.
SIGMAS = 5
#: Members of a bucket or group that one task takes, besides the pivots.
BLOCK = 256
#: Members of a larger bucket or group that stand in every block.
PIVOTS = 8
#: Copies of the row of a class that its documents are spread over.
SALTS = 16

_rng = np.random.default_rng(424242)
_A = _rng.integers(1, 2**63, BANDS * ROWS // 2, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(1, 2**63, BANDS * ROWS // 2, dtype=np.uint64)
_C = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum and maximum of a set under every permutation, set by set of 4096 elements."""
    low, high = np.full(len(_A), 2**64 - 1, np.uint64), np.zeros(len(_A), np.uint64)
    for i in range(0, len(s), 4096):
        v = s[None, i : i + 4096] * _A[:, None]
        v ^= v >> np.uint64(29)
        v *= _B[:, None] | np.uint64(1)
        np.minimum(low, v.min(1), out=low)
        np.maximum(high, v.max(1), out=high)
    return np.concatenate([low, high])


def bands(sig: np.ndarray) -> np.ndarray:
    """Hashes of the bands, the band's number included."""
    # values are dealt so that a band holds minima and maxima of different permutations
    rows = sig.reshape(ROWS, BANDS).T
    return mix64((rows * _C).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _signed(batches, k: int):
    for batch in batches:
        ids, (data, off) = batch.column(0), text_bytes(batch.column(1))
        for a, b in blocks(off):
            sets = shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], k)
            n = np.array([len(s) for s in sets], np.int64)
            d = np.zeros((2, b - a), np.uint64)
            keys, sig = np.zeros((b - a, BANDS), np.uint64), np.zeros((b - a, BANDS * ROWS), np.uint8)
            for i, s in enumerate(sets):
                if len(s):
                    d[0, i], d[1, i] = mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0x5555555555555555)).sum(dtype=np.uint64)
                    v = signature(s)
                    keys[i], sig[i] = bands(v), v & np.uint64(255)
            lists = pa.ListArray.from_arrays(np.arange(0, (b - a + 1) * BANDS, BANDS, dtype=np.int32), keys.reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), lists, pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "n", "d1", "d2", "keys", "sig"])


def _runs(batches, keys: int):
    """Tables of the rows that agree in the first `keys` columns, from rows in that order."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(i).to_numpy() for i in range(keys)], 1)
        edges = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, [len(k)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if held and (k[a] != last).any():
                yield pa.Table.from_batches(held)
                held.clear()
            held.append(batch.slice(a, b - a))
            last = k[a]
    if held:
        yield pa.Table.from_batches(held)


def _forest(n: int, near, width: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of 0..n-1, found breadth first; near(some, rest): which of rest each of some is joined to."""
    rest, edges = np.arange(n), []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            part, front = front[:width], front[width:]
            hit = near(part, rest)
            got = hit.any(0)
            if got.any():
                edges += zip(part[hit[:, got].argmax(0)].tolist(), rest[got].tolist(), strict=True)
                front, rest = np.concatenate([front, rest[got]]), rest[~got]
    return edges


def _stars(ids: np.ndarray, edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each tree as links of all its members with the one of the least id: buckets that hold the same members then give the same links."""
    trees = {}
    for i, j in edges:  # breadth first: i is in a tree already, or begins one
        trees.setdefault(i, [i]).append(j)
        trees[j] = trees[i]
    out = []
    for tree in {id(t): t for t in trees.values()}.values():
        root = min(tree, key=lambda k: ids[k])
        out += [(root, j) for j in tree if j != root]
    return out


def _edges(found: list[tuple[np.ndarray, list[tuple[int, int]]]]) -> pa.RecordBatch:
    a = [ids[i] for ids, edges in found for i, _ in edges]
    b = [ids[j] for ids, edges in found for _, j in edges]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _screened(batches, percent: int):
    """Rows (key, x, y, id, n, sig) in order of the first three: a forest over the alike signatures of each."""
    p = percent / 100
    least = BANDS * ROWS * p - SIGMAS * (BANDS * ROWS * p * (1 - p)) ** 0.5
    for rows in _runs(batches, 3):
        ids, n = rows.column(3).to_numpy(), rows.column(4).to_numpy()
        sig = np.frombuffer(b"".join(rows.column(5).to_pylist()), np.uint8).reshape(len(ids), -1)

        def near(x, y, n=n, sig=sig):
            hit = 100 * np.minimum(n[x, None], n[None, y]) >= percent * np.maximum(n[x, None], n[None, y])
            for i in range(len(x)):
                at = np.flatnonzero(hit[i])
                hit[i, at] = (sig[y[at]] == sig[x[i]]).sum(1) >= least
            return hit

        yield _edges([(ids, _stars(ids, _forest(len(ids), near, 16)))])


def _confirmed(batches, k: int, percent: int):
    """Rows (key, x, y, id, text) in order of the first three: a forest over the similar full sets."""
    for rows in _runs(batches, 3):
        ids = rows.column(3).to_numpy()
        data, off = text_bytes(rows.column(4))
        sets = []
        for a, b in blocks(off):
            sets += shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], k)
        n = np.array([len(s) for s in sets])
        if len(ids) == 2:
            yield _edges([(ids, [(0, 1)] if similar(sets[0], sets[1], percent) else [])])
            continue
        # who has each shingle
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]

        def near(x, y, n=n, sets=sets, flat=flat, owner=owner):
            hit = np.zeros((len(x), len(y)), bool)
            for i, d in enumerate(x.tolist()):
                lo, hi = np.searchsorted(flat, sets[d], "left"), np.searchsorted(flat, sets[d], "right")
                c = hi - lo
                at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo, c)
                both = np.bincount(owner[at], minlength=len(n))[y]
                hit[i] = (both > 0) & (100 * both >= percent * (n[d] + n[y] - both))
            return hit

        yield _edges([(ids, _forest(len(ids), near, 1))])


def similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets, neither of them empty."""
    if not len(s) or not len(t) or 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, id, c, label, most, u: the members of keys whose members have several labels; most: the label of most of them, u: members with another."""
    m = members.join(labels, F.col("id") == F.col("node"), "left").select("key", "id", "c", F.coalesce("label", "id").alias("label"))
    m = materialize(m, "state")
    per = m.groupBy("key", "label").agg(F.count("*").alias("k"))
    most = per.groupBy("key").agg(F.max(F.struct("k", "label")).alias("m"), F.count("*").alias("labels")).filter("labels > 1").select("key", F.col("m.label").alias("most"), F.col("m.k").alias("k"))
    n = most.count()
    return materialize(m.join(F.broadcast(most) if n <= BROADCAST_ROWS else most, "key").select("key", "id", "c", "label", "most", (F.col("c") - F.col("k")).alias("u")), "apart")


def _parts(of: str) -> Column:
    """Blocks for `of` members, a power of two: keys of about one size deal their members alike and find mostly the same links."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col(of) / BLOCK, F.lit(1.0))))).cast("long")


def _part(of: str, seed: int) -> Column:
    """The block of a member, of as many as `of` members fill."""
    return F.pmod(F.xxhash64("id", F.lit(seed)), _parts(of))


def _dealt(members: DataFrame, pivots: DataFrame | None, seed: int) -> DataFrame:
    """key, x, y, id: members (key, id, c) in blocks, pivots (key, id, c) in every block of their key."""
    own = members.select("key", _part("c", seed).alias("x"), F.lit(0).cast("long").alias("y"), "id")
    if pivots is None:
        return own
    every = pivots.select("key", _part("c", seed).alias("home"), F.explode(F.sequence(F.lit(0).cast("long"), _parts("c") - 1)).alias("x"), F.lit(0).cast("long").alias("y"), "id")
    return own.union(every.filter("x <> home").drop("home"))  # a pivot stands in its own block anyway


def _crossed(apart: DataFrame) -> DataFrame:
    """key, x, y, id: every block of the members outside the largest component meets every block of the key."""
    upto = lambda of: F.sequence(F.lit(0).cast("long"), _parts(of) - 1)
    outside = apart.filter("label <> most").select("key", _part("u", 11).alias("x"), F.explode(upto("c")).alias("y"), "id")
    inside = apart.select("key", F.explode(upto("u")).alias("x"), _part("c", 12).alias("y"), "id")
    return outside.union(inside).distinct()


def settled_labels(members: DataFrame, compare, split=None, more: DataFrame | None = None) -> DataFrame:
    """node, label: the components of the links within keys, for members (key, id).

    compare: rows (key, x, y, id) to links (a, b) within each (key, x, y); split: members of unsettled
    keys to members of finer keys; more: further links.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    rows = materialize(members.join(sizes, "key").select("key", "id", "c"), "members")
    big = rows.filter(F.col("c") > BLOCK)
    few = big.isEmpty()
    slot = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(PIVOTS))
    pivots = None if few else big.groupBy("key", "c", slot.alias("slot")).agg(F.min_by("id", F.xxhash64("id", F.lit(6))).alias("id")).select("key", "id", "c")
    links = materialize(compare(_dealt(rows, pivots, 7)), "links")
    links = links if more is None else links.union(more)
    labels = components(links)
    if few:
        return labels
    apart = _apart(big, labels)
    if apart.filter(F.col("u") > BLOCK).isEmpty():
        if apart.isEmpty():
            return labels
    else:
        # members with many links hold a group together better than members drawn by hash
        degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
        hubs = apart.filter(F.col("u") > BLOCK).join(degree, "id").groupBy("key", "c", slot.alias("slot")).agg(F.max_by("id", F.struct("d", "id")).alias("id")).select("key", "id", "c")
        found = materialize(compare(_dealt(apart.filter(F.col("u") > BLOCK).select("key", "id", "c"), hubs, 8)), "links")
        links = _as_links(labels).union(found)
        labels = components(links)
        apart = _apart(apart.select("key", "id", "c"), labels)
        wide = apart.filter(F.col("u") > BLOCK)
        if split is not None and not wide.isEmpty():
            labels = settled_labels(split(wide), compare, more=_as_links(labels))
            # what meets under no finer key has no link
            apart = apart.filter(F.col("u") <= BLOCK)
        if apart.isEmpty():
            return labels
    return components(_as_links(labels).union(materialize(compare(_crossed(apart)), "links")))


def _as_links(labels: DataFrame) -> DataFrame:
    """The components found so far as links: one a node, whatever number of links they come from."""
    return labels.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))


def _groups(reps: DataFrame, percent: int) -> DataFrame:
    """node, label: the groups of likely links among reps (id, n, keys, sig)."""
    signed = reps.select("id", "n", "sig")

    def compare(dealt: DataFrame) -> DataFrame:
        full = dealt.join(signed, "id").select("key", "x", "y", "id", "n", "sig")
        return map_batches(full.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "id"), lambda it: _screened(it, percent), "a bigint, b bigint")

    def split(wide: DataFrame) -> DataFrame:
        again = wide.select("key", "id").join(reps.select("id", "keys"), "id").select("id", "key", F.explode("keys").alias("second")).filter(F.col("second") != F.col("key"))
        return again.select(F.xxhash64(F.least("key", "second"), F.greatest("key", "second")).alias("key"), "id").distinct()

    return settled_labels(reps.select(F.explode("keys").alias("key"), "id"), compare, split)


def _joined(texts: DataFrame, groups: DataFrame, shared: DataFrame, k: int, percent: int) -> DataFrame:
    """node, label: the components of the exactly similar texts (id, text) of each group, and of the links `shared`."""

    def compare(dealt: DataFrame) -> DataFrame:
        dealt = materialize(dealt, "dealt")
        few = F.broadcast if dealt.count() <= BROADCAST_ROWS else (lambda x: x)
        rows = texts.join(few(dealt), "id").select("key", "x", "y", "id", "text").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "id")
        return map_batches(rows, lambda it: _confirmed(it, k, percent), "a bigint, b bigint")

    return settled_labels(groups.select(F.col("label").alias("key"), F.col("node").alias("id")), compare, more=shared)


def near_classes(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; similarity in percent, on k-word shingles."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = materialize(map_batches(base, lambda it: _signed(it, k), "doc_id bigint, n bigint, d1 bigint, d2 bigint, keys array<bigint>, sig binary"), "signed")
    full = signed.filter("doc_id IS NOT NULL AND n > 0")
    same = ["n", "d1", "d2"]
    classes = materialize(full.groupBy(*same).agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "classes")
    # the id is part of the key, so that no key gathers the copies of a class; an id may stand for several classes
    mine = classes.select(*same, F.col("id").alias("doc_id"))
    n = classes.count()
    reps = full.join(F.broadcast(mine) if n <= BROADCAST_ROWS // 4 else mine, [*same, "doc_id"], "left_semi").dropDuplicates(["doc_id", *same])
    reps = materialize(reps.select(F.col("doc_id").alias("id"), "n", "keys", "sig"), "reps")
    # an id with several texts stands in several classes and links them
    many = full.select("doc_id", *same).distinct().groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id")
    shared = full.join(many, "doc_id", "left_semi").select("doc_id", *same).distinct().join(classes, same).filter("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    texts = base.select(F.col("doc_id").alias("id"), "text")
    comp = _joined(texts, _groups(reps, percent), materialize(shared, "shared"), k, percent)
    # only a class with copies or links has a component that its documents don't know
    labels = classes.join(comp, F.col("id") == F.col("node"), "left").filter("copies > 1 OR label IS NOT NULL").select(*same, F.coalesce("label", "id").alias("component"))
    labels = materialize(labels, "labels")
    rows = signed.select("doc_id", *same)
    if labels.count() <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(labels), same, "left")
    else:
        salted = labels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        # texts without words have no class to meet
        salt = F.when(F.col("n") > 0, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(-1 - F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))).cast("int")
        out = rows.withColumn("salt", salt).join(salted, [*same, "salt"], "left")
    found = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(found == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but the smallest id of each component."""
    gone = materialize(near_classes(docs, k, percent, doc_id, text).filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    n = gone.count()
    return docs.join(F.broadcast(gone) if n <= BROADCAST_ROWS else gone, F.col(doc_id) == F.col("__gone"), "left_anti")


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_classes(docs, k=3, percent=85)
