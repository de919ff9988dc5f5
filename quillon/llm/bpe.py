"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces of the corpus are counted by Spark, and merges are replayed on distinct pieces,
not on texts: the pieces of a block lie as one run of symbols, an inverted index files every adjacent
pair under the token that it makes, and the tokens' ranks come from a heap. A rank is applied to all of
its places at once; only the two pairs that touch a merged place are filed anew. A piece that gets a
pair of a lower rank than the one being applied waits with the rest of its places, and within a piece
the leftmost place goes first, so every piece ends as if it had been merged by itself.

Pieces that occur most often, `frequent` of them at most, are replayed once for the corpus, each task
taking its share of them, and reach the scan as a broadcast dictionary of that bounded size; any other piece is
replayed with those of its block where it occurs. No text is shuffled, and any corpus gives the same ids.

Defined results: a null text has the ids of an empty one, which is none; bytes that are no UTF-8 count as
U+FFFD; a very long text is taken in runs of CHUNK pieces; repeated rows and null ids are rows like others;
an empty table gives an empty one. Columns pass through; one that is named as the result is replaced.
"""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_right
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.base import blocks, map_batches, materialize, text_bytes

#: Pieces replayed for the whole corpus and broadcast, at most.
FREQUENT = 100_000
#: Bytes of the longest piece that goes into that dictionary.
LONGEST = 64
#: Pieces that a task keeps besides, and counts before it hands its counts on.
KEPT = 200_000
#: Bytes of pieces replayed under one index, unless a single piece is longer.
BLOCK = 1 << 19
#: Pieces of a text that are encoded at a time.
CHUNK = 1 << 17
#: Bytes of texts whose new pieces are replayed together, and that leave a task as one batch.
TEXTS = 1 << 22


class Vocabulary:
    """Ranks of a byte-level vocabulary: `tokens` by id, `ranks` by bytes, and what each pair of tokens makes."""

    def __init__(self, path: str):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in filter(None, f.read().splitlines()):
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.size = max(self.tokens) + 1
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.made = {self.ranks[t[:k]] * self.size + self.ranks[t[k:]]: i for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks}
        single = self.bytes.tolist()
        self.of_bytes = np.array([[self.made.get(a * self.size + b, -1) for b in single] for a in single], np.int64)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word after all merges in rank order."""
        if not words:
            return []
        ends = np.cumsum([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        first = of_pair = np.full(n, -1)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        if n:
            first = np.concatenate([[0], ends[:-1]])
            of_pair[:-1] = self.of_bytes[data[:-1], data[1:]]
            of_pair[ends[ends > 0] - 1] = after[ends[ends > 0] - 1] = -1
            before[first[first < n]] = -1
        # places of all pairs, filed under the token that they make
        order = np.argsort(of_pair, kind="stable")
        ranks, cuts = np.unique(of_pair[order], return_index=True)
        index = {r: p.tolist() for r, p in zip(ranks.tolist(), np.split(order, cuts[1:]), strict=True) if r >= 0} if n else {}
        heap = sorted(index)
        sym, rank, after, before, first = (x.tolist() for x in (self.bytes[data], of_pair, after, before, first))
        made, size = self.made.get, self.size

        def file(r: int, place: int) -> None:
            if r in index:
                index[r].append(place)
            else:
                index[r] = [place]
                heapq.heappush(heap, r)

        while heap:
            r = heapq.heappop(heap)
            waiting = -1  # a word whose next merge has a lower rank than r
            for i in sorted(index.pop(r)):
                if rank[i] != r:
                    continue  # the pair is no more
                if waiting >= 0 and bisect_right(first, i) == waiting:
                    file(r, i)
                    continue
                j, h = after[i], before[i]
                k = after[i] = after[j]
                sym[i], sym[j], rank[i], rank[j] = r, -1, -1, -1
                if k >= 0:
                    before[k] = i
                    q = rank[i] = made(r * size + sym[k], -1)
                    if q >= 0:
                        file(q, i)
                        if q < r:
                            waiting = bisect_right(first, i)
                if h >= 0:
                    q = rank[h] = made(sym[h] * size + r, -1)
                    if q >= 0:
                        file(q, h)
                        if q < r:
                            waiting = bisect_right(first, i)
        left = np.array(sym, np.int64)
        kept = left >= 0
        raw, upto = left[kept].astype("<u4").tobytes(), np.append(0, np.cumsum(kept) * 4)[ends].tolist()
        return [raw[a:b] for a, b in zip([0, *upto[:-1]], upto, strict=True)]

    def encode(self, pieces) -> dict[str, bytes]:
        """Each distinct piece with its ids, packed as little-endian unsigned 32-bit integers."""
        out, block, words, size = {}, [], [], 0
        for p in pieces:
            raw = p.encode()
            if (whole := self.ranks.get(raw)) is not None:
                out[p] = whole.to_bytes(4, "little")
                continue
            if block and size + len(raw) > BLOCK:
                out.update(zip(block, self.replay(words), strict=True))
                block, words, size = [], [], 0
            block.append(p)
            words.append(raw)
            size += len(raw)
        out.update(zip(block, self.replay(words), strict=True))
        return out


def _texts(column: pa.Array):
    for raw in column.cast(pa.binary()):
        yield (raw.as_py() or b"").decode("utf-8", "replace")


def default_vocabulary() -> tuple[str, str]:
    """Path and pattern of the vocabulary for many languages."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def frequent_pieces(docs: DataFrame, text: str = "text", pattern: str | None = None, most: int = FREQUENT) -> DataFrame:
    """piece and n of the pieces that occur so often that no more than `most` do: counts of 2^k and more for the least such k.

    A task hands its counts on after every KEPT distinct pieces, without those that it met only once
    among them, so n may be too low; the choice of pieces has no influence on any ids.
    """
    pattern = pattern or default_vocabulary()[1]

    def count(batches):
        import regex

        find = regex.compile(pattern)
        seen: Counter[str] = Counter()

        def rows():
            often = [(p, n) for p, n in seen.items() if n > 1]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], ["piece", "n"])

        for batch in batches:
            for t in _texts(batch.column(0)):
                if len(t) < CHUNK:
                    seen.update(find.findall(t))
                else:
                    seen.update(m.group() for m in find.finditer(t))
                if len(seen) > KEPT:
                    yield rows()
                    seen.clear()
        yield rows()

    counts = map_batches(docs.select(text), count, "piece string, n bigint").filter(F.octet_length("piece") <= LONGEST)
    counts = materialize(counts.groupBy("piece").agg(F.sum("n").alias("n")), "pieces")
    power = F.floor(F.log2("n")).cast("int")
    left, least = most, 64
    for k, size in sorted(counts.groupBy(power.alias("k")).count().collect(), reverse=True):  # 63 rows at most
        left -= size
        if left < 0:
            break
        least = k
    return counts.filter(power >= least)


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, pattern: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """docs with the token ids of each text, packed in a binary column as little-endian unsigned 32-bit integers."""
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(Vocabulary(path))

    def replayed(batches):
        for batch in batches:
            got = shared.value.encode(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.binary())], ["piece", "ids"])

    known: dict[str, bytes] = {}
    if frequent:
        words = map_batches(frequent_pieces(docs, text, pattern, frequent).select("piece"), replayed, "piece string, ids binary").toArrow()
        known = dict(zip(words["piece"].to_pylist(), words["ids"].to_pylist(), strict=True))
    common = sc.broadcast(known)
    columns = [c for c in docs.columns if c != ids]
    at = columns.index(text)

    def encoded(batches):
        import regex

        find, vocabulary = regex.compile(pattern), shared.value
        table = dict(common.value)

        def learn(pieces) -> None:
            if len(table) > len(common.value) + KEPT:
                table.clear()
                table.update(common.value)
            table.update(vocabulary.encode(pieces - table.keys()))

        def take(block: list[list[str]]) -> list[bytes]:
            learn(set().union(*block))
            return [b"".join(map(table.__getitem__, p)) for p in block]

        def long(t: str) -> bytes:
            found = (m.group() for m in find.finditer(t))
            return b"".join(x for run in iter(lambda: list(islice(found, CHUNK)), []) for x in take([run]))

        for batch in batches:
            _, off = text_bytes(batch.column(at))
            for a, b in blocks(off, TEXTS):
                texts = list(_texts(batch.column(at).slice(a, b - a)))
                packed = take([find.findall(t) for t in texts]) if off[b] - off[a] <= TEXTS else [long(t) for t in texts]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(packed, pa.binary())], [*columns, ids])

    rows = docs.select(*[F.col(f"`{c}`") for c in columns])
    return map_batches(rows, encoded, rows.withColumn(ids, F.lit(b"")).schema)


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """rows with the bytes that the packed ids stand for; null ids give none, an id that the vocabulary lacks is an error."""
    vocabulary = Vocabulary(path or default_vocabulary()[0])
    shared = rows.sparkSession.sparkContext.broadcast((vocabulary.size, vocabulary.tokens))  # ranks and pairs stay out of the workers
    columns = [c for c in rows.columns if c != out]
    at = columns.index(ids)

    def decoded(batches):
        size, known = shared.value
        tokens = np.full(size, None, object)
        for i, t in known.items():
            tokens[i] = t
        for batch in batches:
            _, off = text_bytes(batch.column(at))
            for a, b in blocks(off, TEXTS):
                part = batch.slice(a, b - a)
                texts = [b"".join(tokens[np.frombuffer(x.as_py() or b"", "<u4")]) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*columns, out])

    kept = rows.select(*[F.col(f"`{c}`") for c in columns])
    return map_batches(kept, decoded, kept.withColumn(out, F.lit(b"")).schema)


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def op13_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = decode(encode(docs).select("doc_id", "ids"))
    return done.select("doc_id", n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
