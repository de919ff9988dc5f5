"""Helpers the training-data operators share: scratch tables, checked joins, batch tokenisation."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.shipping import ship
from quillon.sources.files import made, release

__all__ = ["made", "release"]

#: A side of a join is broadcast only if it was counted and has no more rows than this.
BROADCAST_ROWS = 400_000
#: The white space that separates words: \x20 and \x09-\x0D.
SPACE_SQL = r"[\x20\x09-\x0D]+"
WORD_SQL = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where that is unset."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
    return sc.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow by a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def maybe_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if df, counted, is within the limit; else leave the join to shuffles and AQE."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def words_of(text: Column) -> Column:
    """Words as an array, empty for null and blank texts."""
    parts = F.split(text, SPACE_SQL)
    return F.coalesce(F.filter(parts, lambda w: w != ""), F.array().cast("array<string>"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


# --- bytes of Arrow batches -------------------------------------------------------------------

_SEED = np.random.default_rng(20240917)
_TABLE = _SEED.integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 2**64))
_pow: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow["p"]) < n:
        size = max(n + (n >> 2), 1 << 16)
        for key, base in (("p", _P), ("i", _PINV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _pow[key] = np.multiply.accumulate(a)
    return _pow["p"][:n], _pow["i"][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string or binary column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, most: int = 1 << 18):
    """Runs [a, b) of documents with about `most` bytes, one document at least: bounds memory."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(data: np.ndarray, off: np.ndarray, apart: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of whole documents, and the number of words of each document; `apart` are the bytes between words."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    w = ~apart[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = w.copy()
    first[1:] &= ~w[:-1] | edge[1:-1]
    last = w.copy()
    last[:-1] &= ~w[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span, through prefix sums of a polynomial over random letters."""
    p, inv = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _TABLE)[data] * p[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


_COEF = np.random.default_rng(77).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int, lower: bool = True) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its k-word shingles; fewer words count as one shingle."""
    starts, ends, counts = word_spans(data, off)
    h = span_hashes(data, starts, ends, lower)
    n = len(h)
    full = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        full += h[j : n - k + 1 + j] * _COEF[j]
    full = mix64(full)
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            s = np.sort(full[at : at + c - k + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            out.append(s[keep])
        elif c:
            out.append(mix64(np.array([(h[at : at + c] * _COEF[:c]).sum() + np.uint64(c)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out
