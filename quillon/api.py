"""The engine's commands as functions: each composes operators into one pipeline.

Gates raise `GateFailed`, the counterpart of a command that exits with an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import projects as P
from quillon.operators import records as C
from quillon.operators import relations as R
from quillon.operators import retrieval as S
from quillon.operators.ranking import top_documents
from quillon.sources import files as FS


class GateFailed(RuntimeError):
    """A check that must hold doesn't."""


# --- data ---


def audit(documents: DataFrame, key: str, required: list[str]) -> DataFrame:
    """issue, n: repeated keys, and missing values of the required columns."""
    twice = documents.groupBy(key).agg(F.count("*").alias("c")).filter("c > 1").agg(F.lit("repeated_key").alias("issue"), F.count("*").alias("n"))
    gaps = documents.agg(*[F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in required])
    missing = gaps.select(F.explode(F.map_from_arrays(F.array(*[F.lit(f"missing:{c}") for c in required]), F.array(*required))).alias("issue", "n"))
    return twice.union(missing).filter("n > 0")


def require_clean(report: DataFrame) -> None:
    bad = report.limit(5).collect()
    if bad:
        raise GateFailed("; ".join(f"{r.issue}: {r.n}" for r in bad))


#: Splits that a table may have, and rows of a report: both come to the driver.
MOST_NAMES = 1000


def build_splits(documents: DataFrame, key: str, steps: list[tuple[str, int, list[str], Column]], rest: str = "train") -> DataFrame:
    """documents with split: balanced choices (name, quota, strata, condition) one after another, the rest at the end."""
    d = reduce(lambda df, s: C.carve(df, key, s[2], s[1], s[0], s[0], s[3]), steps, documents.withColumn("split", F.lit(None).cast("string")))
    return d.withColumn("split", F.coalesce("split", F.lit(rest)))


def validate_splits(splits: DataFrame, whole: DataFrame, key: str) -> None:
    names = [r.split for r in splits.select("split").distinct().limit(MOST_NAMES + 1).collect()]
    if len(names) > MOST_NAMES:
        raise GateFailed(f"more than {MOST_NAMES} splits")
    require_clean(R.set_report({n: splits.filter(F.col("split") == n) for n in names}, whole, key))


def write_splits(splits: DataFrame, path: str) -> None:
    """One folder a split, so that reading one prunes the others."""
    splits.write.mode("overwrite").partitionBy("split").parquet(path)


# --- search ---


def run_baseline(documents: DataFrame, queries: DataFrame, relevance: DataFrame, most: int = 50) -> DataFrame:
    """Ranking metrics of BM25 over texts: documents (doc_id, text), queries (query_id, text), relevance (query_id, doc_id)."""
    d = documents.select("doc_id", T.tokenize(F.col("text")).alias("tokens"))
    q = queries.select("query_id", T.tokenize(F.col("text")).alias("tokens"))
    rel = relevance.select("query_id", "doc_id").distinct().withColumn("rel", F.lit(1))
    total = rel.groupBy("query_id").agg(F.count("*").alias("total"))
    top = top_documents(d, q, most).join(rel, ["query_id", "doc_id"], "left")
    top = top.join(total, "query_id", "left").na.fill({"rel": 0, "total": 0})
    return S.ranking_metrics(top, "rel", "total")


def compare_predictions(baseline: DataFrame, other: DataFrame, key: str, score: str) -> DataFrame:
    """Mean difference, wins, losses and ties of two results of the same keys."""
    j = R.strict_join(baseline.select(key, F.col(score).alias("a")), other.select(key, F.col(score).alias("b")), key)
    d = F.col("b") - F.col("a")
    return j.agg(F.avg(d).alias("mean_delta"), F.count_if(d > 1e-9).alias("wins"), F.count_if(d < -1e-9).alias("losses"), F.count_if(F.abs(d) <= 1e-9).alias("ties"))


# --- records ---


def ingest(requests: DataFrame, responses: DataFrame, key: str, required: list[str], optional: list[str], lists: list[str], partial: bool = False) -> DataFrame:
    """key, record, events of raw JSON responses (key, raw); all requests need one unless `partial`."""
    j = requests.select(key).join(responses.select(key, "raw"), key) if partial else R.strict_join(requests.select(key), responses.select(key, "raw"), key)
    body = F.regexp_extract("raw", r"(?s)\{.*\}", 0)
    record, events = P.coerce(body, required, optional, lists)
    return j.select(key, record.alias("record"), events.alias("events"))


def repair(records: DataFrame, work: str = "work") -> DataFrame:
    """Work records repaired and merged, taken where more of them are complete."""
    better = C.merge_work(F.transform(work, lambda r: C.repair_work(r)["record"]))
    return records.withColumn(work, F.when(C.accept(F.col(work), better), better).otherwise(F.col(work)))


def evaluate(fields: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """Document and corpus scores of long field results (doc, field, score, supported)."""
    documents = C.field_scores(fields, doc)
    return documents, C.corpus_scores(documents)


# --- runs ---


class RunStore:
    """Tables of runs and their samples in a folder, each version written beside the last and then put in its place."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str, version: int) -> str:
        return f"{self.path}/{name}/version={version}"

    def _version(self, name: str) -> int:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return 0
        done = [s.getPath() for s in fs.listStatus(p) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((int(d.getName().partition("=")[2]) for d in done), default=0)

    def read(self, name: str) -> DataFrame:
        """The last version that was written to its end."""
        return self.spark.read.parquet(self._folder(name, self._version(name)))

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        v = self._version(name)
        out = R.upsert(self.read(name), rows, keys) if v else rows
        out.write.mode("overwrite").parquet(self._folder(name, v + 1))
        return self.read(name)

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        v = self._version(name)
        out = self.read(name).unionByName(rows) if v else rows
        out.write.mode("overwrite").parquet(self._folder(name, v + 1))
        return self.read(name)

    def guard(self, config: Column) -> str:
        """The digest of a configuration, kept at the first call; a different one later raises."""
        now = self.spark.range(1).select(config.alias("digest"))
        digest = now.first().digest
        if not self._version("config"):
            self.append("config", now)
        elif self.read("config").first().digest != digest:
            raise GateFailed("the run was begun under another configuration")
        return digest


def report(rows: DataFrame, best: list[str]) -> str:
    """A table in markdown of a result of at most MOST_NAMES rows; more of them raise."""
    found = rows.limit(MOST_NAMES + 1).collect()
    if len(found) > MOST_NAMES:
        raise GateFailed(f"a report of more than {MOST_NAMES} rows")
    return FS.markdown([r.asDict() for r in found], best)
