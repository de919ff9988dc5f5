"""Readers and writers for files of records."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Scratch folders of this application, in the order in which they were made.
made: list[str] = []


class LockedSplit(PermissionError):
    """A locked part of the corpus was asked for without confirmation."""


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see; a temporary one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    path = f"{root.rstrip('/')}/quillon-{name}-{uuid.uuid4().hex}"
    made.append(path)
    return path


def release(spark: SparkSession, keep: int = 0, since: int = 0) -> int:
    """Delete the scratch folders made so far but the first `since` and the last `keep`; call it once results that read them have been written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    old = made[since : len(made) - keep]
    del made[since : since + len(old)]
    n = 0
    for path in old:
        p = jvm.org.apache.hadoop.fs.Path(path)
        n += bool(p.getFileSystem(conf).delete(p, True))
    return n


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict JSON lines: blank lines are skipped, anything else that is no object fails the read."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    checked = F.when(F.col("value").rlike(r"^\s*\{"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not an object: "), F.substring("value", 1, 80))))
    return lines.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without the malformed ones."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_required(spark: SparkSession, paths: list[str] | str, required: list[str], schema: str) -> DataFrame:
    """Rows of JSON lines files whose objects have all the required keys, null values included."""
    lines = spark.read.text(paths).filter(F.trim("value") != "")
    has = F.json_object_keys("value")
    keep = F.size(F.array_except(F.array(*[F.lit(k) for k in required]), has)) == 0
    return lines.filter(keep).select(F.from_json("value", schema).alias("r")).select("r.*")


def read_csv_union(spark: SparkSession, paths: list[str], required: list[str]) -> DataFrame:
    """The required columns of those CSV files whose header has them all, in one table."""
    out = None
    for path in paths:
        df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
        if set(required) <= set(df.columns):
            part = df.select(*required)
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no file has the columns {required}")
    return out


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """number, item of the lines of a numbered list."""
    line = r"^\s*(\d+)[.)]\s+(.*\S)\s*$"
    return spark.read.text(path).filter(F.col("value").rlike(line)).select(F.regexp_extract("value", line, 1).cast("int").alias("number"), F.regexp_extract("value", line, 2).alias("item"))


def read_tree(spark: SparkSession, root: str, key: str = r"([^/.]+)\.[^/]*$", content: bool = True) -> DataFrame:
    """path, key, kind, size and sha256 of every file below a folder; the bytes are read only for the digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    digest = F.sha2("content", 256) if content else F.lit(None).cast("string")
    return files.select("path", F.regexp_extract("path", key, 1).alias("key"), F.regexp_extract("path", r"\.([^./]+)$", 1).alias("kind"), F.col("length").alias("size"), digest.alias("sha256"))


def pages_by_key(files: DataFrame) -> DataFrame:
    """key and the sorted paths of its files."""
    return files.groupBy("key").agg(F.sort_array(F.collect_list("path")).alias("paths"), F.count("*").alias("files"))


def read_fresh(spark: SparkSession, path: str, seconds: int) -> DataFrame:
    """Rows of files that were written within the last seconds."""
    df = spark.read.json(path).select("*", F.col("_metadata.file_modification_time").alias("__t"))
    return df.filter(F.col("__t") > F.current_timestamp() - F.make_dt_interval(secs=F.lit(seconds))).drop("__t")


def guarded(read, split: str, confirmed: bool = False) -> DataFrame:
    """read() unless the split is locked and nobody confirmed."""
    if "locked" in split and not confirmed:
        raise LockedSplit(split)
    return read()


def fallback_text(first: Column, second: Column) -> Column:
    """The first text unless it is blank, then the second; an error where both are."""
    a, b = F.nullif(F.trim(first), F.lit("")), F.nullif(F.trim(second), F.lit(""))
    return F.coalesce(a, b, F.raise_error(F.lit("no text in either representation")).cast("string"))


def write_parts(df: DataFrame, path: str, parts: int, mode: str = "overwrite") -> None:
    """JSON lines in `parts` files, dealt in turn."""
    df.repartition(parts).write.mode(mode).json(path)


#: Bytes of parts that are merged into one file.
MERGED_BYTES = 1 << 27


def merge_parts(rows: DataFrame, parts: str, path: str, most: int = MERGED_BYTES) -> int:
    """JSON lines of the rows read from `parts`, in as few files as hold `most` bytes of parts each, so that no task reads much more; returns their number."""
    spark = rows.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(parts)
    n = max(1, -(-p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength() // most))
    rows.coalesce(n).write.json(path)
    return n


def append(df: DataFrame, path: str, kind: str = "json") -> None:
    df.write.mode("append").format(kind).save(path)


def markdown(rows: list[dict], best: list[str]) -> str:
    """A table of a report's few rows; the best value of each column in `best` is bold."""
    if not rows:
        return ""
    names = list(rows[0])
    top = {c: max((r[c] for r in rows if r[c] is not None), default=None) for c in best}
    cell = lambda c, v: "" if v is None else f"**{v:.4f}**" if c in top and abs(v - top[c]) < 1e-9 else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(cell(c, r[c]) for c in names) + " |" for r in rows])
