"""Sends this package to the executors, which may have no copy of it."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def _zipped(top: Path) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    return out.getvalue()


def ship(spark: SparkSession | None = None) -> None:
    """Once an application, before its first function that runs in Python workers.

    The archive lies in the shared folder of spark.checkpoint.dir, written through Spark's own
    file systems; in a temporary folder only where that setting is absent.
    """
    spark = spark or SparkSession.active()
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        folder = f"{root.rstrip('/')}/{top.name}-package-{uuid.uuid4().hex}"
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/{top.name}.zip")
        stream = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
        stream.write(_zipped(top))
        stream.close()
        sc.addPyFile(path.toString())
    else:
        local = Path(tempfile.mkdtemp(prefix=f"{top.name}-")) / f"{top.name}.zip"
        local.write_bytes(_zipped(top))
        sc.addPyFile(str(local))
    _shipped.add(sc.applicationId)
