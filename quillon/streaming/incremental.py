"""Incremental runs: resumable batches, and file streams run to their end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.relations import pending
from quillon.sources.files import shared_folder


def resume(work: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows of work that path doesn't hold yet; the rows appended."""
    spark = work.sparkSession
    try:
        done = spark.read.parquet(path)
    except Exception as e:  # the first run finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rest = work
    else:
        rest = pending(work, done, keys)
    rest.write.mode("append").parquet(path)
    return rest


def with_status(rows: DataFrame, ok: Column, reason: str = "failed") -> DataFrame:
    return rows.withColumn("status", F.when(ok, "completed").otherwise(reason))


def run_to_end(stream: DataFrame, out: str, mode: str = "append") -> None:
    """Process all that is there in micro-batches, with a checkpoint beside the output, and stop."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out)
    q.awaitTermination()


def staged(spark: SparkSession, rows: DataFrame, parts: int = 4) -> DataFrame:
    """A stream over the rows, written as files, a few files a micro-batch."""
    path = shared_folder(spark, "stream")
    rows.repartition(parts).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


def deduplicated(spark: SparkSession, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key over all micro-batches; state is kept for every key, as history asks for."""
    out = shared_folder(spark, "first")
    run_to_end(staged(spark, rows).dropDuplicates(keys), out)
    return spark.read.schema(rows.schema).parquet(out)


def daily_totals(spark: SparkSession, rows: DataFrame, lateness: str = "30 days") -> DataFrame:
    """day, event_type, n, total: each micro-batch's sums are upserted by addition."""
    out = shared_folder(spark, "daily")

    def add(batch: DataFrame, number: int) -> None:
        part = batch.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        # the batch number makes a repeated batch overwrite itself
        part.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = staged(spark, rows.withColumn("ts", F.col("ts").cast("timestamp"))).withWatermark("ts", lateness)
    q = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    back = spark.read.parquet(out)
    return back.groupBy(F.col("day").cast("timestamp_ntz").alias("day"), "event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))
