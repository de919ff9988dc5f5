"""Places for user functions: batches in and out, external callers with retries, table functions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.shipping import ship


def map_batched(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function of whole batches, each an Arrow batch of a partition."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield function(b)

    return df.mapInPandas(run, schema)


def with_retries(call: Callable, tries: int = 3, wait: float = 0.0) -> Callable:
    """call, tried again on errors; the last error comes back as text beside a missing result."""

    def tried(x):
        error = None
        for n in range(tries):
            try:
                return call(x), None
            except Exception as e:  # an external service may fail in any way
                error = f"{type(e).__name__}: {e}"
                time.sleep(wait * 2**n)
        return None, error

    return tried


def call_external(df: DataFrame, key: str, prompt: str, call: Callable[[str], str], tries: int = 3) -> DataFrame:
    """key, answer, status, error of an external caller; rows that fail stay, marked, so that no run repeats them."""
    tried = with_retries(call, tries)

    def answer(b: pd.DataFrame) -> pd.DataFrame:
        got = [tried(x) for x in b["prompt"]]
        return pd.DataFrame({key: b[key], "answer": [a for a, _ in got], "status": ["completed" if e is None else "failed" for _, e in got], "error": [e for _, e in got]})

    return map_batched(df.select(F.col(key).cast("long").alias(key), F.col(prompt).alias("prompt")), answer, f"{key} bigint, answer string, status string, error string")


class WordSpans:
    """Table function: word, start and stop of the words of a text."""

    def eval(self, text: str):
        at = 0
        for w in (text or "").split(" "):
            if w:
                yield w, at, at + len(w)
            at += len(w) + 1


def register(spark) -> None:
    """Make word_spans(text) known to SQL."""
    ship(spark)
    spark.udtf.register("word_spans", F.udtf(WordSpans, returnType="word string, start int, stop int"))
