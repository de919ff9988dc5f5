from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from quillon.llm import bpe
from quillon.llm.queries import QUERIES
from tests.conftest import SMALL

PATH, PATTERN = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def own():
    return bpe.Vocabulary(PATH)


@pytest.fixture(scope="module")
def theirs(own):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_replay_equals_the_library(own, theirs):
    r = random.Random(1)
    tokens, chars = list(own.ranks), "abcdeäöüéß the THE ing 日本語한국어русский 123 \n\t\x85 \x1c\x00🙂é'll"
    find = regex.compile(PATTERN).findall
    texts = ["".join(r.choice(chars) for _ in range(r.randint(0, 60))) if n % 2 else b"".join(r.choice(tokens) for _ in range(r.randint(0, 30))).decode("utf8", "replace") for n in range(2000)]
    texts += ["a" * 5000, "<|endoftext|>", " " * 999 + "x", "ab" * 3000 + "é" * 400]
    got = own.encode(set().union(*map(find, texts)))
    for t in texts:
        assert ids_of(b"".join(got[p] for p in find(t))) == theirs.encode_ordinary(t)


def test_lower_rank_after_a_merge(tmp_path):
    """A merge may make a pair of a lower rank; the piece's other places then wait, as they do one piece at a time."""
    import base64

    import tiktoken

    extra = [b"ab", b"aba", b"bc", b"abab", b"cab", b"abc", b"aa", b"aaa"]
    r = random.Random(3)
    for n in range(30):
        r.shuffle(extra)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(extra)}
        path = tmp_path / f"v{n}"
        path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in ranks.items()))
        v, lib = bpe.Vocabulary(str(path)), tiktoken.Encoding("x", pat_str=r"\p{L}+", mergeable_ranks=ranks, special_tokens={})
        words = {"".join(r.choice("abc") for _ in range(r.randint(1, 14))) for _ in range(200)}
        for w, ids in v.encode(words).items():
            assert ids_of(ids) == lib.encode_ordinary(w), (extra, w)


def test_query_equals_the_library_on_all_documents(spark, theirs):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op13_bpe"](spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = theirs.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_odd_texts_and_columns(spark, theirs, monkeypatch):
    texts = [None, "", " \n", "word", "word", "é" * 300_000 + " x", "end 🙂"]
    df = spark.createDataFrame([(None if i == 3 else i, t, "old") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    for frequent in (0, 3, 1000):  # the dictionary's size changes no result
        rows = bpe.decode(bpe.encode(df, frequent=frequent)).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert ids_of(r.ids) == theirs.encode_ordinary(r.text or "") and r.decoded.decode() == (r.text or "")
    broken = spark.range(1).select(F.expr("cast(x'61FF62' as string)").alias("text"))
    assert bpe.decode(bpe.encode(broken)).first().decoded.decode() == "a�b"
    empty = bpe.decode(bpe.encode(df.limit(0)))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "ids", "decoded"]
    assert bpe.decode(df.select(F.lit(None).cast("binary").alias("ids"))).first().decoded == b""
