from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import matching as X
from quillon.functions import text as T
from quillon.operators import metrics as M
from quillon.operators import relations as R
from quillon.operators import sequences as Q
from quillon.sources import files as S


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("+1 (415) 555-0100 ext. 12", "14155550100x12"), ("415-555-0100", "4155550100")])
def test_phone(spark, raw, want):
    assert one(spark, T.normalize_phone(F.lit(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [("HTTPS://user@WWW.Example.com//a//b/?q=1#top", "example.com/a/b?q=1"), ("example.com/", "example.com"), ("https: //x.org:80/a", "x.org:80/a")])
def test_url(spark, raw, want):
    assert one(spark, T.normalize_url(F.lit(raw))) == want


def test_dates_and_words(spark):
    assert one(spark, T.normalize_date(F.lit(" Current "))) == "present"
    assert one(spark, T.normalize_date(F.lit("2019 – 03"))) == "2019-03"
    assert one(spark, T.word_count(F.lit("  a  b\nc "))) == 3
    assert one(spark, T.word_count(F.lit("  "))) == 0


def test_exact_normaliser(spark):
    assert one(spark, T.normalize_text_exact(F.lit("Straße ﬁn, É!"))) == "strasse fin é"


def lcs(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1, j + 1] = d[i, j] + 1 if x == y else max(d[i, j + 1], d[i + 1, j])
    return int(d[-1, -1])


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
@settings(max_examples=60, deadline=None)
def test_lcs(a, b):
    assert X.lcs_length(a, b) == lcs(a, b)


@given(st.integers(1, 4), st.integers(1, 5), st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_assignment_is_best(n, m, seed):
    from itertools import permutations

    w = np.random.default_rng(seed).random((n, m))
    got = sum(w[i, j] for i, j in X.assignment(w))
    small, large = (w, m) if n <= m else (w.T, n)
    best = max(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(large), len(small)))
    assert got == pytest.approx(best)


def test_auc_edges(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert M.auc(df, "y", "s").first().auc == 0.5
    df = spark.createDataFrame([(0, 0.1), (1, 0.1), (1, 0.9), (0, 0.0)], "y int, s double")
    assert M.auc(df, "y", "s").first().auc == pytest.approx(0.875)


def test_strict_join_raises(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    with pytest.raises(R.KeyMismatch):
        R.strict_join(a, b, "k")


def test_quotas_sum(spark):
    s = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, w int")
    assert {r.k: r.quota for r in R.quotas(s, "w", 2, "k").collect()} == {"a": 1, "b": 1, "c": 0}


def test_sessions_and_anchors(spark):
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate("aabacc")], "d int, at int, f string")
    assert [r.grp for r in Q.repeated_key_sessions(df, ["d"], "at", "f").orderBy("at").collect()] == [0, 0, 0, 1, 1, 1]
    assert [r.grp for r in Q.anchored_groups(df, ["d"], "at", "f", "a").orderBy("at").collect()] == [0, 0, 0, 1, 1, 2]
    assert [(r.at, r.grp) for r in Q.anchored_groups(df, ["d"], "at", "f", "b").orderBy("at").collect()] == [(2, 0), (3, 0), (4, 0), (5, 1)]


def test_numbered_is_dense(spark):
    df = R.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")), [F.col("v")], "n")
    assert df.filter("n <> v + 1").count() == 0


def test_strict_reader_refuses(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n[1]\n')
    with pytest.raises(Exception, match="not an object"):
        S.read_jsonl(spark, str(p), "a int").collect()
    with pytest.raises(S.LockedSplit):
        S.guarded(lambda: None, "locked_confirmation")


def test_markdown_bolds_best():
    assert "**0.9000**" in S.markdown([{"m": "a", "x": 0.9}, {"m": "b", "x": 0.1}], ["x"])


def test_small_matrices_are_matched_as_large_ones():
    from quillon.functions import matching as X

    rng = np.random.default_rng(5)
    for _ in range(300):
        w = np.round(rng.random((rng.integers(1, 9), rng.integers(1, 9))), 1)  # with ties
        cost = -w if w.shape[0] <= w.shape[1] else -w.T
        assert X._augmented_lists(cost.tolist()) == X._augmented(cost).tolist()
        assert X.assignment(w.tolist()) == X.assignment(w)
    assert X.assignment([]) == [] and X.assignment([[]]) == []


def test_exact_forms_are_made_text_by_text():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array(["Straße, " * 600] * 2000 + [None, ""])  # 10 MB
    tracemalloc.start()
    got = T.normalize_text_exact.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000 and got[0].as_py() == " ".join(["strasse"] * 600) and got[2000].as_py() is None and got[2001].as_py() == ""


def test_phrases_are_sought_in_blocks_of_texts():
    import pyarrow as pa

    from quillon.functions.automaton import PhraseAutomaton

    a, sizes = PhraseAutomaton(["b c"]), []
    plain = a._find
    a._find = lambda t: sizes.append(t.nbytes) or plain(t)
    texts = pa.array(["a b c", None, "b", "c"] * 50)
    assert a.find(texts, most=40) == plain(texts) and len(sizes) > 5
