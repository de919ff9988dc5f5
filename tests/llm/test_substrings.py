"""Substring de-duplication against brute force."""

from __future__ import annotations

import collections

import numpy as np
import pytest

from quillon.llm import substring_dedup as S
from tests.conftest import SMALL
from tests.llm.test_operators import DOCS, EDGES, table, words


def longest_runs(texts, unit=20):
    """For each id the length of its longest run of words that another id has too, if `unit` at least."""
    w = {i: (t or "").split() for i, t in texts}
    seen = collections.defaultdict(list)
    for i, x in w.items():
        for k in range(len(x) - unit + 1):
            seen[tuple(x[k : k + unit])].append((i, k))
    best = collections.Counter()
    for places in seen.values():
        if len({i for i, _ in places}) < 2:
            continue
        for i, a in places:
            for j, b in places:
                if i != j and (a == 0 or b == 0 or w[i][a - 1] != w[j][b - 1]):
                    n = unit
                    while a + n < len(w[i]) and b + n < len(w[j]) and w[i][a + n] == w[j][b + n]:
                        n += 1
                    best[i] = max(best[i], n)
    return best


def test_passages_of_50_words_are_found_and_shorter_ones_left(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = longest_runs(docs)
    got = S.repeated_passages(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    found = {r.doc_id for r in got}
    assert {i for i, n in want.items() if n >= 50} <= found <= {i for i, n in want.items() if n >= S.RUN}
    w = {i: (t or "").split() for i, t in docs}
    for r in got:
        n = r.end_word - r.start_word
        a, b = w[r.doc_id], w[r.other_doc]
        assert r.doc_id != r.other_doc and n >= S.RUN and a[r.start_word : r.end_word] == b[r.other_start : r.other_start + n]


@pytest.mark.parametrize("broadcast_rows", [0, 10**9])
def test_planted_passages_have_their_true_length(spark, broadcast_rows):
    rng, texts, want = np.random.default_rng(8), [], {}
    for g in range(60):
        n = int(rng.integers(50, 74))
        p = words(n, 1000 + g)
        for c in range(2):
            i = 2 * g + c
            lead = int(rng.integers(1, 60))
            texts.append((i, " ".join([*words(lead, 5000 + i, 10000), *p, *words(40, 9000 + i, 20000)])))
            want[i] = (lead, lead + n, i ^ 1)
    got = S.shared_runs(table(spark, texts), broadcast_rows=broadcast_rows).collect()
    assert {r.doc_id: (r.start_word, r.end_word, r.other_doc) for r in got} == want and len(got) == len(want)


def test_passages_survive_quotes_of_their_parts(spark):
    """Every part of a long passage is also quoted, in short, by documents with smaller and greater ids."""
    for seed in range(6):
        rng = np.random.default_rng(100 + seed)
        p, texts = words(80, 300 + seed), []
        for n, k in enumerate(range(0, 57, 8)):
            for i in (n, 1000 + n):
                texts.append((i, " ".join([*words(50, 40 * i + seed, 10000), *p[k : k + 24], *words(50, 41 * i + seed + 7, 20000)])))
        for i in (500, 501):
            texts.append((i, " ".join([*words(int(rng.integers(5, 60)), i + seed, 30000), *p, *words(30, i + 9 + seed, 40000)])))
        got = S.repeated_passages(table(spark, texts)).collect()
        assert {(r.doc_id, r.other_doc, r.end_word - r.start_word) for r in got} == {(500, 501, 80), (501, 500, 80)}


def test_other_white_space_is_no_other_text(spark):
    p = words(60, 77)
    docs = table(spark, [(1, " ".join(words(30, 1, 10000) + p)), (2, " ".join(words(20, 2, 20000)) + " \n" + " \t\n".join(p)), (3, "  ".join(words(45, 5, 30000) + p))])
    assert {(r.doc_id, r.end_word - r.start_word) for r in S.repeated_passages(docs).collect()} == {(1, 60), (2, 60), (3, 60)}


def test_a_place_among_several_is_always_the_same(spark):
    p, rest = words(60, 78), lambda n, seed: words(n, seed, 10000 * seed)
    docs = table(spark, [(1, " ".join([*rest(50, 1), *p, *rest(50, 2), *p, *rest(50, 3)])), (2, " ".join([*rest(50, 4), *p, *rest(50, 5)])), (3, " ".join([*rest(60, 6), *p, *rest(50, 7)]))])
    want = {(1, 50, 110, 3, 60), (1, 160, 220, 3, 60), (2, 50, 110, 1, 50), (3, 60, 120, 1, 50)}
    for df in (docs.repartition(7, "doc_id"), docs.coalesce(1)):
        assert {(r.doc_id, r.start_word, r.end_word, r.other_doc, r.other_start) for r in S.repeated_passages(df).collect()} == want


def test_neighbouring_passages_of_different_partners_are_no_run(spark):
    p, q = words(25, 1), words(25, 2)
    docs = table(spark, [(1, " ".join(words(80, 11, 10000) + p)), (2, " ".join(p + q)), (3, " ".join(q + words(80, 12, 10000)))])
    assert S.repeated_passages(docs).count() == 0


def test_no_passage_is_lost_from_all_documents(spark):
    for seed in range(3):
        p, q, x = (" ".join(words(80, 100 * seed + k)) for k in range(3))
        rest = lambda s: " ".join(words(60, 700 + 10 * seed + s, 10000))  # noqa: B023, E731
        docs = table(spark, [(1, f"{rest(1)} {p} {rest(2)}"), (2, f"{rest(3)} {p} {q} {rest(4)}"), (3, f"{rest(5)} {q} {rest(6)}"), (5, f"{x} {rest(7)}"), (5, rest(8)), (4, f"{rest(9)} {x}"), (None, f"{p} {rest(0)}"), (None, p)])
        out = [(r.doc_id, r.text) for r in S.drop_repeats(docs).collect()]
        assert len(out) == 8
        text = {i: t for i, t in out if i != 5 and i}
        assert p in text[1] and p not in text[2] and q in text[2] and q not in text[3] and x in text[4]
        assert sorted(len(t.split()) for i, t in out if i == 5) == [60, 60] and sum(p in t for i, t in out if i is None) == 2


def test_odd_rows(spark):
    odd, none = table(spark, EDGES), spark.createDataFrame([], DOCS)
    assert S.drop_repeats(none).count() == 0 and sorted(map(str, (r.text for r in S.drop_repeats(odd).collect()))) == sorted(map(str, (t for _, t in EDGES)))
    twice = table(spark, [(1, " ".join(words(90, 1))), (1, " ".join(words(90, 1))), (2, "same " * 300), (3, "same " * 200)])
    got = S.repeated_passages(twice).collect()
    assert {r.doc_id for r in got} == {2, 3}
