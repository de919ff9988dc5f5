"""Cases in which an operator once did less than its job."""

from __future__ import annotations

import html.parser
import itertools
import re
import time

import numpy as np
import pytest

from quillon.llm import decontaminate, html_text
from tests.conftest import SMALL
from tests.llm.test_operators import rows, table, words


def test_parts_and_shifted_copies_of_items(spark):
    long, item, point = words(59, 1), words(40, 2), words(30, 3)
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(item)), (3, " ".join(point))], "item_id bigint, text string")
    noise = lambda s: " ".join(words(150, s, 10000))
    put = [*item[:20], "inserted", *item[20:]]
    out = [*item[:19], *item[20:]]
    edges = " ".join(f"“{w}”," if k % 2 else f"({w})." for k, w in enumerate(point))
    docs = [f"{noise(11)} {' '.join(long[20:55])} {noise(12)}", f"{noise(13)} {' '.join(put)} {noise(14)}", f"{' '.join(out)} {noise(15)}", f"{noise(16)} {edges} {noise(17)}", f"{noise(18)} {' '.join(long[:12])} {noise(19)} {' '.join(long[30:40])}"]
    got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.overlaps(table(spark, list(enumerate(docs))), bench).collect()}
    assert got == {(0, 1): 35, (1, 2): 40, (2, 2): 39, (3, 3): 30}


def test_short_lines_after_a_wall_are_kept():
    long = "x" * 300
    assert html_text.main_text(f"<p>{long}</p><div class=ad>buy</div><p>Short closing paragraph.</p><footer>f</footer>") == f"{long}\nShort closing paragraph."
    assert html_text.main_text(f"<nav>a</nav><p>{long}</p><aside>b</aside><p>one</p><form>c</form><p>two</p><nav>d</nav><p>{long}</p>") == f"{long}\none\ntwo\n{long}"


@pytest.mark.parametrize(("n", "share"), [(8, 0.6), (10, 0.6), (12, 0.6), (13, 0.6), (20, 0.6), (37, 0.6), (12, 0.8)])
def test_recall_of_items_with_just_enough_equal_words(spark, n, share):
    r, docs, items = np.random.default_rng(n), [], []
    for i in range(200):
        item = [f"i{i}x{k}" for k in range(n)]
        keep = set(r.permutation(n)[: int(np.ceil(share * n - 1e-9))].tolist())
        items.append((i, " ".join(item)))
        docs.append((i, " ".join([*words(30, i, 10000), *[w if k in keep else f"z{i}q{k}" for k, w in enumerate(item)], *words(30, 500 + i, 10000)])))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert decontaminate.overlaps(table(spark, docs), bench).filter("doc_id = item_id").count() >= 0.9 * 200


@pytest.mark.parametrize("n", [4, 5, 6, 7])
def test_short_items_with_just_enough_equal_words_are_always_found(spark, n):
    """Every choice of the least number of equal words, in the middle and at either end of a document; one word less is clean."""
    least = int(np.ceil(0.6 * n - 1e-9))
    docs, items, clean = [], [], []
    for i, keep in enumerate(itertools.combinations(range(n), least)):
        item = [f"i{i}x{k}" for k in range(n)]
        items.append((i, " ".join(item)))
        laid = [w if k in keep else f"z{i}q{k}" for k, w in enumerate(item)]
        less = [w if k in keep[1:] else f"z{i}q{k}" for k, w in enumerate(item)]
        lead, tail = words(30 * (i % 3 != 0), i, 10000), words(30 * (i % 3 != 1), 500 + i, 10000)
        docs.append((i, " ".join([*lead, *laid, *tail])))
        clean.append((i + 1000, " ".join([*lead, *less, *tail])))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.matched) for r in decontaminate.overlaps(table(spark, docs + clean), bench).collect()}
    assert got == {(i, i, least) for i, _ in docs}


def test_items_of_one_to_three_words_are_sought_whole(spark):
    bench = spark.createDataFrame([(1, "alpha"), (2, "beta gamma"), (3, "delta epsilon zeta")], "item_id bigint, text string")
    docs = table(spark, [(1, "x Alpha, y"), (2, "beta x gamma"), (3, "(Beta gamma)"), (4, "delta epsilon y"), (5, "delta epsilon zeta")])
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()} == {(1, 1), (3, 2), (5, 3)}


def test_decontamination_beyond_broadcasts_agrees(spark):
    docs, bench = (spark.read.parquet(f"{SMALL}/{x}.parquet") for x in ("documents", "benchmark"))
    assert rows(decontaminate.overlaps(docs, bench).toPandas()) == rows(decontaminate.overlaps(docs, bench, broadcast_rows=0).toPandas())


def test_decontamination_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{SMALL}/{x}.parquet") for x in ("documents", "benchmark"))
    cut = lambda t: [w for w in (re.sub(r"^[^\w]+|[^\w]+$", "", x) for x in t.lower().split()) if w]
    items = {r.item_id: cut(r.text) for r in bench.collect()}
    want = set()
    for d in docs.collect():
        w = cut(d.text or "")
        for i, m in items.items():
            best = max((sum(x == y for x, y in zip(w[s:], m, strict=False)) for s in range(len(w))), default=0)
            if best >= 0.6 * len(m):
                want.add((d.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()}
    assert want <= got and len(got - want) <= 0.1 * len(want) + 1  # words put in or left out, and parts of items, come on top


class Plain(html.parser.HTMLParser):
    """The article of a page by a plain walk over its tags: blocks end lines, walls by name or class are left out."""

    WALLS = {"nav", "header", "footer", "aside", "form", "script", "style", "button", "select", "noscript"}
    BLOCKS = set("p div h1 h2 h3 li ul ol section article table tr td br blockquote pre figure figcaption hr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.lines, self.part = [], [], []

    def flush(self):
        t = " ".join("".join(self.part).split())
        self.part = []
        if t:
            self.lines.append(t)

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS | self.WALLS:
            self.flush()
        if tag not in ("br", "img", "hr", "input", "meta", "link"):
            names = set((dict(attrs).get("class") or "").split() + (dict(attrs).get("id") or "").split())
            self.stack.append((tag, tag in self.WALLS or bool(names & {"ad", "ads", "sidebar", "comments", "notice", "cookie", "related", "share"})))

    def handle_endtag(self, tag):
        if tag in self.BLOCKS | self.WALLS:
            self.flush()
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.stack) and not any(w for _, w in self.stack):
            self.part.append(data)


def test_pages_against_a_plain_walk(spark):
    same = total = 0
    for r in spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/pages.parquet").collect():
        p = Plain()
        p.feed(r.html or "")
        p.flush()
        total += 1
        same += "".join("".join(p.lines).split()) == "".join(html_text.main_text(r.html).split())
    assert same >= 0.95 * total, (same, total)


def test_window_sums_decide():
    teaser, lead, long, tail = "A short teaser", "Next to it", "word " * 60, "by the editor"
    page = "<body><article><p>{}</p></article><nav>x</nav><article><p>{}</p></article><nav>x</nav><article><p>{}</p></article><div>{}</div></body>"
    assert html_text.main_text(page.format(teaser, lead, long, tail)) == f"{lead}\n{long.strip()}"  # the window of the lead reaches the long line
    assert html_text.main_text(page.format(long, teaser, lead, tail)) == f"{long.strip()}\n{teaser}\n{lead}"
    assert html_text.main_text(page.format(teaser, lead, tail, long * 10)) == f"{tail}\n{(long * 10).strip()}"
    bare = "<body><p>{}</p><nav>x</nav><p>{}</p><nav>x</nav><p>{}</p></body>"
    assert html_text.main_text(bare.format(teaser, lead, long)) == f"{lead}\n{long.strip()}"
    assert html_text.main_text(bare.format(long, lead, teaser)) == f"{long.strip()}\n{lead}\n{teaser}"
    assert html_text.main_text("<article><h1>T</h1><div class=ad>x</div><p>" + long + "</p></article>") == f"T\n{long.strip()}"


def test_long_pages_take_time_in_proportion():
    for page in ("<b>" * 110_000 + "</div>" * 110_000, "<div><i><div>" + "<b>" * 200_000 + "</i>" * 100_000, '<a "' * 250_001, "<p><b>" * 150_000):
        t = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - t < 10


def test_rows_of_near_copies_grow_with_their_number(spark, monkeypatch):
    from quillon.llm import near_dedup

    sent = []
    keep = near_dedup._dealt
    monkeypatch.setattr(near_dedup, "_dealt", lambda *a: sent.append(keep(*a)) or sent[-1])
    base, r, texts = words(120, 3), np.random.default_rng(4), []
    for i in range(1200):
        t = list(base)
        for p in r.integers(0, 120, 2):
            t[p] = f"x{r.integers(1 << 30)}"
        texts.append((i, " ".join(t)))
    got = near_dedup.near_classes(table(spark, texts), 3, 85)
    assert [(x.component_id, x["count"]) for x in got.groupBy("component_id").count().collect()] == [(0, 1200)]
    assert sum(x.count() for x in sent) <= 64 * 1200
    tasks = sent[0].groupBy("key", "x").count().toPandas()["count"]
    assert tasks.max() <= near_dedup.BLOCK * 1.5
