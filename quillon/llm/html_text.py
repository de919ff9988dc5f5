"""Main text of web pages by line-block distribution.

Markup is stripped so that every block element ends a line; lines inside menus, headers, footers,
sidebars, notices, adverts, forms and comments count as walls and weigh nothing. Text lengths are
summed over windows of WINDOW lines, on every page. Names of elements only weigh: where a page has
article or main elements (or elements named so), lines outside them count with one part in OUTSIDE
of their length; a first-level heading counts as LEAST characters at least. The first window
whose sum reaches the threshold is the surge point; the text runs from there, or from the wall, gap
or start of the main element before it, to the dive point, after which all sums are nothing, and
every line between that is no wall is kept, however short; outside of main elements a stretch must
reach the threshold by itself. The threshold is LEAST characters, or the largest sum of the page
where none reaches that.

Defined results: null, empty and text-free pages give an empty string; unclosed and stray tags are
tolerated, an unclosed wall ends with its parent; a br ends a line, as a block does; plain text without markup is kept whole; long
pages are read whole, in time in proportion to their length; repeated rows give equal texts; an empty table
gives an empty result. Extra columns pass through, but for a `text` or `n_chars` of the input's, which
the result's replace.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.base import map_batches

WINDOW = 3
LEAST = 120
#: On pages with a main element, a line outside of all of them counts with this part of its length.
OUTSIDE = 8

_BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = ("script", "style", "template", "textarea", "title", "iframe", "noframes", "xmp")
_WALL = frozenset("nav header footer aside form button select option dialog menu head noscript svg canvas object audio video map fieldset label input".split())
_MAIN = frozenset("article main".split())
_NAMED_WALL = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|side|aside|ads?|advert|adverts|advertisement|sponsor|sponsored|promo|banner|cookies?|consent|notice|notices|alert|popup|modal|newsletter|subscribe|share|sharing|social|related|recommended|comments?|disqus|replies|respond|login|signup|search|pagination|pager|widget|toolbar|copyright)(?:$|[\s_-])", re.I)
_NAMED_MAIN = re.compile(r"(?:^|[\s_-])(?:article|post|entry|content|main|story|article-body|post-body|entry-content)(?:$|[\s_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</?[a-zA-Z][^>]*>", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_BROKEN = re.compile(r"<[a-zA-Z/!?]")
#: Their end tags don't close what lies around the nearest main element or wall.
_SCOPED = frozenset("p li td th tr dd dt".split())
#: A new one of these ends an open p; a new li, td and so on ends the one before.
_ENDS_P = _BLOCK - {"br", "option", "button", "select"}
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def lines_of(page: str) -> list[tuple[str, int, int, bool]]:
    """(line, kind, main element, heading) in page order; kind 2: inside a main element, 1: elsewhere, 0: a wall (its text dropped).

    Open elements are looked up by name and by class, so an end tag costs what it closes, however
    many elements are open. A tag that the page breaks off is dropped.
    """
    out: list[tuple[str, int, int, bool]] = []
    stack: list[tuple[str, int, bool]] = []  # element, walls and mains around counted by its flags
    named: dict[str, list[int]] = {}  # places in the stack by name, of blocks but p, and of mains and walls
    closed_by: list[int] = []
    bounds: list[int] = []
    walls = mains = no = 0
    parts: list[str] = []
    title = False

    def flush() -> None:
        text = "".join(parts)
        parts.clear()
        if walls:
            if not out or out[-1][1]:
                out.append(("", 0, no if mains else 0, False))
            return
        text = _SPACE.sub(" ", html.unescape(text)).strip()
        if text:
            out.append((text, 2 if mains else 1, no if mains else 0, title))

    def push(name: str, wall: bool, main: bool) -> None:
        nonlocal walls, mains, no
        at = len(stack)
        named.setdefault(name, []).append(at)
        if name in _BLOCK and name != "p":
            closed_by.append(at)
        if name in _MAIN or name in _WALL:
            bounds.append(at)
        if main and not wall and not mains:
            no += 1
        stack.append((name, int(wall), int(main and not wall)))
        walls += wall
        mains += main and not wall

    def pop_to(at: int) -> None:
        nonlocal walls, mains
        while len(stack) > at:
            name, wall, main = stack.pop()
            named[name].pop()
            for places in (closed_by, bounds):
                if places and places[-1] == len(stack):
                    places.pop()
            walls -= wall
            mains -= main

    def last(places: list[int] | None) -> int:
        return places[-1] if places else -1

    at, stop = 0, page.rfind(">") + 1
    while True:
        m = _TAG.search(page, at) if at < stop else None
        if not m and at <= stop:
            broken = _BROKEN.search(page, max(at, stop))
            parts.append(page[at : broken.start() if broken else len(page)])
            break
        if not m:
            break
        parts.append(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            parts.append(m[1])
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in _BLOCK or name in _WALL:
            flush()
            title = name == "h1" and not m[2]
        if m[2]:
            k = last(named.get(name))
            if k < 0 or (name not in _BLOCK and max(last(closed_by), last(named.get("p"))) > k):
                continue  # nothing to close, or an inline end tag, which doesn't close blocks
            if name in _SCOPED and last(bounds) > k:
                continue
            pop_to(k)
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _VOID:
            continue
        if name in _ENDS_P:
            while last(named.get("p")) > last(closed_by):
                pop_to(named["p"][-1])
        for same in _SAME.get(name, ()):
            if stack and stack[-1][0] == same:
                pop_to(len(stack) - 1)
        wall, main = name in _WALL, name in _MAIN
        attrs = m[4] or ""
        if attrs.strip():
            for a in _ATTR.finditer(attrs):
                key, value = a[1].lower(), (a[2] or a[3] or a[4] or "")
                if key in ("class", "id"):
                    wall |= bool(_NAMED_WALL.search(value)) and name not in ("html", "body", "article", "main")
                    main |= bool(_NAMED_MAIN.search(value)) and name in ("div", "section")
                elif key == "role":
                    wall |= value.lower() in _ROLES
                    main |= value.lower() in ("main", "article")
                elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                    wall = True
        if attrs.rstrip().endswith("/") and name not in _BLOCK:
            continue
        if wall and not walls:
            flush()
        push(name, wall, main)
    flush()
    return out


def line_weights(lines: list[tuple[str, int, int, bool]], least: int = LEAST) -> list[float]:
    """The length that a line has in the sums: its characters, none for a wall, a share outside the main elements of a page that has some."""
    inside = any(k == 2 for _, k, _, _ in lines)
    full = [0.0 if not k else len(t) / OUTSIDE if inside and k == 1 else float(len(t)) for t, k, _, _ in lines]
    return [max(w, float(least)) if title and w == len(t) else w for w, (t, _, _, title) in zip(full, lines, strict=True)]


def surge_and_dive(weights: list[float], window: int, least: float) -> tuple[int, int, list[float], float]:
    """The first line whose window sum reaches the threshold, the line after which all sums are nothing, the sums, the threshold."""
    cum = [0.0]
    for w in weights:
        cum.append(cum[-1] + w)
    n = len(weights)
    sums = [cum[min(i + window, n)] - cum[i] for i in range(n)]
    need = min(least, max(sums))
    surge = next(i for i in range(n) if weights[i] and sums[i] >= need)
    dive = next(i for i in range(n, 0, -1) if weights[i - 1])
    return surge, dive, sums, need


def main_text(page: str | None, window: int = WINDOW, least: int = LEAST) -> str:
    """The kept lines joined by line feeds."""
    lines = lines_of(page or "")
    weights = line_weights(lines, least)
    if not any(weights):
        return ""
    a, b, sums, need = surge_and_dive(weights, window, least)
    # back to the wall or gap before the surge, or to the start of the main element around it
    while a and ((lines[a][2] and lines[a - 1][2] == lines[a][2]) or (weights[a - 1] and lines[a - 1][1] == lines[a][1])):
        a -= 1
    inside, out, i = any(k == 2 for _, k, _, _ in lines), [], a
    while i < b:
        j = i + 1
        while j < b and lines[j][1] == lines[i][1]:
            j += 1
        # outside of main elements a stretch must reach the threshold by itself
        if lines[i][1] == 2 or (lines[i][1] == 1 and (not inside or sum(weights[i:j]) >= need)):
            out += [t for t, _, _, _ in lines[i:j]]
        i = j
    return "\n".join(out)


def extract(pages: DataFrame, html_column: str = "html", name: str = "text", keep: list[str] | None = None) -> DataFrame:
    """pages (or its columns `keep`) with the main text of every page, and n_chars, its code points."""
    cols = [c for c in (pages.columns if keep is None else keep) if c not in (name, "n_chars")]
    sent = pages.select(*[F.col(f"`{c}`") for c in cols], F.col(html_column).alias("__html"))

    def mapped(batches):
        for batch in batches:
            n = max(1, min(batch.num_rows, 512))
            for a in range(0, batch.num_rows, n):
                part = batch.slice(a, n)
                texts = [main_text(x) for x in part.column(len(cols)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(cols)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*cols, name, "n_chars"])

    schema = sent.select(*[F.col(f"`{c}`") for c in cols], F.lit("").alias(name), F.lit(0).cast("long").alias("n_chars")).schema
    return map_batches(sent, mapped, schema)


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, keep=["page_id", "url"]).select("page_id", "url", "text", "n_chars")
