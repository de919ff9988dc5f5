"""Evidence of documents: words of pages in reading order, and fields laid over them by two passes of annotations."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from quillon.functions.sets import bound
from quillon.operators.relations import settled
from quillon.shipping import ship

# Fields of a record.
SCALARS = ("full_name", "email", "location", "phone", "linkedin_url", "github_url", "summary")
KINDS = ("work_experience", "education", "projects", "certifications")

#: Pages as a layout reader gives them: boxes of text lines with styled spans, and tables by cells.
_LINES = "array<struct<spans: array<struct<text: string, bbox: array<double>>>, bbox: array<double>>>"
PAGES = f"array<struct<page_number: int, width: double, height: double, boxes: array<struct<textlines: {_LINES}, table: struct<cells: array<array<array<double>>>, extract: array<array<string>>>>>>>"
_WORDS = "array<struct<word: string, box: array<double>>>"
#: A space is read between two spans whose gap is wider than this share of the line's height.
GAP = 0.25


# --- units ------------------------------------------------------------------------------------


def _line_text(spans: Column) -> Column:
    """Spans put together, with a space at wide gaps that neither side marks."""

    def piece(s: Column, i: Column) -> Column:
        p = F.get(spans, i - 1)
        text = F.coalesce(s["text"], F.lit(""))
        height = F.greatest(p["bbox"][3] - p["bbox"][1], s["bbox"][3] - s["bbox"][1], F.lit(1.0))
        wide = (i > 0) & (s["bbox"][0] - p["bbox"][2] > height * GAP) & ~F.coalesce(p["text"].rlike(r"[ \t]$"), F.lit(False)) & ~text.rlike(r"^[ \t]")
        return F.concat(F.when(F.coalesce(wide, F.lit(False)), " ").otherwise(""), text)

    return F.array_join(F.transform(spans, piece), "")


def _line_box(line: Column) -> Column:
    s = line["spans"]
    side = lambda k: F.transform(s, lambda x: x["bbox"][k])
    return F.coalesce(line["bbox"], F.array(F.get(s, F.lit(0))["bbox"][0], F.array_min(side(1)), F.element_at(s, -1)["bbox"][2], F.array_max(side(3))))


def words_in_box(text: Column, box: Column) -> Column:
    """struct(word, box) of the words of a text, each with its characters' share of the width."""
    # text, box, pieces and ends are computed once a text; in the body of a lambda they would be for every word
    add = lambda s, p: F.concat(s, F.array(F.coalesce(F.element_at(s, -1), F.lit(0)) + F.length(p)))
    ends = lambda pieces: F.slice(F.aggregate(pieces, F.array(F.lit(0)), add), F.lit(2), F.size(pieces))

    def words(x: Column) -> Column:
        box, width, size = x["box"], F.greatest(x["box"][2] - x["box"][0], F.lit(1.0)), F.greatest(F.length(x["text"]), F.lit(1))

        def placed(p: Column) -> Column:
            word, end = F.regexp_replace(p["piece"], r"(?U)^\s+", ""), p["end"]
            return F.struct(word.alias("word"), F.array(box[0] + width * (end - F.length(word)) / size, box[1], box[0] + width * end / size, box[3]).alias("box"))

        pieces = F.regexp_extract_all(x["text"], F.lit(r"(?U)\s*\S+|\s+$"), F.lit(0))
        both = lambda ps: F.zip_with(ps, ends(ps), lambda p, e: F.struct(p.alias("piece"), e.alias("end")))
        return F.filter(F.transform(bound(pieces, both), placed), lambda w: w["word"] != "")

    return bound(F.struct(text.alias("text"), box.alias("box")), words)


def _box_words(b: Column) -> Column:
    """struct(word, box) of a box: its lines, then its table's cells; lines without spans and cells without a box are passed over."""
    lines = F.filter(F.coalesce(b["textlines"], F.array().cast(_LINES)), lambda x: F.coalesce(F.size(x["spans"]) > 0, F.lit(False)))
    read = F.flatten(F.transform(lines, lambda x: words_in_box(_line_text(x["spans"]), _line_box(x))))
    cells = F.flatten(F.zip_with(b["table"]["cells"], b["table"]["extract"], lambda c, e: F.zip_with(c, e, lambda x, y: F.struct(x.alias("box"), F.coalesce(y, F.lit("")).alias("text")))))
    table = F.flatten(F.transform(F.filter(cells, lambda x: x["box"].isNotNull()), lambda x: words_in_box(x["text"], x["box"])))
    return F.concat(read, F.coalesce(table, F.array().cast(_WORDS)))


def units(documents: DataFrame, doc: str = "doc_id", pages: str = "pages") -> DataFrame:
    """doc, at, evidence_id, page, text, box (thousandths of the page): the words of a document in reading order.

    A page without a number has its place; a page without a positive size is an error. Documents
    without words have no rows.
    """

    def on_page(p: Column, i: Column) -> Column:
        share = lambda x, whole: F.greatest(F.lit(0), F.least(F.lit(1000), F.bround(F.lit(1000) * x / whole).cast("int")))
        words = F.coalesce(F.flatten(F.transform(p["boxes"], _box_words)), F.array().cast(_WORDS))
        box = lambda b: F.array(share(b[0], p["width"]), share(b[1], p["height"]), share(b[2], p["width"]), share(b[3], p["height"]))
        return F.transform(words, lambda w: F.struct(F.coalesce(p["page_number"], i + 1).alias("page"), w["word"].alias("text"), box(w["box"]).alias("box")))

    flat = F.flatten(F.transform(F.col(pages), on_page))
    bad = F.exists(pages, lambda p: ~(F.coalesce(p["width"], F.lit(0)) > 0) | ~(F.coalesce(p["height"], F.lit(0)) > 0))
    checked = documents.filter(F.when(bad, F.raise_error(F.lit("page dimensions must be positive")).cast("boolean")).otherwise(F.lit(True)))
    rows = checked.select(F.col(doc), F.posexplode(flat).alias("at", "u"))
    name = F.concat(F.col(doc).cast("string"), F.lit(":p"), F.col("u.page").cast("string"), F.lit(":w"), F.col("at").cast("string"))
    return rows.select(doc, F.col("at").cast("bigint").alias("at"), name.alias("evidence_id"), "u.page", "u.text", "u.box")


# --- annotations ------------------------------------------------------------------------------


def field_of(path: Column) -> Column:
    """struct(field_path, record_index) of an annotation's path: places in records and lists become * and an index."""
    p = F.regexp_replace(path, r"^contact_info\.", "")
    nested = rf"^({'|'.join(KINDS)})\.(\d+)\.(.+)$"
    inner = F.regexp_replace(F.regexp_extract(p, nested, 3), r"\.\d+$", "")
    is_nested, is_skill = p.rlike(nested), p.rlike(r"^skills\.\d+(?:\.skill_name)?$")
    name = F.when(is_nested, F.concat_ws(".*.", F.regexp_extract(p, nested, 1), inner)).when(is_skill, F.lit("skills")).otherwise(F.nullif(p, F.lit("")))
    return F.struct(name.alias("field_path"), F.when(is_nested, F.regexp_extract(p, nested, 2).cast("int")).alias("record_index"))


def truth_annotations(truth: str, schema: StructType) -> Column:
    """Annotations (path, text, grp) of a record column, in the order of its values: scalars, skills, then records field by field.

    Values of one list are a group; null and blank values have no annotation.
    """
    one = lambda path, v, grp=None: F.struct(path.alias("path"), v.cast("string").alias("text"), (F.lit(None).cast("string") if grp is None else grp).alias("grp"))
    many = lambda values, path: F.transform(values, lambda x, j: one(F.concat(path, F.lit("."), j.cast("string")), x, path))
    none = F.array().cast("array<struct<path: string, text: string, grp: string>>")
    parts = [F.array(*[one(F.lit(f), F.col(truth)[f]) for f in SCALARS if f in schema.names])] if set(SCALARS) & set(schema.names) else []
    if "skills" in schema.names:
        parts.append(F.transform(F.col(truth)["skills"], lambda s, i: one(F.concat(F.lit("skills."), i.cast("string"), F.lit(".skill_name")), s, F.lit("skills"))))

    def records(kind: str):
        def record(r: Column, i: Column) -> Column:
            base, values = F.concat(F.lit(f"{kind}."), i.cast("string"), F.lit(".")), []
            for f in schema[kind].dataType.elementType:
                path = F.concat(base, F.lit(f.name))
                if isinstance(f.dataType, ArrayType):
                    values.append(many(r[f.name], path))
                else:
                    values.append(F.array(one(path, r[f.name])))
            return F.concat(*[F.coalesce(v, none) for v in values])

        return F.flatten(F.transform(F.col(truth)[kind], record))

    parts += [records(kind) for kind in KINDS if kind in schema.names]
    return F.filter(F.concat(*[F.coalesce(p, none) for p in parts]), lambda a: F.trim(a["text"]) != "")


# --- alignment --------------------------------------------------------------------------------

_NOT_WORD = re.compile(r"[^\w\s]")


def _words(text: str | None) -> list[str]:
    return _NOT_WORD.sub(" ", unicodedata.normalize("NFKC", text or "").casefold()).split()


class _Document:
    """A document's units, the labels that they have, and where words begin."""

    def __init__(self):
        self.at: list[int] = []
        self.page: list[int | None] = []
        self.label: list[tuple[str, int | None] | None] = []
        self.words: list[str] = []
        self.unit: list[int] = []  # of each word
        self.first: list[int] = []  # word of each unit
        self.starts: dict[str, list[int]] = defaultdict(list)
        self.held: dict[tuple[str, int | None], set[int]] = defaultdict(set)

    def add(self, at: int, page: int | None, text: str | None, label) -> None:
        n, words = len(self.at), _words(text)
        self.at.append(at)
        self.page.append(page)
        self.label.append(label)
        self.first.append(len(self.words))
        if words:
            self.starts[words[0]].append(n)
        self.words += words
        self.unit += [n] * len(words)
        if label:
            self.held[label].add(n)

    def has(self, label, want: list[str]) -> bool:
        """Whether the units of a label, read on, hold the text."""
        got = " ".join(w for u in sorted(self.held[label]) for w in self.words[self.first[u] : self._end(u)])
        return " ".join(want) in got

    def _end(self, unit: int) -> int:
        return self.first[unit + 1] if unit + 1 < len(self.first) else len(self.words)

    def spans(self, want: list[str], page: int | None) -> list[tuple[int, int]]:
        """First and last unit of each place where free units of one page spell the words, from left to right."""
        out = []
        for s in self.starts.get(want[0], ()):
            a = self.first[s]
            b = a + len(want)
            if self.words[a:b] != want or (page is not None and self.page[s] != page):
                continue
            e = self.unit[b - 1]
            if self._end(e) == b and all(self.label[u] is None and self.page[u] == self.page[s] for u in range(s, e + 1)):
                out.append((s, e))
        return out

    def put(self, label, span: tuple[int, int]) -> None:
        for u in range(span[0], span[1] + 1):
            self.label[u] = label
            self.held[label].add(u)

    def lay(self, notes: list[tuple]) -> None:
        """Annotations (label, words, page, group) of a pass, in order; a group is laid where its first one stands."""
        groups: dict[str, list[tuple]] = defaultdict(list)
        for note in notes:
            if note[3] is not None:
                groups[note[3]].append(note)
        for label, want, page, grp in notes:
            if grp is not None:
                self._lay_group(groups.pop(grp, []))
            elif want and not self.has(label, want):
                for span in self.spans(want, page)[:1]:
                    self.put(label, span)

    def _lay_group(self, notes: list[tuple]) -> None:
        """The longest chain of following annotations at following places, of those the shortest, then the first."""
        left = [(label, self.spans(want, page)) for label, want, page, _ in notes if want and not self.has(label, want)]
        begin = [[s for s, _ in spans] for _, spans in left]
        best, rank = [], (0, 0, 0)
        for k, (_, spans) in enumerate(left):
            for head in spans:
                chain = [(k, head)]
                for j in range(k + 1, len(left)):
                    n = bisect_right(begin[j], chain[-1][1][1])
                    if n < len(begin[j]):
                        chain.append((j, left[j][1][n]))
                order = (-len(chain), chain[-1][1][1] - head[0], head[0])
                if order < rank:
                    best, rank = chain, order
        for k, span in best:
            self.put(left[k][0], span)


_OUT = "{doc} bigint, at bigint, field_path string, record_index int"


def align_fields(tokens: DataFrame, annotations: list[DataFrame], doc: str = "doc_id") -> DataFrame:
    """doc, at, field_path, record_index of the tokens that have or get a field.

    tokens: doc, at, page, text and, if some are labelled, field_path and record_index. annotations: a
    table a pass of doc, ord, path, text, page, grp (the last two may be null). Passes follow each other over one set of taken tokens:
    no token gets two fields, and a value that its field's tokens hold already isn't sought. Rows of
    a document meet in one task, in order; documents without an id have no rows.
    """
    ship(tokens.sparkSession)
    some = lambda df, c, kind: F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
    rows = tokens.select(F.col(doc).cast("bigint").alias("d"), F.lit(-1).alias("pass"), F.col("at").cast("bigint").alias("i"), "text", F.col("page").cast("int").alias("page"), F.lit(None).cast("string").alias("grp"), some(tokens, "field_path", "string").alias("f"), some(tokens, "record_index", "int").alias("r"))
    for n, a in enumerate(annotations):
        f = field_of(F.col("path"))
        rows = rows.union(a.select(F.col(doc).cast("bigint"), F.lit(n), F.col("ord").cast("bigint"), "text", some(a, "page", "int"), some(a, "grp", "string"), f["field_path"], f["record_index"]))
    dealt = rows.filter("d IS NOT NULL").repartition("d").sortWithinPartitions("d", "pass", "i")
    return dealt.mapInArrow(_aligned(doc), _OUT.format(doc=doc))


def _aligned(doc: str):
    def run(batches):
        now, page, notes, step = None, _Document(), [], -1

        def labelled():
            page.lay(notes)
            found = [(now, page.at[u], *label) for u, label in enumerate(page.label) if label]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32())
            columns = list(zip(*found, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [doc, "at", "field_path", "record_index"])

        for batch in batches:
            for d, n, i, text, p, grp, f, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if d != now:
                    if now is not None:
                        yield labelled()
                    now, page, notes, step = d, _Document(), [], -1
                if n < 0:
                    page.add(i, p, text, (f, r) if f is not None else None)
                    continue
                if n != step:
                    page.lay(notes)
                    notes, step = [], n
                if f is not None:
                    notes.append(((f, r), _words(text), p, grp))
        if now is not None:
            yield labelled()

    return run


def evidence_graphs(documents: DataFrame, annotations: DataFrame, truth: DataFrame, doc: str = "doc_id", pages: str = "pages") -> DataFrame:
    """Units of documents with field_path and record_index: read from pages, then annotations, then what of the true values is still unplaced."""
    u = settled(units(documents, doc, pages))  # read twice, made once
    return u.join(align_fields(u, [annotations, truth], doc), [doc, "at"], "left")
