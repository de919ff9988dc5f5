"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns find emails, IP addresses, payment cards and phone numbers; their spans stay. The
network finds what they can't: addresses written name(at)host[dot]org or 10[.]0[.]0[.]1, phones
without a plus, cards with other separators. It is trained in numpy on labelled spans: half of them
cut from documents that aren't held out, where the patterns label them (one window of at most
SAMPLE documents, in the order of a hash of the id), half made by a seeded rule; in both, some
spans are disguised and keep their label. It reads windows of WINDOW characters, STRIDE apart;
each is decoded on its own, and of the tags that windows give one character the one counts in whose
window it stands most central, over the whole text. A decoded span takes the extent of the loose
shape of its kind that it touches; it is added if it passes the kind's tests and overlaps no span before it.

A tag other than "outside" is only possible near a digit, an at sign or a bracketed "at": windows that have none
within CONTEXT characters decode to nothing and aren't computed. Whole texts are scanned for them.

Defined results: null and blank texts have no spans; repeated rows give equal spans; an empty
table gives an empty result; extra columns are left alone. n_email, n_ip, n_card and n_phone
count the pattern spans, n_added those of the network.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.base import blocks, held_out, map_batches, text_bytes

KINDS = ("email", "ip", "card", "phone")
WINDOW = 64
STRIDE = 32
CONTEXT = 24
HIDDEN = 16
STEPS = 160
BATCH = 64
EXAMPLES = 1500
#: Documents that lend the training a window at most.
SAMPLE = 750

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match starts where its run of digits starts and takes whole runs, so neither backtracks
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_NEAR = re.compile(r"[0-9@]|[(\[]at[)\]]")
_DIGITS = re.compile(r"[0-9]+")
#: What a span that only the network finds may look like.
_LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]++\s?(?:@|[(\[]at[)\]])\s?[A-Za-z0-9-]+(?:(?:\.|\s?[(\[](?:dot|\.)[)\]]\s?)[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?[(\[]\.[)\]]\s?[0-9]{1,3}|\x20?\.\x20?[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20._/-]{0,3}[0-9])++"),
    "phone": re.compile(r"(?:\+|\()?[0-9](?:[\x20()./-]{0,2}[0-9])++"),
}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def fits(kind: str, s: str) -> bool:
    """The tests that a match must pass."""
    digits = _NOT_DIGIT.sub("", s)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in _DIGITS.findall(s))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def pattern_spans(t: str) -> list[Span]:
    """The spans of the fixed patterns, by kind and start."""
    out: list[Span] = []
    at, done = t.find("@"), 0
    while at >= 0:
        a = at
        while a > done and t[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(t, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
        done = m.end() if m else at + 1
        at = t.find("@", done)
    for kind, p in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(kind, m.start(), m.end()) for m in p.finditer(t) if fits(kind, m[0])]
    return out


# --- the network ------------------------------------------------------------------------------

#: Character classes: each of these is one, besides lower and upper case letters, digits, white space, others.
_SIGNS = "@.+-()_%:=/,"
_TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def classes(t: str) -> np.ndarray:
    """1 for each letter below a-z, 2 upper, 3 digit, 4 space, 5 other, 6.. signs."""
    cp = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    out = np.full(len(cp), 5, np.int64)
    out[((cp >= 97) & (cp <= 122)) | ((cp >= 0xDF) & (cp < 0x250))] = 1
    out[((cp >= 65) & (cp <= 90)) | ((cp >= 0xC0) & (cp < 0xDF))] = 2
    out[(cp >= 48) & (cp <= 57)] = 3
    out[(cp == 32) | ((cp >= 9) & (cp <= 13))] = 4
    for i, s in enumerate(_SIGNS):
        out[cp == ord(s)] = 6 + i
    return out


_CLASSES = 6 + len(_SIGNS)


def disguised(rng: np.random.Generator, kind: str, s: str) -> str:
    """A span of a kind as the patterns don't know it."""
    pick = lambda x: x[int(rng.integers(len(x)))]
    if kind == "email":
        name, _, host = s.partition("@")
        return name + pick(("(at)", " (at) ", "[at]", " [at] ")) + host.replace(".", pick((".", "[dot]", "(dot)", " [dot] ")))
    if kind == "ip":
        return s.replace(".", pick(("[.]", "(.)", " . ")))
    digits = _NOT_DIGIT.sub("", s)
    if kind == "card":
        return pick((".", "/", " - ", "_")).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    cut = pick((2, 3))
    return pick(("({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}", "0{}/{}-{}")).format(digits[-10 : -10 + cut] or digits[:3], digits[-10 + cut : -4], digits[-4:])


def cut_windows(docs: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> tuple[str, ...]:
    """A stretch around one pattern span, chosen by hash, of each of at most `sample` documents that aren't held out."""

    def mapped(batches):
        for batch in batches:
            texts = [""] * batch.num_rows
            for r, t, base, _ in _per_row(batch, 1, None):
                if base:
                    _, a, b = min(base, key=lambda s: hashlib.sha256(t[s[1] : s[2]].encode()).digest())
                    texts[r] = t[max(0, a - WINDOW // 2) : min(b + WINDOW // 2, a + 2 * WINDOW)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["h", "t"])

    known = docs.filter(F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).select(F.xxhash64(F.lit("pii"), doc_id).alias("h"), F.col(text).alias("text"))
    cut = map_batches(known, mapped, "h bigint, t string").filter("t <> ''")
    # equal stretches, which copies have, count once
    rows = cut.groupBy("t").agg(F.min("h").alias("h")).orderBy("h", "t").limit(sample).collect()
    return tuple(r.t for r in rows)


def lent(rng: np.random.Generator, t: str) -> tuple[str, list[Span]]:
    """A stretch of a document with its labels, one of its spans disguised every other time."""
    spans = sorted(pattern_spans(t), key=lambda s: (s[1], -s[2]))
    spans = [s for i, s in enumerate(spans) if all(s[1] >= x[2] for x in spans[:i])]
    if spans and rng.random() < 0.5:
        i = int(rng.integers(len(spans)))
        k, a, b = spans[i]
        new = disguised(rng, k, t[a:b])
        grown = len(new) - (b - a)
        t = t[:a] + new + t[b:]
        spans = [*spans[:i], (k, a, a + len(new)), *[(x, c + grown, d + grown) for x, c, d in spans[i + 1 :]]]
    return t, spans


def example(rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A short text with its labelled spans."""
    pick = lambda x: x[int(rng.integers(len(x)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(pick(("an", "er", "the", "tion", "qu", "é", "lo", "mi", "sch", "ra", "te", "o")) for _ in range(rng.integers(1, 5)))
    parts, spans, at = [], [], 0
    for _ in range(rng.integers(4, 9)):
        kind, w = None, word()
        r = rng.random()
        if r < 0.16:
            kind, w = "email", word().replace("é", "e") + pick((".", "_", "")) + digits(rng.integers(0, 3)) + "@" + pick(("mail", "post", "web")) + digits(rng.integers(0, 2)) + "." + pick(("example", "test", "corp")) + pick((".com", ".org", ".de", ""))
        elif r < 0.30:
            kind, w = "ip", ".".join(str(x) for x in rng.integers(1, 255, 4))
        elif r < 0.44:
            body = pick("456") + digits(14)
            body += next(c for c in "0123456789" if luhn(body + c))
            sep = pick(("", "", " ", "-"))
            kind, w = "card", sep.join(body[i : i + 4] for i in range(0, 16, 4))
        elif r < 0.58:
            kind, w = "phone", pick(("+1 ", "+49 ", "+33-", "+1 ")) + pick(("({}) {}-{}", "{} {} {}", "{}-{}-{}", "({}) {}-{}")).format(digits(3), digits(3), digits(4))
        elif r < 0.70:
            w = pick((f"Version {digits(1)}.{digits(1)}.", digits(4), digits(2) + ":" + digits(2), "password=" + "".join(pick("0123456789abcdef") for _ in range(18)), "AKIA" + "".join(pick("ABCDXYZ0123456789") for _ in range(16)), digits(int(rng.integers(20, 26))), digits(2) + "." + digits(2), "+" + digits(2), "@" + word(), f'"{digits(5)}a{digits(9)}b{digits(4)}"'))
        elif r < 0.8:
            w = w.capitalize() + pick((".", ",", ""))
        if kind:
            w = disguised(rng, kind, w) if rng.random() < 0.35 else w
            spans.append((kind, at, at + len(w)))
        end = pick((" ", " ", " ", ". ", "\n", ", "))
        parts += [w, end]
        at += len(w) + len(end)
    return "".join(parts), spans


def tags_of(n: int, spans: list[Span]) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        y[a:b] = k + 1
        y[a] = k
    return y


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Embedded classes, an LSTM in each direction, emissions, and transitions."""

    def __init__(self, seed: int = 5):
        r, h = np.random.default_rng(seed), HIDDEN
        f = lambda *s, k=0.2: (r.normal(size=s) * k).astype(np.float32)
        self.p = {"xf": f(_CLASSES, 4 * h, k=0.5), "xb": f(_CLASSES, 4 * h, k=0.5), "uf": f(h, 4 * h), "ub": f(h, 4 * h), "w": f(2 * h, _TAGS), "b": f(_TAGS), "t": f(_TAGS, _TAGS, k=0.05), "s": f(_TAGS, k=0.05)}
        for d in "fb":
            self.p["x" + d][:, h : 2 * h] += 1.0  # remember at first

    def _run(self, c: np.ndarray, d: str, keep: bool):
        """States of one direction over c (windows x time), in reading order."""
        h, (n, width) = HIDDEN, c.shape
        x, u = self.p["x" + d], self.p["u" + d]
        s, m = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, saved = np.zeros((width, n, h), np.float32), []
        for t in range(width):
            g = x[c[:, t]] + s @ u
            gate = _sig(g[:, : 3 * h])
            z = np.tanh(g[:, 3 * h :])
            i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
            old, prev = m, s
            m = f * m + i * z
            y = np.tanh(m)
            s = o * y
            out[t] = s
            if keep:
                saved.append((i, f, o, z, old, y, prev))
        return out, saved

    def emissions(self, c: np.ndarray, keep: bool = False):
        f, sf = self._run(c, "f", keep)
        b, sb = self._run(c[:, ::-1], "b", keep)
        states = np.concatenate([f, b[::-1]], 2)
        return states @ self.p["w"] + self.p["b"], states, sf, sb

    def decode(self, c: np.ndarray) -> np.ndarray:
        """Best tags of every window (Viterbi)."""
        e = self.emissions(c)[0]
        width, n, k = e.shape
        score, back = e[0] + self.p["s"], np.zeros((width, n, k), np.int8)
        for t in range(1, width):
            all_ = score[:, :, None] + self.p["t"]
            back[t] = all_.argmax(1)
            score = all_.max(1) + e[t]
        out = np.zeros((n, width), np.int64)
        out[:, -1] = score.argmax(1)
        for t in range(width - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(n), out[:, t]]
        return out

    def gradients(self, c: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        e, states, sf, sb = self.emissions(c, True)
        width, n, k = e.shape
        tr = self.p["t"]
        lse = lambda a, axis: np.log(np.exp(a - a.max(axis, keepdims=True)).sum(axis)) + a.max(axis)
        fw, bw = np.zeros_like(e), np.zeros_like(e)
        fw[0] = e[0] + self.p["s"]
        for t in range(1, width):
            fw[t] = lse(fw[t - 1][:, :, None] + tr, 1) + e[t]
        for t in range(width - 2, -1, -1):
            bw[t] = lse(tr + (e[t + 1] + bw[t + 1])[:, None, :], 2)
        total = lse(fw[-1], 1)
        de = np.exp(fw + bw - total[None, :, None])
        g = {"s": de[0].sum(0), "t": np.zeros_like(tr)}
        for t in range(1, width):
            g["t"] += np.exp(fw[t - 1][:, :, None] + tr + (e[t] + bw[t])[:, None, :] - total[:, None, None]).sum(0)
            np.subtract.at(g["t"], (y[:, t - 1], y[:, t]), 1)
        np.subtract.at(g["s"], y[:, 0], 1)
        de[np.arange(width)[:, None], np.arange(n)[None, :], y.T] -= 1
        g["w"] = np.einsum("tnh,tnk->hk", states, de)
        g["b"] = de.sum((0, 1))
        ds = de @ self.p["w"].T
        h = HIDDEN
        for d, saved, got, cc in (("f", sf, ds[:, :, :h], c), ("b", sb, ds[::-1, :, h:], c[:, ::-1])):
            u, du, dx = self.p["u" + d], np.zeros_like(self.p["u" + d]), np.zeros_like(self.p["x" + d])
            dh, dm = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t in range(width - 1, -1, -1):
                i, f, o, z, old, yy, prev = saved[t]
                dh = dh + got[t]
                dm = dm + dh * o * (1 - yy * yy)
                dg = np.concatenate([dm * z * i * (1 - i), dm * old * f * (1 - f), dh * yy * o * (1 - o), dm * i * (1 - z * z)], 1)
                du += prev.T @ dg
                np.add.at(dx, cc[:, t], dg)
                dh, dm = dg @ u.T, dm * f
            g["u" + d], g["x" + d] = du, dx
        return {k: (v / n).astype(np.float32) for k, v in g.items()}


def windows_of(c: np.ndarray, y: np.ndarray | None = None):
    """Starts of the windows that cover c, STRIDE apart."""
    return list(range(0, max(1, len(c) - STRIDE), STRIDE))


@lru_cache(maxsize=4)
def trained(windows: tuple[str, ...] = (), steps: int = STEPS, seed: int = 5) -> Tagger:
    """The tagger, trained by Adam on labelled spans of documents and of a seeded rule: the same on every run."""
    rng, xs, ys = np.random.default_rng(seed), [], []
    for n in range(EXAMPLES):
        t, spans = lent(rng, windows[n // 2 % len(windows)]) if windows and n % 2 else example(rng)
        c, y = classes(t), tags_of(len(t), spans)
        a = int(rng.integers(0, max(1, len(t) - WINDOW // 2)))
        x, z = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
        part = c[a : a + WINDOW]
        x[: len(part)], z[: len(part)] = part, y[a : a + WINDOW]
        xs.append(x)
        ys.append(z)
    x, y, net = np.stack(xs), np.stack(ys), Tagger(seed)
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        at = rng.integers(0, len(x), BATCH)
        for k, g in net.gradients(x[at], y[at]).items():
            g = np.clip(g, -1, 1)
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            net.p[k] -= 0.03 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)
    return net


def regions(t: str) -> list[tuple[int, int]]:
    """Stretches of t within CONTEXT characters of a digit or an at sign."""
    out: list[list[int]] = []
    for m in _NEAR.finditer(t):
        a, b = max(0, m.start() - CONTEXT), min(len(t), m.start() + CONTEXT + 1)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def network_spans(net: Tagger, texts: list[str]) -> list[list[Span]]:
    """Decoded spans of each text."""
    rows, where, tags = [], [], []
    for d, t in enumerate(texts):
        for a, b in regions(t):
            c = classes(t[a:b])
            k = len(tags)
            tags.append((d, a, np.zeros(b - a, np.int64), np.full(b - a, -1)))
            for s in windows_of(c):
                x = np.zeros(WINDOW, np.int64)
                part = c[s : s + WINDOW]
                x[: len(part)] = part
                rows.append(x)
                where.append((k, s, len(part), s == 0, s + len(part) >= len(c)))
    for i in range(0, len(rows), 2048):
        for got, (k, s, n, first, last) in zip(net.decode(np.stack(rows[i : i + 2048])), where[i : i + 2048], strict=True):
            depth = np.minimum(np.arange(n) + (WINDOW if first else 0), n - 1 - np.arange(n) + (WINDOW if last else 0))
            _, _, y, best = tags[k]
            use = depth > best[s : s + n]
            y[s : s + n][use] = got[:n][use]
            best[s : s + n][use] = depth[use]
    out: list[list[Span]] = [[] for _ in texts]
    for d, a, y, _ in tags:
        kind = (y + 1) // 2
        starts = np.flatnonzero((kind > 0) & ((y % 2 == 1) | (np.concatenate([[0], kind[:-1]]) != kind)))
        for s in starts.tolist():
            e = s + 1
            while e < len(y) and kind[e] == kind[s] and y[e] % 2 == 0:
                e += 1
            x = texts[d][a + s : a + e]
            lead = len(x) - len(x.lstrip(" \t\n\r.,;:"))
            x = x.strip(" \t\n\r.,;:")
            if x:
                out[d].append((KINDS[kind[s] - 1], a + s + lead, a + s + lead + len(x)))
    return out


def _added(t: str, base: list[Span], found: list[Span]) -> list[Span]:
    """Network spans in the extent of their kind's loose shape that pass its tests and overlap no span taken before."""
    taken, out = sorted((a, b) for _, a, b in base), []
    for kind, a, b in found:
        # the span itself if it has the shape, or else what touches it within a few characters, or farther
        for more in (0, 2, CONTEXT):
            near = [m for m in _LOOSE[kind].finditer(t, max(0, a - more), min(len(t), b + more)) if m.start() < b and m.end() > a]
            if any(fits(kind, m[0]) for m in near):
                break
        for m in near:
            x, y = m.span()
            cut = t[max(0, x - 1) : x].isalnum() or t[y : y + 1].isalnum()
            told = kind != "phone" or len(_DIGITS.findall(m[0])) > 2
            if told and not cut and fits(kind, m[0]) and not any(x < d and c < y for c, d in taken):
                out.append((kind, x, y))
                taken.append((x, y))
    return out


def find(texts: list[str], net: Tagger | None = None) -> list[tuple[list[Span], list[Span]]]:
    """(pattern spans, added spans) of each text."""
    near = [i for i, t in enumerate(texts) if _NEAR.search(t)]
    out: list[tuple[list[Span], list[Span]]] = [([], []) for _ in texts]
    found = network_spans(net, [texts[i] for i in near]) if net else [[] for _ in near]
    for i, spans in zip(near, found, strict=True):
        base = pattern_spans(texts[i])
        out[i] = (base, _added(texts[i], base, spans))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def _near_rows(column: pa.Array) -> np.ndarray:
    """Rows whose text holds a digit or an at sign, told from the bytes of the batch, block by block."""
    data, off = text_bytes(column)
    out = [np.zeros(0, np.int64)]
    for a, b in blocks(off):
        d = data[off[a] : off[b]]
        hit = ((d >= 48) & (d <= 57)) | (d == 64)
        hit[2:] |= (d[:-2] == 97) & (d[1:-1] == 116) & ((d[2:] == 41) | (d[2:] == 93))  # at) or at]
        at = np.flatnonzero(hit) + off[a]
        out.append(np.unique(np.searchsorted(off[a : b + 1], at, "right") - 1) + a)
    return np.concatenate(out)


def _per_row(batch: pa.RecordBatch, at: int, net: Tagger | None):
    """(row, text, pattern spans, added spans) of the rows that can have any, 256 at a time."""
    rows = _near_rows(batch.column(at))
    for i in range(0, len(rows), 256):
        part = rows[i : i + 256]
        texts = batch.column(at).take(pa.array(part)).to_pylist()
        for r, t, (base, more) in zip(part.tolist(), texts, find(texts, net), strict=True):
            yield r, t, base, more


def add_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with pii: array of (kind, start, end, added), code points, ends exclusive."""
    net = trained(cut_windows(docs, text=text, doc_id=doc_id))
    cols = [c for c in (docs.columns if keep is None else keep) if c != "pii"]
    sent = docs.select(*[F.col(f"`{c}`") for c in cols], F.col(text).alias("__text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))

    def mapped(batches):
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for r, _, base, more in _per_row(batch, len(cols), net):
                out[r] = [{"kind": k, "start": a, "end": b, "added": x} for s, x in ((base, False), (more, True)) for k, a, b in s]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], pa.array(out, kind)], [*cols, "pii"])

    one = F.array(F.struct(F.lit("").alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(True).alias("added")))
    schema = sent.select(*[F.col(f"`{c}`") for c in cols], one.alias("pii")).schema
    return map_batches(sent, mapped, schema)


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with every span replaced by <KIND>; the columns stay as they are."""
    net, cols = trained(cut_windows(docs, text=text, doc_id=doc_id)), docs.columns
    at = cols.index(text)

    def mapped(batches):
        for batch in batches:
            changed: dict[int, str] = {}
            for r, t, base, more in _per_row(batch, at, net):
                out, done = [], 0
                for k, a, b in sorted([*base, *more], key=lambda s: (s[1], -s[2])):
                    if b <= done:
                        continue
                    out += [t[done:a]] if a > done else []
                    out.append(f"<{k.upper()}>")
                    done = b
                if out:
                    changed[r] = "".join(out) + t[done:]
            column = batch.column(at)
            if changed:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(changed)] = True
                column = pc.replace_with_mask(column, pa.array(mask), pa.array([changed[r] for r in sorted(changed)], column.type))
            yield pa.RecordBatch.from_arrays([column if i == at else batch.column(i) for i in range(len(cols))], cols)

    return map_batches(docs, mapped, docs.schema)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = trained(cut_windows(docs))

    def mapped(batches):
        for batch in batches:
            n = batch.num_rows
            counts, added = np.zeros((n, len(KINDS)), np.int64), np.zeros(n, np.int64)
            sha, spans = [hashlib.sha256(b"").hexdigest()] * n, [""] * n
            for r, _, base, more in _per_row(batch, 1, net):
                for k, _, _ in base:
                    counts[r, KINDS.index(k)] += 1
                added[r] = len(more)
                sha[r], spans[r] = hashlib.sha256(written(base).encode()).hexdigest(), written([*base, *more])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(counts[:, i].copy()) for i in range(len(KINDS))], pa.array(added), pa.array(sha, pa.string()), pa.array(spans, pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "n_added", "base_sha256", "spans"])

    return map_batches(docs, mapped, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_added bigint, base_sha256 string, spans string")
