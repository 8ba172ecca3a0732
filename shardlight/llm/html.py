"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks, runs of text between block-level tags. A block has features of its ancestor tags,
the words in their class, id and role, and its own text. The field (one weight per feature for "article", a weight
per pair of neighbouring labels) is trained by stochastic gradients of the exact likelihood on labelled pages, and
a page's labels are the Viterbi path. Blocks labelled "article" are joined by line ends.

Null html is empty; a page without text or article blocks gives an empty text; unclosed tags, comments and
scripts run to the page's end; repeated rows are extracted each; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled_pages import Page

RESULT = "page_id long, url string, text string, n_chars long"
_PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
CLOSED_BY = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Tags that a start tag of CLOSED_BY does not look beyond.
WALLS = frozenset("ul ol dl table div section article aside main nav header footer form body td th blockquote".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: path of (tag, names), text with references decoded and white space as one blank."""
    found: list[Block] = []
    stack: list[tuple[str, tuple]] = []
    parts: list[str] = []
    linked = links = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(tuple(x for x in stack if x[0] not in INLINE or x[1]), text, linked))
            parts.clear()
        linked = 0

    def cut(at: int) -> None:
        nonlocal links
        links -= sum(x[0] == "a" for x in stack[at:])
        del stack[at:]

    at = 0
    for m in _PART.finditer(page):
        if m.start() > at:
            text = page[at : m.start()]
            parts.append(html.unescape(text) if "&" in text else text)
            if links:
                linked += len(text)
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag = tag.lower()
        if m[2] or m[5]:
            if tag not in INLINE:
                close()
            elif tag == "br":
                parts.append(" ")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    cut(k)
                    break
                if tag in INLINE and stack[k][0] in WALLS:
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            close()
            ends = ("p",) if tag in CLOSES_P else ()
            ends = (*ends, *CLOSED_BY.get(tag, ()))
            if ends:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        cut(k)
                        break
                    if stack[k][0] in WALLS:
                        break
        if tag not in VOID:
            attributes = m[4] or m[7] or ""
            names = tuple(sorted({w for x in _NAMES.findall(attributes) for w in _WORD.findall("".join(x).lower())})) if "=" in attributes else ()
            stack.append((tag, names))
            links += tag == "a"
    if at < len(page):
        text = page[at:]
        parts.append(html.unescape(text) if "&" in text else text)
        if links:
            linked += len(text)
    close()
    return found


def features(found: list[Block]) -> list[list[str]]:
    out, known = [], {}
    for k, b in enumerate(found):
        if b.path not in known:
            tags = [t for t, _ in b.path]
            own = tags[-1] if tags else "none"
            inside = {f"in={t}" for t in tags[:-1]} | {f"name={w}" for _, names in b.path for w in names}
            order = [t for t in tags if t in ("article", "main", "aside", "nav", "header", "footer", "form", "section")]
            known[b.path] = [f"own={own}", f"last={order[-1] if order else 'none'}", f"under={tags[-2] if len(tags) > 1 else 'none'}", *sorted(inside)]
        n = len(b.text)
        share = b.linked / n
        out.append(known[b.path] + ["bias", f"size={min(8, n.bit_length())}", f"link={'all' if share > 0.8 else 'some' if share > 0.2 else 'few'}", f"stop={b.text[-1] in '.!?:'}", f"first={k == 0}"])
    return out


class Field:
    """Weights of a two-label chain: emit[f] for label 1, move[a, b] for neighbours."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.emit = np.zeros(0)
        self.move = np.zeros((2, 2))

    def emission(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), 2))
        for k, row in enumerate(rows):
            out[k, 1] = sum(self.emit[i] for f in row if (i := self.known.get(f)) is not None)
        return out

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 8, rate: float = 0.3, decay: float = 2e-4) -> None:
        for rows, _ in pages:
            for row in rows:
                for f in row:
                    self.known.setdefault(f, len(self.known))
        self.emit = np.zeros(len(self.known))
        ge, gm = np.full(len(self.known), 1e-4), np.full((2, 2), 1e-4)
        order = np.random.default_rng(3)
        pages = [([np.array([self.known[f] for f in row]) for row in rows], np.array(y)) for rows, y in pages if rows]
        for _ in range(epochs):
            for p in order.permutation(len(pages)):
                rows, y = pages[p]
                n = len(rows)
                e = np.zeros((n, 2))
                e[:, 1] = [self.emit[r].sum() for r in rows]
                fore, back = np.zeros((n, 2)), np.zeros((n, 2))
                fore[0] = e[0]
                for k in range(1, n):
                    fore[k] = e[k] + np.logaddexp(fore[k - 1, 0] + self.move[0], fore[k - 1, 1] + self.move[1])
                for k in range(n - 2, -1, -1):
                    x = e[k + 1] + back[k + 1]
                    back[k] = np.logaddexp(self.move[:, 0] + x[0], self.move[:, 1] + x[1])
                z = np.logaddexp(*fore[-1])
                wrong = np.exp(fore[:, 1] + back[:, 1] - z) - y
                pair = np.exp(fore[:-1, :, None] + self.move[None] + (e + back)[1:, None, :] - z).sum(0)
                np.subtract.at(pair, (y[:-1], y[1:]), 1)
                i = np.concatenate(rows)
                d = np.bincount(i, np.repeat(wrong, [len(r) for r in rows]), len(self.emit))
                kinds = np.unique(i)
                d = d[kinds] + decay * self.emit[kinds]
                ge[kinds] += d**2
                self.emit[kinds] -= rate * d / np.sqrt(ge[kinds])
                pair += decay * self.move
                gm += pair**2
                self.move -= rate * pair / np.sqrt(gm)

    def viterbi(self, rows: list[list[str]]) -> list[int]:
        if not rows:
            return []
        (a00, a01), (a10, a11) = self.move.tolist()
        back, (s0, s1) = [], (0.0, 0.0)
        for k, (_, e) in enumerate(self.emission(rows).tolist()):
            if k:
                b0, b1 = s0 + a00 < s1 + a10, s0 + a01 < s1 + a11
                back.append((b0, b1))
                s0, s1 = (s1 + a10 if b0 else s0 + a00), (s1 + a11 if b1 else s0 + a01) + e
            else:
                s0, s1 = 0.0, e
        path = [int(s1 > s0)]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def trained(n_pages: int = 1200, seed: int = 0) -> Field:
    """A field fitted on n_pages labelled pages."""
    field, pages = Field(), []
    for k in range(n_pages):
        page = Page(seed * 1_000_003 + k)
        found = blocks(page.html)
        if len(found) == len(page.labels):
            pages.append((features(found), page.labels))
    field.fit(pages)
    return field


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, y in zip(found, field.viterbi(features(found))) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    model = pages.sparkSession.sparkContext.broadcast(field or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, model.value) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url"), F.col("html")).mapInArrow(run, RESULT)
