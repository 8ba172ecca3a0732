"""Conversion of pages, texts and files into labelled items, and structure-aware packing of items into chunks."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import markup
from ..functions.text import TOKEN, tokens

#: Elements that hold no article text.
DROPPED = ("script", "style", "nav", "footer", "aside", "form", "head")
ITEM = r"<(h[1-6]|p|li|td|th|blockquote|pre|dt|dd|figcaption)(?:\s[^>]*)?>([^<]*(?:</?(?:b|i|em|strong|a|span|br|code|sub|sup|u|q|cite)(?:\s[^>]*)?>[^<]*)*)"
LABELS = {"p": "text", "li": "list_item", "td": "table", "th": "table", "blockquote": "text", "pre": "code", "dt": "list_item", "dd": "list_item", "figcaption": "caption"}
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&copy;", "©"), ("&amp;", "&"))


def html_items(pages: DataFrame) -> DataFrame:
    """page_id, item_no, label, text: the items of each page, in page order."""
    html = F.coalesce("html", F.lit(""))
    for tag in DROPPED:
        html = F.regexp_replace(html, rf"(?s)<{tag}[\s>].*?</{tag}>", "")
    html = F.regexp_replace(html, r'(?s)<div class="ad">.*?</div>', "")
    found = pages.select("page_id", html.alias("html")).select("page_id", F.regexp_extract_all("html", F.lit(ITEM), F.lit(1)).alias("tags"), F.regexp_extract_all("html", F.lit(ITEM), F.lit(2)).alias("texts"))
    each = found.select("page_id", F.posexplode(F.arrays_zip("tags", "texts")).alias("item_no", "item"))
    text = F.regexp_replace("item.texts", r"<[^>]*>", " ")
    for ref, char in REFERENCES:
        text = F.replace(text, F.lit(ref), F.lit(char))
    text = F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
    label = F.coalesce(*(F.when(F.col("item.tags") == t, v) for t, v in LABELS.items()), F.concat(F.lit("section_header_"), F.substring("item.tags", 2, 1)))
    return each.select("page_id", "item_no", label.alias("label"), text.alias("text")).where("text <> ''")


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, item_no, label, text: the blocks of each page by its markup, whatever its case and however it is closed
    (functions/markup); null pages have none. html_items is the same for tidy pages, as built-in functions alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [markup.blocks(x.as_py() or "") for x in batch.column(1)]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            cols = [pa.array([k for f in found for k in range(len(f))], pa.int32()), *(pa.array([b[c] for f in found for b in f], pa.string()) for c in (0, 1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cols], names=["page_id", "item_no", "label", "text"])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, item_no int, label string, text string")


def text_items(docs: DataFrame) -> DataFrame:
    """doc_id, item_no, label, text: one item per line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("item_no", "text")).select("doc_id", "item_no", F.lit("text").alias("label"), "text")


#: An item of a converted document: its label, text and pages. section_header_N is a heading of level N.
ITEMS = "array<struct<label: string, text: string, pages: array<int>>>"
TREE = f"struct<items: {ITEMS}>"


def converted(files: DataFrame, converter: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """files with status and tree: what the converter (contents of a batch -> JSON documents) answers. A batch that
    fails is tried file by file, and a file that fails says so in its status and doesn't end the job."""

    def answers(contents: pd.Series) -> list[tuple[str | None, str]]:
        try:
            return [(x, "ok") for x in converter(contents)]
        except Exception as e:  # noqa: BLE001
            if len(contents) == 1:
                return [(None, f"failed: {e}")]
            return [y for i in range(len(contents)) for y in answers(contents.iloc[i : i + 1])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                got = answers(frame["content"])
                yield frame.assign(tree=[g[0] for g in got], status=[g[1] for g in got])

    base = files.drop("tree", "status")
    return base.mapInPandas(run, StructType([*base.schema.fields, *StructType.fromDDL("tree string, status string").fields]))


def tree_items(trees: DataFrame, tree: str = "tree") -> DataFrame:
    """The rows with their items, parsed from the JSON of a converted document; null if it is none."""
    return trees.withColumn("items", F.from_json(tree, TREE, {"mode": "PERMISSIVE"})["items"])


def collected(items: DataFrame, key: str) -> DataFrame:
    """key, items: the items (key, item_no, label, text) of each document as one array, in their order."""
    own = F.array_sort(F.collect_list(F.struct("item_no", "label", "text")))
    return items.groupBy(key).agg(F.transform(own, lambda x: F.struct(x["label"].alias("label"), x["text"].alias("text"), F.array().cast("array<int>").alias("pages"))).alias("items"))


def lines_as_items(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda s: F.struct(F.lit("text").alias("label"), s.alias("text"), F.array().cast("array<int>").alias("pages")))


#: Documents whose items are Python objects at once.
DOCUMENTS = 64
CHUNK = "chunk_index int, total_chunks int, n_tokens long, first_item int, last_item int, headings array<string>, content_types array<string>, page_number int, content string"


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, DOCUMENTS at a time."""
    return (batch.slice(k, DOCUMENTS) for batch in batches for k in range(0, batch.num_rows, DOCUMENTS))


def chunked(docs: DataFrame, limit: int = 128) -> DataFrame:
    """docs (with items) as chunks: their other columns, and those of CHUNK. Items are packed greedily up to limit
    tokens and a longer item stands alone; a heading begins a chunk, and the chunk's headings are the path of those
    above it. Work on each document is its own: nothing is shuffled. Null items make no chunk."""
    other = [c for c in docs.columns if c != "items"]
    sized = docs.select(*other, "items", F.transform("items", lambda x: F.size(tokens(F.coalesce(x["text"], F.lit("")))).cast("long")).alias("_sizes"))
    schema = StructType([*docs.select(*other).schema.fields, *StructType.fromDDL(CHUNK).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.string())
        for batch in few(batches):
            rows, at = [], []
            items, sizes = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
            for i, (own, size) in enumerate(zip(items, sizes)):
                done = _packed(own or [], size or [], limit)
                rows += [(k, len(done), *c) for k, c in enumerate(done)]
                at += [i] * len(done)
            cols = list(zip(*rows)) or [[]] * 9
            kept = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(other))]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(cols, types))], names=schema.names)

    return sized.mapInArrow(run, schema)


def _packed(items: list[dict], sizes: list[int], limit: int) -> list[tuple]:
    """(tokens, first item, last item, headings, content types, first page, content) of each chunk."""
    out, path, own, used = [], [], [], 0

    def close() -> None:
        if own:
            pages = [p for k in own for p in items[k]["pages"] or () if p is not None]
            labels = sorted({"section_header" if (items[k]["label"] or "").startswith("section_header") else items[k]["label"] or "text" for k in own})
            out.append((used, own[0], own[-1], headings, labels, min(pages, default=None), "\n".join(items[k]["text"] or "" for k in own)))

    headings: list[str] = []
    for k, item in enumerate(items):
        label = item["label"] or "text"
        level = int(label[15:]) if label.startswith("section_header_") and label[15:].isdigit() else 0
        if own and (used + sizes[k] > limit or level):
            close()
            own, used = [], 0
        if level:
            path = [x for x in path if x[0] < level]
        if not own:
            headings = [x[1] for x in path]
        if level:
            path.append((level, item["text"] or ""))
        own.append(k)
        used += sizes[k]
    close()
    return out


#: text -> where each of its tokens begins and ends; a model's own tokenizer has this shape.
Spans = Callable[[str], list[tuple[int, int]]]
WORDS = regex.compile(TOKEN)
SENTENCE_END = regex.compile(r"[.!?…。！？]+[\"'»”)\]]*\s+")


def word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in WORDS.finditer(text)]


HYBRID = CHUNK + ", body string"


def hybrid_chunks(docs: DataFrame, limit: int = 128, spans: Spans = word_spans) -> DataFrame:
    """docs (with items) as chunks of limit tokens at most: their other columns, and those of HYBRID.

    Headings are no text of their own but the path of what stands below them; a heading with nothing below it is a
    chunk with an empty body. The content is the path, one heading a line, and then the body; of a path that takes more
    than half of the limit only the innermost headings that don't are shown. What is left of the limit is the body's: a
    longer item is cut after sentences, as many together as fit, and a longer sentence before words, so that its pieces
    put together are the item. Neighbouring pieces under equal headings are joined as long as they fit, those of one
    item as they were, items by a line end. Null and empty items are left out, null lists have no chunks. Work on each
    document is its own: nothing is shuffled. spans may be a model's tokenizer; tokens that overlap or touch are never
    cut apart, so a run of them is kept whole and only then can be over the limit."""
    if limit < 2:
        raise ValueError("a chunk needs two tokens at least")
    other = [c for c in docs.columns if c != "items"]
    schema = StructType([*docs.select(*other).schema.fields, *StructType.fromDDL(HYBRID).fields])
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            rows, at = [], []
            for i, own in enumerate(batch.column(len(other)).to_pylist()):
                done = _hybrid(own or [], limit, spans)
                rows += [(k, len(done), *c) for k, c in enumerate(done)]
                at += [i] * len(done)
            cols = list(zip(*rows)) or [[]] * len(types)
            kept = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(other))]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(cols, types))], names=schema.names)

    return docs.select(*other, "items").mapInArrow(run, schema)


def _cut(text: str, budget: int, spans: Spans) -> list[tuple[int, str]]:
    """(tokens, text) of pieces of budget tokens at most, which are the text if put together."""
    tokens = spans(text)
    if len(tokens) <= budget:
        return [(len(tokens), text)]
    # Where a token may begin a piece, and the best of these places: after the end of a sentence.
    ends = {m.end() for m in SENTENCE_END.finditer(text)}
    fresh = [k for k in range(1, len(tokens)) if tokens[k][0] > tokens[k - 1][1] or text[tokens[k][0]].isspace()]
    opens = [k for k in fresh if any(e in ends for e in range(tokens[k - 1][1], tokens[k][0] + 2))]
    out, first, begin = [], 0, 0
    while first < len(tokens):
        at = len(tokens)
        if at - first > budget:
            after = bisect_right(fresh, first)
            for places in (opens, fresh):
                last = bisect_right(places, first + budget) - 1
                if last >= 0 and places[last] > first:
                    at = places[last]
                    break
            else:
                at = fresh[after] if after < len(fresh) else at
        end = tokens[at][0] if at < len(tokens) else len(text)
        out.append((at - first, text[begin:end]))
        first, begin = at, end
    return out


def _hybrid(items: list[dict], limit: int, spans: Spans) -> list[tuple]:
    """(tokens, first item, last item, headings, content types, first page, content, body) of each chunk."""
    out: list[tuple] = []
    path: list[tuple[int, str, int, list]] = []
    open_: dict | None = None
    bare = False  # whether the innermost heading has nothing below it yet

    def shown(headings: list[str]) -> tuple[int, list[str]]:
        used, kept = 0, []
        for h in reversed(headings):
            n = len(spans(h))
            if used + n > limit // 2:
                break
            used, kept = used + n, [h, *kept]
        return used, kept

    def close() -> None:
        nonlocal open_
        if open_ is not None:
            content = "\n".join([*open_["shown"], *([open_["body"]] if open_["body"] else [])])
            out.append((open_["used"], open_["first"], open_["last"], open_["headings"], sorted(open_["labels"]), min(open_["pages"], default=None), content, open_["body"]))
        open_ = None

    def alone() -> None:
        """The innermost heading as a chunk without body."""
        nonlocal bare
        if bare:
            close()
            headings = [p[1] for p in path]
            used, kept = shown(headings)
            out.append((used, path[-1][2], path[-1][2], headings, ["section_header"], min(path[-1][3], default=None), "\n".join(kept), ""))
        bare = False

    for k, item in enumerate(items):
        label, text = item["label"] or "text", item["text"] or ""
        pages = [p for p in item["pages"] or () if p is not None]
        level = int(label[15:]) if label.startswith("section_header_") and label[15:].isdigit() else 0
        if not text:
            continue
        if level:
            if path and path[-1][0] >= level:
                alone()
            path = [*(p for p in path if p[0] < level), (level, text, k, pages)]
            bare = True
            continue
        bare = False
        headings = [p[1] for p in path]
        used, kept = shown(headings)
        for j, (n, piece) in enumerate(_cut(text, limit - used, spans)):
            if open_ is not None and (open_["headings"] != headings or open_["used"] + n > limit):
                close()
            if open_ is None:
                open_ = {"headings": headings, "shown": kept, "used": used, "first": k, "labels": set(), "pages": [], "body": ""}
            elif j == 0:
                open_["body"] += "\n"
            open_["body"] += piece
            open_["used"] += n
            open_["last"] = k
            open_["labels"].add(label)
            open_["pages"] += pages
    alone()
    close()
    return out
