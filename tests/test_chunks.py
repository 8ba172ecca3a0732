"""Chunks within a token limit, against hand-made documents and a slow version of the rules."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from shardlight.functions import text as T
from shardlight.operators import convert
from shardlight.plans import queries
from shardlight.session import SETTINGS

ROW = f"doc_id long, lang string, items {convert.ITEMS}"


def tokens(s):
    return len(regex.findall(r"[\p{L}\p{N}]+", s))


def pieces(text, budget):
    """Again and again the longest beginning that ends after a sentence, or else before a word."""
    out = []
    while tokens(text) > budget:
        starts = [m.start() for m in regex.finditer(r"[\p{L}\p{N}]+", text)]
        cuts = [c for c in starts[1:] if 0 < tokens(text[:c]) <= budget]
        full = [c for c in cuts if regex.search(r"[.!?…。！？]+[\"'»”)\]]*\s+[^\p{L}\p{N}]*$", text[:c])]
        # A sentence's end and its white space stand between the last word and the cut.
        full = [c for c in full if regex.search(r"[.!?…。！？]+[\"'»”)\]]*\s+[^\p{L}\p{N}]*$", text[max(m.end() for m in regex.finditer(r"[\p{L}\p{N}]+", text[:c])) : c])] or full
        cut = max(full or cuts)
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text]


def by_hand(items, limit):
    """[(headings, body, items)], by first writing down all pieces under their paths and then joining neighbours."""
    flat, path, last = [], [], None
    for k, (label, text, _) in enumerate(items):
        if not text:
            continue
        level = int(label.rsplit("_", 1)[1]) if label and label.startswith("section_header_") else 0
        if level:
            if last is not None and path and path[-1][0] >= level:
                flat.append(([p[1] for p in path], None, last))
            path = [p for p in path if p[0] < level] + [(level, text)]
            last = k
        else:
            last = None
            headings = [p[1] for p in path]
            shown = [h for i, h in enumerate(headings) if sum(map(tokens, headings[i:])) <= limit // 2]
            room = limit - sum(map(tokens, shown))
            flat += [(headings, ("\n" if j == 0 else "") + x, k) for j, x in enumerate(pieces(text, room))]
    if last is not None:
        flat.append(([p[1] for p in path], None, last))
    out = []
    for headings, body, k in flat:
        shown = [h for i, h in enumerate(headings) if sum(map(tokens, headings[i:])) <= limit // 2]
        room = limit - sum(map(tokens, shown))
        if body is not None and out and out[-1][0] == headings and out[-1][1] is not None and tokens(out[-1][1]) + tokens(body) <= room:
            out[-1][1] += body
            out[-1][2].append(k)
        else:
            out.append([headings, body if body is None else body.removeprefix("\n"), [k], shown])
    return [(h, b or "", ks, "\n".join([*shown, *([b] if b else [])])) for h, b, ks, shown in out]


def compare(items, got, limit):
    want = by_hand(items, limit)
    assert [(list(r.headings), r.body, r.content) for r in got] == [(h, b, c) for h, b, _, c in want]
    assert [(r.first_item, r.last_item) for r in got] == [(min(ks), max(ks)) for _, _, ks, _ in want]
    assert all(r.n_tokens == tokens(r.content) <= limit for r in got)
    assert [r.chunk_index for r in got] == list(range(len(got))) and all(r.total_chunks == len(got) for r in got)


def some_items(r):
    word = lambda: r.choice(["word", "ünï", "a1", "x"])
    sentence = lambda n: " ".join(word() for _ in range(n)) + r.choice([". ", "! ", "... ", '." ', ", ", "; "])
    out = []
    for k in range(r.randint(0, 12)):
        if r.random() < 0.3:
            out.append((f"section_header_{r.randint(1, 3)}", " ".join(f"H{r.randint(0, 3)}" for _ in range(r.randint(1, 7))), [k]))
        else:
            out.append((r.choice(["text", "table", None]), r.choice(["", None, "!!"]) if r.random() < 0.1 else "".join(sentence(r.randint(1, 20)) for _ in range(r.randint(1, 6))), r.choice([[k], [], [3, 1]])))
    return out


def test_hybrid_chunks_equal_the_slow_version(spark):
    r = random.Random(4)
    docs = [(k, "kept", some_items(r)) for k in range(150)] + [(900, None, None), (901, None, [])]
    frame = spark.createDataFrame(docs, ROW).repartition(3)
    for limit in (2, 7, 12, 40):
        got = {}
        for x in convert.hybrid_chunks(frame, limit).orderBy("doc_id", "chunk_index").collect():
            got.setdefault(x.doc_id, []).append(x)
        for k, _, items in docs:
            compare(items or [], got.get(k, []), limit)


def test_hybrid_chunks_by_hand(spark):
    items = [("section_header_1", "Top", [1]), ("section_header_2", "Empty", [1]), ("section_header_2", "Sub", [2]), ("text", "One two three. Four five six seven! Eight", [2]), ("list_item", "nine", [3]), ("section_header_1", "End", [4])]
    got = convert.hybrid_chunks(spark.createDataFrame([(1, "en", items)], ROW), 6).orderBy("chunk_index").collect()
    assert [(r.content, r.headings, r.content_types, r.page_number) for r in got] == [
        ("Top\nEmpty", ["Top", "Empty"], ["section_header"], 1), ("Top\nSub\nOne two three. ", ["Top", "Sub"], ["text"], 2), ("Top\nSub\nFour five six seven! ", ["Top", "Sub"], ["text"], 2),
        ("Top\nSub\nEight\nnine", ["Top", "Sub"], ["list_item", "text"], 2), ("End", ["End"], ["section_header"], 4)]
    with pytest.raises(ValueError):
        convert.hybrid_chunks(spark.createDataFrame([], ROW), 1)
    long = convert.hybrid_chunks(spark.createDataFrame([(1, "en", [("text", "w " * 1000, [])])], ROW), 128).orderBy("chunk_index").collect()
    assert [r.n_tokens for r in long] == [128] * 7 + [104] and "".join(r.body for r in long) == "w " * 1000


def test_tokens_of_a_model_are_not_cut_apart(spark):
    def spans(text):  # parts of words of three characters, with the blank before them
        return [(m.start() + k, min(m.start() + k + 3, m.end())) for m in regex.finditer(r"\s*\S+", text) for k in range(0, len(m.group()), 3)]

    got = convert.hybrid_chunks(spark.createDataFrame([(1, "en", [("text", "abcdefgh ijk lmnopqrstuvwxyz end", [])])], ROW), 4, spans).orderBy("chunk_index").collect()
    assert [r.body for r in got] == ["abcdefgh", " ijk", " lmnopqrstuvwxyz", " end"]
    assert [r.n_tokens for r in got] == [3, 2, 6, 2]  # a word of six parts is kept whole


def test_pages_as_chunks_equal_the_slow_version(spark):
    d = "/root/testdata/sf0.001"
    items = {r.page_id: r["items"] for r in convert.collected(convert.html_blocks(spark.read.parquet(f"{d}/pages.parquet")), "page_id").collect()}
    got = {}
    for x in queries.conv_html_chunks(spark, d).orderBy("page_id", "chunk_index").collect():
        got.setdefault(x.page_id, []).append(x)
    assert len(items) > 10 and set(got) == set(items)
    for k, own in items.items():
        compare([(x.label, x.text, x.pages) for x in own], got[k], SETTINGS.chunk_max_tokens)
    ids = spark.createDataFrame([("u", 0, "c")], "s string, i int, c string").select(T.chunk_id(F.col("s"), F.col("i"), F.col("c"))).first()[0]
    assert len(ids) == 64 and len({x.id for own in got.values() for x in own}) == sum(map(len, got.values()))
