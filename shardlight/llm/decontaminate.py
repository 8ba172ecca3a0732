"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in document words.

Windows of one length form one matcher over words. Its shift table, keyed by blocks of two words, skips positions
where no window can end; at a block that ends some window, the bucket of that block and of the window's first
block is compared word by word. Documents are never shuffled. The benchmark is loaded in blocks of bounded
size, one mapInArrow after another, so that a task holds one bounded table at a time per worker.

Null text has no words and null items are ignored; items without words have no window; repeated items count once
by item_id; an empty benchmark leaves every document clean; an empty documents table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, docs_of, written

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: Words are runs of digits, letters and non-ASCII; A-Z are lower-cased.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


class WuManber:
    """All occurrences of word windows of one length."""

    def __init__(self, windows: dict[tuple, list]):
        self.m = m = len(next(iter(windows)))
        self.block = b = min(2, m)
        self.windows = windows
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[tuple]]] = {}
        for w in windows:
            for j in range(b, m + 1):
                key = w[j - b : j]
                self.shift[key] = min(self.shift.get(key, m - b + 1), m - j)
            self.buckets.setdefault(w[m - b :], {}).setdefault(w[:b], []).append(w)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple]]:
        """(start, window) of each occurrence."""
        m, n, buckets = self.m, len(words), self.buckets
        i = m - 1
        if self.block == 1:
            for i, w in enumerate(words):
                if (w,) in buckets:
                    yield i, (w,)
            return
        shift, furthest = self.shift.get, m - 1
        while i < n:
            last = (words[i - 1], words[i])
            step = shift(last, furthest)
            if step:
                i += step
                continue
            start = i - m + 1
            for w in buckets[last].get((words[start], words[start + 1]), ()):
                if all(map(bytes.__eq__, w, words[start : i + 1])):
                    yield start, w
            i += 1


def matchers(items: list[tuple], width: int) -> list[WuManber]:
    by_length: dict[int, dict[tuple, list]] = {}
    for item_id, text in items:
        words = words_of(text)
        m = min(width, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            ids = by_length.setdefault(m, {}).setdefault(tuple(words[i : i + m]), [])
            if item_id not in ids[-1:]:
                ids.append(item_id)
    return [WuManber(w) for _, w in sorted(by_length.items())]


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_chars: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    block_chars bounds the benchmark text that one broadcast table is built from.
    """
    return _scan(docs_of(docs), benchmark, width, block_chars)


def kept(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_chars: int = 1_000_000) -> DataFrame:
    """The documents without any window, with their own columns."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(*docs.columns).alias("row"))
    return _scan(own, benchmark, width, block_chars).where(~F.col("contaminated")).select("row.*")


def _scan(docs: DataFrame, benchmark: DataFrame, width: int, block_chars: int) -> DataFrame:
    """docs: doc_id, text and columns that are handed through."""
    spark, carried = docs.sparkSession, docs.columns[2:]
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    chars = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-chars // block_chars))
    out = docs.select("doc_id", "text", F.lit(None).cast("array<int>").alias("at"), F.lit(None).cast("array<string>").alias("ids"), *carried)
    own_schema, more = out.schema, [out.schema[c] for c in carried]
    result = StructType(StructType.fromDDL(RESULT).fields + more)
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else items
        found = spark.sparkContext.broadcast(matchers([(r[0], r[1]) for r in own.collect()], width))
        before, out = out, out.mapInArrow(_searched(found, k == blocks - 1), result if k == blocks - 1 else own_schema)
        if k < blocks - 1:
            out = written(out, "searched")
            found.unpersist()
            if k:
                discard(before)
    return out


def _searched(found, last: bool):
    """at: starts and ends of hit word ranges, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, ats, ids = (batch.column(i).to_pylist() for i in range(4))
            rows = []
            for i, text in enumerate(texts):
                words = words_of(text)
                hits, items = ats[i] or [], set(ids[i] or ())
                for matcher in found.value:
                    for start, window in matcher.search(words):
                        hits += (start, start + matcher.m)
                        items.update(map(str, matcher.windows[window]))
                if last:
                    n_hit = 0
                    if hits:
                        marks = bytearray(len(words))
                        for a, b in zip(hits[::2], hits[1::2]):
                            marks[a:b] = b"\1" * (b - a)
                        n_hit = sum(marks)
                    rows.append((docs[i], len(words), n_hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n_hit > 0))
                else:
                    rows.append((docs[i], text, hits, sorted(items)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()) if last else (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()))
            names = [c.split()[0] for c in RESULT.split(", ")] if last else ["doc_id", "text", "at", "ids"]
            cols = list(zip(*rows)) or [[]] * len(types)
            more = range(4, batch.num_columns)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types)), *map(batch.column, more)], names=[*names, *(batch.schema.names[i] for i in more)])

    return run


_WORD_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH b AS (SELECT item_id, {_WORD_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: list_slice(w, i, i + least(10, len(w)) - 1))) AS win FROM b WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORD_SQL} AS w FROM documents),
dw AS (SELECT rid, m, unnest(range(1, len(w) - m + 2)) AS i, unnest(list_transform(range(1, len(w) - m + 2), lambda i: list_slice(w, i, i + m - 1))) AS win FROM d, (SELECT DISTINCT m FROM bw)),
h AS (SELECT rid, i, dw.m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
n AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS j FROM h) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::varchar AS item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN s USING (rid)
"""
