"""Removal of word passages that occur in an earlier document, by suffix automata of reference shards.

Texts are sequences of words. Documents of equal text form one class, which its smallest doc_id stands for: the later
ones hold nothing but windows of the earliest, and lose all if there are any. Between classes:

1. Each window of `window` words has an anchor, the smallest of its hashes of `window // 2` words, so equal windows
   have equal anchors. A document's distinct anchors are counted over all documents; those of two documents or more
   are shared, and only windows under a shared anchor go on.
2. These windows get a second hash. Grouped by both (128 bits together), each window that two documents hold names its
   earliest document, its reference.
3. A reference's own windows of this kind, as runs of words, are its shard. Runs of other documents' windows that name
   the reference are dealt to it; where they are many, they are dealt among copies of the shard by salt. Each task
   builds the suffix automaton of the shard's words and streams the runs through it: the matching statistic of a word
   is the longest run of words ending there that occurs in the shard, and where it is `window` or more, the window that
   ends there is confirmed, word by word. The covered words go.

So hashes only name whom to compare; what is removed was matched by an automaton or is a whole equal text (by
SHA-256). A document that is a reference is held by one task, as whole texts are; all else is split.

Null texts have no words. Rows without doc_id are no reference and lose nothing, as no doc_id is smaller. Rows that
share a doc_id don't remove each other's words; repeated rows are rows of their own, with equal results. Fewer words
than `window` make no window. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_shuffles, mix64, word_hashes, written

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Runs that go to one copy of a shard.
RUNS = 256
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def spans_of_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end."""
    edge = np.flatnonzero(np.diff(np.r_[False, ~SPACES[raw], False].astype(np.int8)))
    return edge[::2], edge[1::2]


def of_runs(words: np.ndarray, n: int, odd: int) -> np.ndarray:
    """64-bit hashes of each n consecutive words, given theirs."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up = np.cumprod(np.r_[np.uint64(1), np.full(len(words) - 1, odd, np.uint64)], dtype=np.uint64)
    down = np.cumprod(np.r_[np.uint64(1), np.full(len(words) - n, pow(odd, -1, 1 << 64), np.uint64)], dtype=np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum(mix64(words + np.uint64(odd)) * up, dtype=np.uint64)]
    return mix64((sums[n:] - sums[:-n]) * down)


def least_of_each(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n consecutive values, by doubling."""
    if len(x) < n:
        return x[:0]
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == n else np.minimum(x[: len(x) - (n - size)], x[n - size :])


def anchors(words: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window."""
    half = max(1, window // 2)
    return least_of_each(of_runs(words, half, _ODD[0]), window - half + 1)


class Automaton:
    """The suffix automaton of sequences of integers: its states, by transitions, suffix link and longest length."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _copy(self, at: int, w: int, length: int) -> int:
        """A state for the suffixes of at's target that are no longer than length, split off from it."""
        old = self.next[at][w]
        self.next.append(dict(self.next[old]))
        self.link.append(self.link[old])
        self.length.append(length)
        new = self.link[old] = len(self.next) - 1
        while at != -1 and self.next[at].get(w) == old:
            self.next[at][w] = new
            at = self.link[at]
        return new

    def add(self, sequence: list[int]) -> None:
        """Take in one more sequence; matches never cross two of them."""
        last = 0
        for w in sequence:
            to = self.next[last].get(w)
            if to is not None:
                last = to if self.length[to] == self.length[last] + 1 else self._copy(last, w, self.length[last] + 1)
                continue
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            new, at = len(self.next) - 1, last
            while at != -1 and w not in self.next[at]:
                self.next[at][w] = new
                at = self.link[at]
            if at != -1:
                to = self.next[at][w]
                self.link[new] = to if self.length[to] == self.length[at] + 1 else self._copy(at, w, self.length[at] + 1)
            last = new

    def matched(self, sequence: list[int]) -> list[int]:
        """For each element, the length of the longest run ending there that some taken sequence holds."""
        out, state, n = [], 0, 0
        for w in sequence:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            else:
                n = 0
            out.append(n)
        return out


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true flags begin and end."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edge[::2], edge[1::2]


def covered(first: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in an interval."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def described(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, digest (of the text), n_words, own_sha256 (of the words, joined), anchors (distinct) of each row."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    schema = "doc_id long, digest binary, n_words long, own_sha256 string, anchors array<long>"

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text in batch.column(1):
                raw = text.as_py()
                words = word_hashes(raw, ~SPACES)
                cols[0].append(hashlib.sha256(raw).digest())
                cols[1].append(len(words))
                cols[2].append(hashlib.sha256(b" ".join(raw.split())).hexdigest())
                cols[3].append(np.unique(anchors(words, window)).view(np.int64))
            types = (pa.binary(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "digest", "n_words", "own_sha256", "anchors"])

    return texts.mapInArrow(describe, schema)


def windows_of(shared: DataFrame, window: int) -> DataFrame:
    """doc, part, anchor, hash, at (places): the different windows of documents (doc, part, text, shared anchors) under
    these anchors."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = word_hashes(batch.column(2)[k].as_py(), ~SPACES)
                anchor = anchors(words, window)
                at = np.flatnonzero(np.isin(anchor, batch.column(3)[k].values.to_numpy(zero_copy_only=False).view(np.uint64)))
                own = of_runs(words, window, _ODD[1])[at]
                order = np.lexsort((own, anchor[at]))
                at, own = at[order], own[order]
                new = np.flatnonzero(np.r_[True, (np.diff(own) != 0) | (np.diff(anchor[at]) != 0)][: len(at)])
                one = np.ones(len(new), np.int64)
                cols = [one * batch.column(0)[k].as_py(), one * batch.column(1)[k].as_py(), anchor[at[new]].view(np.int64), own[new].view(np.int64)]
                places = pa.ListArray.from_arrays(pa.array(np.r_[new, len(at)], pa.int32()), pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), places], names=["doc", "part", "anchor", "hash", "at"])

    return shared.select("doc", "part", "text", "anchors").mapInArrow(make, "doc long, part long, anchor long, hash long, at array<int>")


def runs_of(named: DataFrame, window: int) -> DataFrame:
    """reference, query (false: of the reference itself), doc, part, first, words (joined): maximal runs of windows
    with one reference, from documents (doc, part, text, and by window its places, at, and its reference, to)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc, part, raw = (batch.column(c)[k].as_py() for c in range(3))
                words = raw.split()
                places, to = batch.column(3)[k].values, batch.column(4)[k].values.to_numpy(zero_copy_only=False)
                at, to = places.flatten().to_numpy(zero_copy_only=False), np.repeat(to, places.value_lengths().to_numpy(zero_copy_only=False))
                order = np.argsort(at, kind="stable")
                at, to = at[order], to[order]
                edge = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(to) != 0), True])
                first, last, names = at[edge[:-1]], at[edge[1:] - 1], to[edge[:-1]]
                cols = [names, names != doc, np.full(len(first), doc), np.full(len(first), part), first.astype(np.int32), [b" ".join(words[a : b + window]) for a, b in zip(first.tolist(), last.tolist())]]
                types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["reference", "query", "doc", "part", "first", "words"])

    return named.select("doc", "part", "text", "at", "to").mapInArrow(cut, "reference long, query boolean, doc long, part long, first int, words binary")


def confirmed(dealt: DataFrame, window: int) -> DataFrame:
    """doc, part, first, end: the words that automata confirm as covered. dealt: runs with salt, those of a reference
    and salt together, the shard's before the others."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, automaton, ids = None, Automaton(), {}
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for reference, salt, query, doc, part, first, words in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (reference, salt):
                    key, automaton, ids = (reference, salt), Automaton(), {}
                if not query:
                    automaton.add([ids.setdefault(w, len(ids)) for w in words.split(b" ")])
                    continue
                length = np.array(automaton.matched([ids.get(w, -1) for w in words.split(b" ")]))
                for a, b in zip(*runs(length >= window)):
                    out.append((doc, part, first + int(a) - window + 1, first + int(b)))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc", "part", "first", "end"])

    return dealt.select("reference", "salt", "query", "doc", "part", "first", "words").mapInArrow(stream, "doc long, part long, first int, end int")


def kept_words(texts: DataFrame) -> DataFrame:
    """doc, part, n_removed, kept_sha256, kept (the words left, joined) of documents (doc, part, text, firsts, ends)."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], []]
            for text, firsts, ends in zip(*(batch.column(c) for c in (2, 3, 4))):
                words = text.as_py().split()
                gone = covered(firsts.values.to_numpy(zero_copy_only=False), ends.values.to_numpy(zero_copy_only=False), len(words))
                kept = b" ".join(words[k] for k in np.flatnonzero(~gone).tolist())
                for c, v in zip(cols, (int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string())))], names=["doc", "part", "n_removed", "kept_sha256", "kept"])

    return texts.select("doc", "part", "text", "firsts", "ends").mapInArrow(keep, "doc long, part long, n_removed long, kept_sha256 string, kept string")


def remove(docs: DataFrame, window: int = 50, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text of each row."""
    spark = docs.sparkSession
    rows = written(described(docs, window), "described")
    able = rows.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    part = F.xxhash64("digest").alias("part")
    classes = able.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("anchors").alias("anchors"))
    classes = written(classes.select("digest", "doc", part, "anchors"), "classes")

    # Anchors of two documents, and the texts that hold some.
    each = classes.select("doc", "part", F.explode("anchors").alias("anchor"))
    common = each.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("anchor")
    common = written(common, "common")
    free_shuffles(spark)
    mine = written(each.join(common, "anchor").groupBy("doc", "part").agg(F.collect_list("anchor").alias("anchors")), "anchored")
    discard(common)
    free_shuffles(spark)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("part", F.xxhash64(F.unhex(F.sha2("text", 256))))
    shared = written(texts.join(mine, ["doc", "part"]).dropDuplicates(["doc", "part"]).select("doc", "part", "text", "anchors"), "shared")
    discard(mine)
    free_shuffles(spark)

    # Windows of two documents, and their references.
    windows = written(windows_of(shared, window), "windows")
    names = windows.groupBy("anchor", "hash").agg(F.min("doc").alias("to"), F.max("doc").alias("b")).where("to < b").select("anchor", "hash", "to")
    names = written(names, "names")  # so that the join can split a window of very many documents
    free_shuffles(spark)
    named = windows.join(names, ["anchor", "hash"]).groupBy("doc", "part").agg(F.collect_list("at").alias("at"), F.collect_list("to").alias("to"))
    cut = written(runs_of(shared.select("doc", "part", "text").join(named, ["doc", "part"]), window), "runs")
    discard(windows)
    discard(names)
    free_shuffles(spark)

    # Shards meet the runs that name them.
    asked, own = cut.where("query"), cut.where("not query")
    salts = asked.groupBy("reference").agg(F.ceil(F.count(F.lit(1)) / RUNS).cast("int").alias("salts"))
    some = asked.join(salts, "reference").withColumn("salt", F.pmod(F.xxhash64("doc", "part", "first"), F.col("salts")).cast("int"))
    copies = own.join(salts, "reference").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    dealt = some.unionByName(copies).repartition("reference", "salt").sortWithinPartitions("reference", "salt", "query", "doc", "part", "first")
    gone = confirmed(dealt, window).groupBy("doc", "part").agg(F.collect_list("first").alias("firsts"), F.collect_list("end").alias("ends"))
    kept = kept_words(shared.select("doc", "part", "text").join(gone, ["doc", "part"]))
    kept = written(kept if keep_text else kept.drop("kept"), "kept")
    discard(cut)
    discard(shared)

    # Every row: of the earliest of its class what is kept, of later ones nothing.
    lead = classes.select("digest", "doc", "part")
    found = rows.drop("anchors").join(lead, "digest", "left").join(kept, ["doc", "part"], "left")
    later = F.coalesce((F.col("doc_id") > F.col("doc")) & (F.col("n_words") >= window), F.lit(False))
    first = F.coalesce((F.col("doc_id") == F.col("doc")) & F.col("n_removed").isNotNull(), F.lit(False))
    pick = lambda a, b, c: F.when(later, a).when(first, b).otherwise(c)
    out = found.select("doc_id", "digest", "n_words", pick(F.col("n_words"), F.col("n_removed"), F.lit(0).cast("long")).alias("n_removed"), pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept_sha256"), F.col("own_sha256")).alias("kept_sha256"), *([pick(F.lit(""), F.col("kept"), F.lit(None).cast("string")).alias("kept_text")] if keep_text else []))
    if not keep_text:
        return out.drop("digest")
    # Rows that lose nothing keep their words.
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("t")).select(F.unhex(F.sha2("t", 256)).alias("digest"), F.regexp_replace(F.regexp_replace(F.col("t").cast("string"), r"[ \t-\r]+", " "), r"^ | $", "").alias("whole"))
    return out.join(whole.dropDuplicates(["digest"]), "digest", "left").withColumn("kept_text", F.coalesce("kept_text", "whole")).drop("digest", "whole")


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS MATERIALIZED (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL)),
f AS (SELECT h, min(doc_id) AS least FROM p GROUP BY h),
g AS MATERIALIZED (SELECT DISTINCT r, unnest(range(i, i + 50)) AS i FROM p JOIN f USING (h) WHERE least < doc_id),
k AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN g USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, (len(w) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
