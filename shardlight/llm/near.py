"""N-gram Jaccard join by parity sketches.

A document is its set of word-shingle hashes; equal sets form a class. Two sets with Jaccard index of at least the
threshold differ in at most k = (1-t)/(1+t) * (sum of sizes) elements. In each size band a set is dealt to more
than k parts and XOR-hashed there: at most k parts differ (pigeonhole), and classes that share the XOR of a part
are candidates. Of k+1+2z parts a set skips its first z empty ones: 1+2z parts are equal, two sets skip 2z of them
at most, and one is left to meet in. A parity sketch, in which every shingle flips one bit, sifts the
candidates, as its Hamming distance is at most the difference of the sets (it grows with the set); the rest is verified on whole sets.

Groups of a shared word are linked without all their pairs: a member is compared with the leader, the member that
shares the most words, of one of its groups, then of another, and then with those of all its groups, twice; after
each round, members that are already connected need no comparison. What is left is compared in blocks of bounded size by the Hamming distance of sketches, and the pairs within the bound are
verified. No link between different components is lost.

Null and empty texts, and texts without words, have an empty set and are linked with nothing; repeated rows are
one class; rows without doc_id link others as any row does, and their component_id is the smallest doc_id that is
known, or null; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_shuffles, mix64, word_hashes, written
from .graph import components

SOLID = np.array([c != 32 and not 9 <= c <= 13 for c in range(256)])
#: Bits of the filter that picks candidate documents in the scan; more candidates make it pass more, never less.
FILTER_BITS = 1 << 23
BLOCK = 512
#: Least and most bits (powers of two) of the parity sketch by which pairs are sifted before their texts meet; between
#: them a set has two bits for each shingle or more.
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 17
#: Whether a member meets the leader of one of its groups only, round by round.
ROUNDS = (True, False)


class Measure:
    """Shingle width and threshold as hundredths."""

    def __init__(self, width: int = 4, hundredths: int = 85):
        self.width, self.t, self.known = width, hundredths, {}
        self.bounds = [1]
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(-(-self.bounds[-1] * 100 // hundredths) + (self.bounds[-1] * 100 % hundredths == 0))

    def shingles(self, text: str | None) -> np.ndarray:
        """Distinct hashes, ascending."""
        w = word_hashes((text or "").encode("utf-8", "surrogatepass").lower(), SOLID)
        k = min(self.width, len(w))
        if not k:
            return w
        total = np.zeros(len(w) - k + 1, np.uint64)
        for j in range(k):
            total += w[j : len(w) - k + 1 + j] * np.uint64((0xD6E8FEB86659FD93 * (2 * j + 1) | 1) & (2**64 - 1))
        return np.unique(mix64(total + np.uint64(k)))

    def name(self, s: np.ndarray) -> int:
        """The class of a set."""
        total = int(s.sum(dtype=np.uint64)) + len(s) * 0x9E3779B97F4A7C15 ^ int(np.bitwise_xor.reduce(mix64(s), initial=np.uint64(0)))
        return int(mix64(np.array([total & (2**64 - 1)], np.uint64))[0].astype(np.int64))

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if 100 * min(len(a), len(b)) < self.t * max(len(a), len(b)):
            return False
        both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
        return 100 * both >= self.t * (len(a) + len(b) - both)

    def bands(self, n: int) -> list[tuple[int, int, int]]:
        """(band, k, z) where a set of n meets others: its own size band, and the next as the smaller set."""
        i = int(np.searchsorted(self.bounds, n, "right")) - 1
        return [(g, *self.parts(g)) for g in (i, i + 1) if self.parts(g)[0]]

    def parts(self, g: int) -> tuple[int, int]:
        """k and z of a band; z is what leaves the fewest sets with more than z empty parts."""
        if g not in self.known:
            k = (100 - self.t) * 2 * (self.bounds[g + 1] - 1) // (100 + self.t)

            def over(z: int) -> float:
                p = k + 1 + 2 * z
                mean = p * math.exp(-self.bounds[max(g - 1, 0)] / p)
                return 1 - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(z + 1))

            self.known[g] = (k, min(range(9), key=lambda z: (round(over(z), 4), z)))
        return self.known[g]

    def sketch(self, s: np.ndarray) -> bytes:
        """Parity bits; each element flips one bit. A sketch folds to one of half its size by XOR of its halves."""
        size = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(s) - 1).bit_length()))
        bits = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
        return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()

    def keys(self, band: int, k: int, z: int, s: np.ndarray) -> np.ndarray:
        """One key for each part that is not skipped."""
        p = k + 1 + 2 * z
        part = ((s >> np.uint64(32)) * np.uint64(p) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        full, empty = np.zeros(p, np.uint64), np.ones(p, bool)
        if len(s):
            full[part[starts]] = np.bitwise_xor.reduceat(s, starts)
            empty[part[starts]] = False
        empty[np.flatnonzero(empty)[z:]] = False
        place = np.arange(p, dtype=np.uint64) + np.uint64(band << 40)
        return mix64(full + mix64(place + np.uint64(1)))[~empty].astype(np.int64)


def _frame(names: list[str], types: list[pa.DataType], cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def sets_of(docs: DataFrame, m: Measure) -> DataFrame:
    """doc_id, cls, n, sketch, tag of every row of (doc_id, text, tag)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(m.name(s), len(s), m.sketch(s)) for s in map(m.shingles, batch.column(1).to_pylist())]
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, batch.column(2)], names=["doc_id", "cls", "n", "sketch", "tag"])

    return docs.mapInArrow(run, "doc_id long, cls long, n long, sketch binary, tag long")


def keys_of(docs: DataFrame, m: Measure) -> DataFrame:
    """(key, cls): the sketch words of each class, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, cls = [], []
            for text in batch.column(0).to_pylist():
                s = m.shingles(text)
                c = m.name(s)
                if c in seen or not len(s):
                    continue
                if len(seen) < 200_000:
                    seen.add(c)
                for band in m.bands(len(s)):
                    keys.append(m.keys(*band, s))
                    cls.append(np.full(len(keys[-1]), c, np.int64))
                if len(keys) >= 2000:
                    yield _frame(["key", "cls"], [pa.int64()] * 2, [np.concatenate(keys), np.concatenate(cls)])
                    keys, cls = [], []
            if keys:
                yield _frame(["key", "cls"], [pa.int64()] * 2, [np.concatenate(keys), np.concatenate(cls)])

    return docs.select("text").mapInArrow(run, "key long, cls long")


def texts_of(docs: DataFrame, wanted: DataFrame, m: Measure) -> DataFrame:
    """(cls, text) of the classes of wanted (cls, tag of one of its texts), which are picked in the scan by a bitmap of
    fixed size; a task reads copies of a text once."""
    spot = F.pmod("tag", F.lit(FILTER_BITS))
    words = wanted.select(spot.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.collect():
        bitmap[r["w"]] = r["bits"]
    bits = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            p, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 0))
            hit = []
            for i in np.flatnonzero((bits.value[p >> 6] >> (p & 63)) & 1):
                if tags[i] not in seen:
                    hit.append(i)
                    if len(seen) < 200_000:
                        seen.add(tags[i])
            own = batch.take(pa.array(hit, pa.int64()))
            cls = [m.name(m.shingles(t)) for t in own.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(cls, pa.int64()), own.column(1)], names=["tag", "cls", "text"])

    picked = docs.select("tag", "text", spot.alias("p")).mapInArrow(run, "tag long, cls long, text string")
    return picked.join(wanted, ["tag", "cls"], "left_semi").dropDuplicates(["cls"]).select("cls", "text")


def verified(pairs: DataFrame, texts: DataFrame, m: Measure) -> DataFrame:
    """The pairs (a, b) that are linked."""
    own = lambda c: texts.select(F.col("cls").alias(c), F.col("text").alias(f"text_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            a, b, ta, tb = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "text_a", "text_b"))
            keep = []
            for i, x in enumerate(a.to_pylist()):
                if x != last:
                    last, known = x, m.shingles(ta[i].as_py())
                if m.linked(known, m.shingles(tb[i].as_py())):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int64())), b.take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return pairs.join(own("b"), "b").join(own("a").hint("merge"), "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def labelled(groups: DataFrame, labels: DataFrame | None) -> DataFrame:
    """groups with the component of each class: that of labels, or itself."""
    if labels is None:
        return groups.withColumn("component", F.col("cls"))
    return groups.join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))


def leaders(members: DataFrame) -> DataFrame:
    """key, lead, own, weight: of each group (key, cls, component) the member that shares most words, its component, and
    how many groups it is in."""
    weight = members.groupBy("cls").agg(F.count(F.lit(1)).alias("weight"))
    best = members.join(weight, "cls").groupBy("key").agg(F.max(F.struct("weight", "cls", "component")).alias("best"))
    return best.select("key", F.col("best.cls").alias("lead"), F.col("best.component").alias("own"), F.col("best.weight").alias("weight"))


def hung(members: DataFrame, lead: DataFrame, once: bool) -> DataFrame:
    """Pairs (a < b) of a leader and each member of another component; if once, of each member with one leader."""
    pairs = members.join(lead, "key").where("component <> own")
    if once:
        pairs = pairs.groupBy("cls").agg(F.max(F.struct("weight", "lead")).alias("best")).select("cls", "best.lead")
    return pairs.select(F.least("lead", "cls").alias("a"), F.greatest("lead", "cls").alias("b")).distinct()


def unsettled(members: DataFrame) -> DataFrame:
    """Members of the groups that still hold more than one component."""
    mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return members.join(mixed, "key", "left_semi")


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch as words, folded to size bytes."""
    w = np.frombuffer(sketch, np.uint64)
    while 8 * len(w) > size:
        w = w[: len(w) // 2] ^ w[len(w) // 2 :]
    return w


def sifted(pairs: DataFrame, sketches: DataFrame, m: Measure) -> DataFrame:
    """The pairs whose sizes and Hamming distance allow a link."""
    own = lambda c: sketches.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (n, x, y) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))):
                size = min(len(x), len(y))
                if int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) * (100 + m.t) <= (100 - m.t) * n:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], names=["a", "b"])

    met = pairs.join(own("a"), "a").join(own("b"), "b").where(100 * F.least("n_a", "n_b") >= m.t * F.greatest("n_a", "n_b"))
    return met.select("a", "b", F.col("n_a") + F.col("n_b"), "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def crossed(rest: DataFrame, sketches: DataFrame, m: Measure) -> DataFrame:
    """Pairs of different components in the same group whose sketches are within the bound.

    Members are dealt to blocks by hash, and each pair of blocks of a group is a group of its own.
    """
    sized = rest.join(rest.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "key").join(sketches, "cls")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = sized.withColumn("own", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "component", "n", "sketch")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        _, i, j = (x.as_py() for x in key)
        cls, own, comp, n = (group.column(c).to_numpy() for c in ("cls", "own", "component", "n"))
        own_sketch = group.column("sketch").to_pylist()
        size = min(map(len, own_sketch))
        sketch = np.array([folded(x, size) for x in own_sketch])
        a, b = [], []
        for x in range(len(cls)):
            others = np.flatnonzero((cls > cls[x]) & (comp != comp[x]) & ((own == own[x]) if i == j else (own != own[x])) & (100 * np.minimum(n, n[x]) >= m.t * np.maximum(n, n[x])))
            apart = np.bitwise_count(sketch[others] ^ sketch[x]).sum(1, dtype=np.int64)
            near = others[apart * (100 + m.t) <= (100 - m.t) * (n[others] + n[x])]
            a.append(np.full(len(near), cls[x]))
            b.append(cls[near])
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in (a, b)], names=["a", "b"])

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def components_of(docs: DataFrame, width: int, hundredths: int) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, tag (of the text), cls, n, component, component_id (its smallest doc_id) of every row; rows with an
    empty set have no component. And the written tables that it reads."""
    m, spark = Measure(width, hundredths), docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tag"))
    free_shuffles(spark)
    sets = written(sets_of(docs, m), "sets")
    ends = Window.partitionBy("key")
    shared = keys_of(docs, m).withColumns({"lo": F.min("cls").over(ends), "hi": F.max("cls").over(ends)}).where("lo <> hi").select("key", "cls").distinct()
    groups = written(shared, "groups")
    del shared
    free_shuffles(spark)
    met = written(groups.select("cls").distinct(), "met")
    wanted = sets.where("n > 0").groupBy("cls").agg(F.min("tag").alias("tag")).join(met, "cls", "left_semi")
    texts = written(texts_of(docs, wanted, m), "texts")
    sketches = sets.where("n > 0").join(met, "cls", "left_semi").dropDuplicates(["cls"]).select("cls", "n", "sketch")
    sketches = written(sketches, "sketches")
    discard(met)
    del wanted
    links = tested = labels = None
    used, rest, before = [], labelled(groups, None), groups
    for once in ROUNDS:
        free_shuffles(spark)
        lead = written(leaders(rest), "leaders")
        pairs = hung(rest, lead, once)
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        near = written(sifted(pairs, sketches, m), "near")
        free_shuffles(spark)
        found = written(verified(near, texts, m), "links")
        used += [pairs, found]
        links = found if links is None else links.unionByName(found)
        free_shuffles(spark)
        old, labels = labels, components(links)
        left = rest.select("key", "cls")
        if not once:  # a leader has met its whole group, and the others go on without it
            left = left.join(lead.select("key", F.col("lead").alias("cls")), ["key", "cls"], "left_anti")
        rest = written(unsettled(labelled(left, labels)), "rest")
        discard(lead, near, before, *([] if old is None else [old]))
        before = rest
    free_shuffles(spark)
    last = written(crossed(rest, sketches, m).join(tested, ["a", "b"], "left_anti"), "crossed")
    found = written(verified(last, texts, m), "links")
    old, labels = labels, components(links.unionByName(found))
    discard(old, last, found, texts, sketches, rest, *used)
    del links, tested, rest, left, pairs
    free_shuffles(spark)
    least = sets.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first")).join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    first = least.groupBy("component").agg(F.min("first").alias("component_id"))
    names = least.select("cls", "component").join(first, "component").select("cls", "component", "component_id")
    named = sets.where("n > 0").select("doc_id", "tag", "cls", "n").join(names, "cls")
    empty = sets.where("n = 0").select("doc_id", "tag", "cls", "n").withColumns({"component": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    return named.unionByName(empty.select(named.columns)), [sets, labels]


def join(docs: DataFrame, width: int = 4, hundredths: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row."""
    return components_of(docs, width, hundredths)[0].select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def kept(docs: DataFrame, width: int = 4, hundredths: int = 85) -> DataFrame:
    """One document of each component, the one of smallest doc_id (one without doc_id only if none has any), with its
    own columns; documents are told apart by doc_id and text. Repeated rows count once, but rows without doc_id and
    words all stay."""
    found, read = components_of(docs.select("doc_id", "text"), width, hundredths)
    named = written(found, "named")
    discard(*read)
    del found
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "cls", "tag")
    leads = named.where("n > 0").groupBy("component").agg(F.min(order).alias("lead")).select(F.col("lead.doc_id").alias("keep_id"), F.col("lead.tag").alias("keep_tag"))
    empty = named.where("n = 0").select(F.col("doc_id").alias("keep_id"), F.col("tag").alias("keep_tag")).distinct()
    keep = written(leads.unionByName(empty), "keep")
    discard(named)
    free_shuffles(named.sparkSession)
    tagged = docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"].alias("own_id"), F.xxhash64(docs["text"]).alias("own_tag"), F.trim(F.regexp_replace(F.coalesce(docs["text"], F.lit("")), "[\\t-\\r]", "")).alias("words"))
    once = tagged.join(keep, tagged["own_id"].eqNullSafe(keep["keep_id"]) & (tagged["own_tag"] == keep["keep_tag"]), "left_semi")
    bare = F.col("own_id").isNull() & (F.col("words") == "")
    again = once.where(~bare).groupBy("own_id", "own_tag").count().where("count > 1").select(F.col("own_id").alias("again_id"), F.col("own_tag").alias("again_tag"))
    if not again.isEmpty():
        more = once["own_id"].eqNullSafe(again["again_id"]) & (once["own_tag"] == again["again_tag"]) & ~bare
        once = once.join(again, more, "left_anti").unionByName(once.join(again, more, "left_semi").dropDuplicates(["own_id", "own_tag"]))
    return once.select(*(F.col("row")[c].alias(c) for c in docs.columns))
