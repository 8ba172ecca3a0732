"""Removal of repeated substrings: every byte that a 200-byte string covers which also starts elsewhere.

Equal strings of ``span`` bytes hold the same anchor, the leftmost 32-byte gram of least hash in them, at the same
place. A document's starts are cut into runs of one anchor; a run's context is the bytes its strings cover. Runs
are matched by (anchor, context) hashes: equal contexts repeat as a whole. Of the other runs of a repeated anchor
the contexts are sorted from the anchor rightward and leftward by a hash-compared suffix sort (a merge sort whose
comparisons find the common extension by binary search on prefix polynomial hashes, verified on the bytes); two
strings are equal where they share both extensions. An anchor with very many different contexts is not gathered but
split: strings whose distances to the anchor fall in one block share the bytes that all of the block have in common,
which make the block an anchor of its own, with contexts that are shorter and repeat more often. What is still large
is split into smaller blocks, of one string at last; the sort is the same at every level.

Text is taken as UTF-8, null as empty. Strings are judged on the input; documents under ``span`` bytes lose
nothing; repeated rows repeat each other; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Powers, discard, docs_of, free_shuffles, mix64, written

GRAM = 32
#: Starts that are hashed at once.
CHUNK = 1 << 18
#: Different contexts of an anchor that are sorted in one task; an anchor with more is split into blocks of distances.
MOST = 4096
BLOCKS = (32, 8, 2, 1)
FILTER_BITS = 1 << 23
FIRST, SECOND = Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)
U = np.uint64


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, for what is made of each to be small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def blob_of(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def prefix(raw: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomial hashes and the inverse powers that shift them to 0."""
    up, down = powers.get(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + U(1)) * up[:-1], out=sums[1:])
    return sums, down


def runs(raw: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, ...]]:
    """anchor hash, context hash, first start, last start, anchor place: of each run of starts, chunk by chunk."""
    for base in range(0, len(raw) - span + 1, CHUNK):
        own = raw[base : base + CHUNK + span - 1]
        n = len(own) - span + 1
        sums, down = prefix(own, FIRST)
        gram = mix64((sums[GRAM:] - sums[:-GRAM]) * down[: len(own) - GRAM + 1])
        low = (gram & ~U((1 << 24) - 1)) | np.arange(len(gram), dtype=np.uint64)
        width, wide = 1, span - GRAM + 1
        while 2 * width <= wide:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:n], low[wide - width : wide - width + n])
        place = (low & U((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.r_[first[1:], n] - 1
        at = place[first]
        sums2, down2 = prefix(own, SECOND)
        end = last + span
        context = mix64((sums[end] - sums[first]) * down[first]) ^ mix64((sums2[end] - sums2[first]) * down2[first] + (at - first).astype(np.uint64) * U(0x2545F4914F6CDD1D) + (end - first).astype(np.uint64))
        yield gram[at].astype(np.int64), context.astype(np.int64), first + base, last + base, at + base


def anchors(docs: DataFrame, span: int) -> DataFrame:
    """a, c, blob, at, vote: the runs of each text. A task emits a text twice at most: more copies change nothing.

    vote is false where the task has already seen two runs of this anchor and context: such a run surely repeats,
    and others need not count it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        often = np.zeros(0, np.uint64)
        for batch in sliced(batches):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for text in batch.column(0).to_pylist():
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) < span:
                    continue
                blob = blob_of(raw)
                times = seen.get(blob, 0)
                if times == 2:
                    continue
                if times or len(seen) < 200_000:
                    seen[blob] = times + 1
                for a, c, first, last, place in runs(np.frombuffer(raw, np.uint8), span):
                    for o, v in zip(out, (a, c, np.full(len(a), blob, np.int64), first << 20 | (last - first) << 10 | place - first)):
                        o.append(v)
            cols = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
            key = mix64(cols[0].view(np.uint64)) ^ cols[1].view(np.uint64)
            kinds, at, n = np.unique(key, return_inverse=True, return_counts=True)
            order = np.argsort(at, kind="stable")
            nth = np.empty(len(key), np.int64)
            nth[order] = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
            vote = (nth < 2) & ~np.isin(kinds, often)[at]
            if len(often) < 200_000:
                often = np.union1d(often, kinds[n > 1])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(vote)], names=["a", "c", "blob", "at", "vote"])

    return docs.select("text").mapInArrow(run, "a long, c long, blob long, at long, vote boolean")


def hot_anchors(docs: DataFrame, span: int, sample: int = 2000) -> list[int]:
    """Anchors in over a hundredth of a sample of texts. They only decide how rows are dealt out, not the result."""
    n = docs.count()
    share = min(1.0, sample / max(1, n))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    return [r["a"] for r in anchors(some, span).groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(16, sample * min(share, 1.0) // 100)).limit(10_000).collect()]


def bitmap_of(blobs: DataFrame) -> np.ndarray:
    """A fixed number of bits, set where a blob of the frame falls."""
    spot = F.col("blob").bitwiseAND(FILTER_BITS - 1)
    words = blobs.select(spot.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.collect():
        out[r["w"]] = r["bits"]
    return out


def passes(bitmap: np.ndarray, blob: int) -> bool:
    p = blob & (FILTER_BITS - 1)
    return bool(int(bitmap[p >> 6]) >> (p & 63) & 1)


class Text:
    """Contexts in one buffer with prefix hashes, for comparisons of parts of it."""

    def __init__(self, buffer: np.ndarray):
        self.raw = np.r_[buffer, np.uint8(0)]
        self.sums, self.down = prefix(buffer, FIRST)

    def same(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.sums[x + n] - self.sums[x]) * self.down[x] == (self.sums[y + n] - self.sums[y]) * self.down[y]

    def common(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension from x and y, by binary search on hashes."""
        lo, hi = np.zeros_like(most), most.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self.same(x, y, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, equal: bool) -> np.ndarray:
        """Whether x sorts before y (or with it, if equal)."""
        most = np.minimum(nx, ny)
        n = self.common(x, y, most)
        over = n == most
        return np.where(over, (nx <= ny) if equal else (nx < ny), self.raw[x + np.where(over, 0, n)] < self.raw[y + np.where(over, 0, n)])


def suffix_order(text: Text, group: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge sort of the suffixes (start, size) within each group (ascending numbers); the order, and each one's
    common extension with the one before it (-1 for the first of its group), verified on the bytes."""
    n = len(group)
    order = np.arange(n)
    head = np.flatnonzero(np.diff(group, prepend=-1))
    many = np.diff(np.r_[head, n])
    base, total = np.repeat(head, many), np.repeat(many, many)
    place = np.arange(n) - base
    width = 1
    while width < many.max(initial=1):
        live = np.flatnonzero(total > width)
        mine, i = place[live] // width, place[live]
        left = mine % 2 == 0
        sibling = np.where(left, mine + 1, mine - 1) * width
        begin = base[live] + np.minimum(sibling, total[live])
        stop = base[live] + np.minimum(sibling + width, total[live])
        lo, hi = begin.copy(), stop.copy()
        e = order[live]
        while (lo < hi).any():
            act = np.flatnonzero(lo < hi)
            mid = (lo[act] + hi[act]) // 2
            x, y = order[mid], e[act]
            before = np.where(left[act], text.less(start[x], size[x], start[y], size[y], False), text.less(start[x], size[x], start[y], size[y], True))
            lo[act], hi[act] = np.where(before, mid + 1, lo[act]), np.where(before, hi[act], mid)
        to = base[live] + np.where(left, i, i - width) + lo - begin
        order[to] = e
        width *= 2
    x, y = order[:-1], order[1:]
    most = np.where(group[x] == group[y], np.minimum(size[x], size[y]), 0)
    shared = text.common(start[x], start[y], most)
    longest = int(shared.max(initial=0))
    for at in range(0, n - 1, 1024):
        s = slice(at, at + 1024)
        step = np.arange(longest)
        inside = step < shared[s, None]
        bad = inside & (text.raw[start[x[s], None] + step * inside] != text.raw[start[y[s], None] + step * inside])
        if bad.any():  # two texts with one hash: sort by the bytes
            key = sorted(range(n), key=lambda k: (group[k], text.raw[start[k] : start[k] + size[k]].tobytes()))
            order = np.array(key)
            x, y = order[:-1], order[1:]
            most = np.where(group[x] == group[y], np.minimum(size[x], size[y]), 0)
            shared = np.array([next((k for k in range(m) if text.raw[start[p] + k] != text.raw[start[q] + k]), m) for p, q, m in zip(x, y, most)], np.int64)
            break
    return order, np.r_[-1, np.where(group[x] == group[y], shared, -1)]


def repeated_starts(group: np.ndarray, contexts: list[bytes], left: np.ndarray, last: np.ndarray, span: int) -> np.ndarray:
    """(contexts, starts) booleans: which strings of a context another context of its group has at its anchor too.

    left: the anchor's place in the context; last: the last start. Strings at the same distance from the anchor
    are equal if their contexts share distance bytes leftward and span less distance bytes rightward.
    """
    size = np.array([len(c) for c in contexts])
    ends = np.cumsum(size)
    anchor = ends - size + left
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    ahead, r_shared = suffix_order(Text(raw), group, anchor, ends - anchor)
    back, l_shared = suffix_order(Text(raw[::-1].copy()), group, len(raw) - anchor, left)
    out = np.zeros((len(contexts), int(last.max()) + 1), bool)
    r_class, l_class = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
    for d in range(int((left - last).min()), int(left.max()) + 1):
        own = np.flatnonzero((d <= left) & (d >= left - last))
        if len(own) < 2:
            continue
        r_class[ahead] = np.cumsum(r_shared < span - d)
        l_class[back] = np.cumsum(l_shared < d)
        key = r_class[own] * (len(group) + 1) + l_class[own]
        order = np.argsort(key, kind="stable")
        equal = key[order][1:] == key[order][:-1]
        hit = own[order[np.r_[equal, False] | np.r_[False, equal]]]
        out[hit, left[hit] - d] = True
    return out


def _ranges(blob: int, starts: np.ndarray, span: int) -> list[tuple[int, int, int]]:
    """Byte ranges that strings at the ascending starts cover; consecutive starts together."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return [(blob, int(a), int(b) + span) for a, b in zip(np.r_[starts[:1], starts[cut + 1]], np.r_[starts[cut], starts[-1:]])]


CONTEXTS = "a long, blob long, first long, left int, last int, context binary"


def _contexts(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 6
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[c.split()[0] for c in CONTEXTS.split(", ")])


def contexts_of(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """a, blob, first, left, last, context: of the runs listed in wanted (blob, runs)."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in sliced(batches):
            blobs, texts = [], []
            for text in batch.column(0).to_pylist():
                raw = text.encode("utf-8", "surrogatepass")
                blob = blob_of(raw)
                if len(raw) >= span and passes(bits.value, blob) and blob not in seen:
                    if len(seen) < 200_000:
                        seen.add(blob)
                    blobs.append(blob)
                    texts.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.int64()), pa.array(texts, pa.binary())], names=["blob", "raw"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for blob, raw, listed in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("blob", "raw", "runs"))):
                text = raw.as_py()
                for r in listed.as_py():
                    first, last, left = r["at"] >> 20, r["at"] >> 10 & 1023, r["at"] & 1023
                    rows.append((r["a"], blob.as_py(), first, left, last, text[first : first + last + span]))
            yield _contexts(rows)

    texts = docs.select("text").mapInArrow(scan, "blob long, raw binary")
    once = texts.join(wanted.hint("merge"), "blob")
    return once.mapInArrow(fetch, CONTEXTS)


def sorted_ranges(contexts: DataFrame, span: int) -> DataFrame:
    """blob, start, end: the ranges that repeated strings cover, from contexts that are few at each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(t: pa.Table) -> pa.RecordBatch:
            a, blob, first, left, last = (t.column(c).to_numpy().astype(np.int64) for c in ("a", "blob", "first", "left", "last"))
            keep = np.r_[a[1:] == a[:-1], False] | np.r_[False, a[1:] == a[:-1]]
            rows: list[tuple[int, int, int]] = []
            if keep.any():
                at = np.flatnonzero(keep)
                group = np.cumsum(np.diff(a[at], prepend=a[at][0]) != 0)
                hits = repeated_starts(group, t.column("context").take(pa.array(at)).to_pylist(), left[at], last[at], span)
                for i in np.flatnonzero(hits.any(1)):
                    rows += _ranges(int(blob[at[i]]), first[at[i]] + np.flatnonzero(hits[i]), span)
            cols = list(zip(*rows)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["blob", "start", "end"])

        held = None
        for batch in sliced(batches):
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if len(held) < 4_000:
                continue
            a = held.column("a").to_numpy()
            cut = int(np.searchsorted(a, a[-1]))  # the last anchor's rows may go on
            if cut:
                yield solved(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None and len(held):
            yield solved(held.combine_chunks())

    return contexts.repartition("a").sortWithinPartitions("a").select("a", "blob", "first", "left", "last", "context").mapInArrow(run, "blob long, start long, end long")


def blocks_of(contexts: DataFrame, span: int, width: int) -> DataFrame:
    """The same contexts by blocks of width distances; a block's anchor is named by its old one and the bytes that
    all its strings hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for a, blob, first, left, last, context in zip(*(batch.column(c).to_pylist() for c in range(6))):
                for k in range((left - last) // width, left // width + 1):
                    low, high = max(left - last, k * width), min(left, (k + 1) * width - 1)
                    core = context[left - k * width : left + span - (k + 1) * width + 1]
                    name = blob_of(a.to_bytes(8, "little", signed=True) + k.to_bytes(2, "little") + core)
                    rows.append((name, blob, first + left - high, high, high - low, context[left - high : left - low + span]))
            yield _contexts(rows)

    return contexts.select("a", "blob", "first", "left", "last", "context").mapInArrow(run, CONTEXTS)


def context_ranges(contexts: DataFrame, span: int) -> DataFrame:
    """blob, start, end: the ranges that repeated strings cover, from the different contexts of anchors."""
    found, whole = None, F.struct("blob", "first")
    for width in BLOCKS:
        heavy = contexts.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > MOST).select("a")
        heavy = written(heavy, "heavy")
        some = not heavy.isEmpty()
        own = sorted_ranges(contexts.join(heavy, "a", "left_anti") if some else contexts, span)
        found = own if found is None else found.unionByName(own)
        if not some:
            return found
        split = written(blocks_of(contexts.join(heavy, "a", "left_semi"), span, width), "blocks")
        same = split.groupBy("a", "left", "last", "context").agg(F.min(whole).alias("one"), F.count(F.lit(1)).alias("times"))
        same = written(same, "kinds")
        again = split.join(same.where("times > 1").select("a", "left", "last", "context"), ["a", "left", "last", "context"], "left_semi")
        found = found.unionByName(again.select("blob", F.col("first").alias("start"), (F.col("first") + F.col("last") + span).alias("end")))
        contexts = same.select("a", "one.blob", "one.first", "left", "last", "context")
    return found  # blocks of one string: what is equal is one kind


def repeated_ranges(docs: DataFrame, span: int = 200) -> DataFrame:
    """blob, start, end: byte ranges (they may overlap) of texts, which are named by blob, that are to go."""
    if not GRAM <= span <= 1000:
        raise ValueError(f"span must be from {GRAM} to 1000")
    spark = docs.sparkSession
    hot = hot_anchors(docs, span)
    rows = anchors(docs, span)
    if hot:
        listed = spark.createDataFrame([(h,) for h in hot], "a long").withColumn("hot", F.lit(True))
        rows = rows.join(F.broadcast(listed), "a", "left").withColumn("salt", F.when(F.col("hot"), F.col("c").bitwiseAND(255)).otherwise(F.lit(0)))
    else:
        rows = rows.withColumns({"hot": F.lit(None).cast("boolean"), "salt": F.lit(0).cast("long")})
    # Rows of one anchor meet; those of a hot one meet by context only, which is all they need, and those without
    # a vote, which are known to repeat, are dealt out evenly.
    rows = rows.withColumn("salt", F.when(F.col("vote"), F.col("salt")).otherwise(F.xxhash64("blob", "at")))
    one, same = Window.partitionBy("a", "salt"), Window.partitionBy("a", "salt", "c")
    known = rows.withColumns({"same": F.count(F.lit(1)).over(same), "nth": F.row_number().over(same.orderBy("blob", "at"))})
    known = known.withColumns({"all": F.count(F.lit(1)).over(one), "kinds": F.sum(F.when(F.col("nth") == 1, 1)).over(one)})
    hot_row = F.coalesce("hot", F.lit(False))
    mute = ~F.col("vote")
    known = known.where(mute | hot_row | (F.col("all") > 1)).select("blob", "at", "a", (mute | (F.col("same") > 1)).alias("whole"), (F.col("vote") & (F.col("nth") == 1) & (hot_row | (F.col("kinds") > 1))).alias("open"))
    known = written(known, "runs")
    del rows
    free_shuffles(spark)
    first = F.shiftright("at", 20)
    whole = known.where("whole").select("blob", first.alias("start"), (first + F.shiftright("at", 10).bitwiseAND(1023) + span).alias("end"))
    wanted = known.where("open").groupBy("blob").agg(F.collect_list(F.struct("a", "at")).alias("runs"))
    contexts = written(contexts_of(docs, wanted, span), "contexts")
    del wanted
    free_shuffles(spark)
    found = context_ranges(contexts, span)
    ranges = written(whole.unionByName(found).distinct(), "ranges")
    discard(known, contexts)
    free_shuffles(spark)
    return ranges


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove(docs: DataFrame, span: int = 200, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes kept."""
    docs = docs_of(docs)
    ranges = repeated_ranges(docs, span)
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(ranges))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            raws = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            blobs = [blob_of(r) for r in raws]
            hit = [len(r) >= span and passes(bits.value, b) for r, b in zip(raws, blobs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.int64()), pa.array(map(len, raws), pa.int64()), pa.array([r if h or keep_text else None for r, h in zip(raws, hit)], pa.binary()), pa.array([None if h else hashlib.sha256(r).hexdigest() for r, h in zip(raws, hit)], pa.string())], names=["doc_id", "blob", "n_bytes", "raw", "sha"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for doc_id, n, raw, sha, pairs in zip(*(batch.column(c).to_pylist() for c in range(5))):
                parts, at, removed, spans = [], 0, 0, 0
                end = -1
                for p in pairs or ():
                    s, e = p["start"], p["end"]
                    if s > end:
                        spans += 1
                        parts.append(raw[at:s])
                        removed += e - s
                        end = at = e
                    elif e > end:
                        removed += e - end
                        end = at = e
                if pairs or sha is None:
                    raw = b"".join(parts) + raw[at:]
                    sha = hashlib.sha256(raw).hexdigest()
                rows.append((doc_id, n, removed, spans, sha, raw if keep_text else None))
            cols = list(zip(*rows)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    listed = ranges.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    texts = docs.mapInArrow(scan, "doc_id long, blob long, n_bytes long, raw binary, sha string")
    out = texts.join(listed.hint("merge"), "blob", "left").select("doc_id", "n_bytes", "raw", "sha", "ranges").mapInArrow(cut, RESULT)
    return out if keep_text else out.drop("kept")
