"""Exact keyword top-k over postings in blocks, which skips what cannot reach the k-th score.

Documents are numbered (no). A part is the upper bits of a number, a range the documents that share all but its lowest
bits. A block is the posting list of one term in one range: places in the range and frequencies, and beside them the
block's frontier, the pairs of frequency and length that no other posting of the block beats in both. BM25 grows with
the one and falls with the other, so the frontier bounds the block's weights whatever the average length has become.
The search doesn't read it: it has the weights themselves.

A search sends the query terms to the parts, whose postings of these terms are in memory. Terms that are frequent both in
the part and in the queries are rows of a matrix, by which a block of queries is multiplied; the postings of the others
are added one term after the other, from the highest bound (idf times the best weight in the part) down. These sums are
in single precision, and only choose: the k-th best of the ranges' best scores tells what to reach, and what may reach it
by more than the rounding is scored again in double precision from the document's own postings. If few documents still
can reach it before all terms are added, they are looked up at once, and the postings of the terms left are not read. A
few parts are searched before the others, and their k-th best scores must be reached there.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Bits of a number below its range, its part and its segment.
RANGE_BITS, PART_BITS, SEGMENT_BITS = 9, 20, 44
RANGE = 1 << RANGE_BITS
BLOCKS = "term string, part long, range long, n int, at array<short>, tf array<int>, top_tf array<int>, top_dl array<int>"
#: Scores are compared with this much room, as they are rounded to six places afterwards.
ROOM = 2e-6
#: Postings that a term has at least to be a row of a part's matrix, and the most numbers that a matrix has, of weights or
#: of scores.
FREQUENT, WEIGHTS, SCORES = 1 << 10, 1 << 24, 1 << 22
#: Postings that are added in the time that a term's adding takes besides, and numbers that are multiplied in the time of one.
CALL, PRODUCTS = 256, 768
#: Postings that are added in the time that one document is looked up.
LOOKED_UP = 16
#: Rows that leave a task at once.
SENT = 1 << 14
#: Pairs of a query and a term that are sent out at once.
PAIRS = 1 << 18


def saturated(tf: np.ndarray, dl: np.ndarray, average: float) -> np.ndarray:
    """The BM25 weight of postings before idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values, kind))


def blocks(texts: DataFrame) -> DataFrame:
    """The blocks of texts (no, tokens), whose numbers ascend in each partition and whose parts no two partitions
    share, by part, term and range. The block of the empty term has the lengths of a range's documents as its
    frequencies. A task holds the blocks of one part, which it puts in order itself: rows of lists are dear to sort
    elsewhere."""

    def built(nos: np.ndarray, tokens: pa.Array) -> pa.RecordBatch:
        sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = tokens.flatten().dictionary_encode()
        names = coded.dictionary
        # Postings: one for each document and term.
        keys, tf = np.unique(np.repeat(np.arange(len(nos)), sizes) * max(1, len(names)) + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
        doc, term = keys // max(1, len(names)), keys % max(1, len(names))
        ranges, at = nos >> RANGE_BITS, (nos & (RANGE - 1)).astype(np.int16)
        order = np.lexsort((doc, ranges[doc], term))
        doc, term, tf = doc[order], term[order], tf[order]
        edge = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(ranges[doc]) != 0)]) if len(doc) else np.zeros(0, np.int64)
        ends = np.r_[edge[1:], len(doc)] if len(doc) else edge
        # Frontiers: by rising length, the postings whose frequency beats all before.
        block = np.repeat(np.arange(len(edge)), ends - edge)
        by = np.lexsort((-tf, sizes[doc], block))
        high = block[by] * (int(tf.max(initial=0)) + 2) + tf[by]
        new = np.r_[True, high[1:] > np.maximum.accumulate(high)[:-1]] if len(by) else np.zeros(0, bool)
        top = by[new]
        top_ends = np.cumsum(np.bincount(block[top], minlength=len(edge)))
        # The lengths of each range.
        heads = np.flatnonzero(np.r_[True, np.diff(ranges) != 0])
        head_ends = np.r_[heads[1:], len(nos)]
        cat = lambda a, b, kind: pa.concat_arrays([a.cast(kind), b.cast(kind)])
        own = ranges[doc[edge]]
        cols = [
            cat(names.take(pa.array(term[edge])), pa.array([""] * len(heads), pa.string()), pa.string()),
            pa.array(np.r_[own, ranges[heads]] >> (PART_BITS - RANGE_BITS), pa.int64()), pa.array(np.r_[own, ranges[heads]], pa.int64()), pa.array(np.r_[ends - edge, head_ends - heads], pa.int32()),
            cat(lists(at[doc], ends, pa.int16()), lists(at, head_ends, pa.int16()), pa.list_(pa.int16())), cat(lists(tf, ends, pa.int32()), lists(sizes, head_ends, pa.int32()), pa.list_(pa.int32())),
            cat(lists(tf[top], top_ends, pa.int32()), lists(tf[:0], np.zeros(len(heads)), pa.int32()), pa.list_(pa.int32())), cat(lists(sizes[doc[top]], top_ends, pa.int32()), lists(tf[:0], np.zeros(len(heads)), pa.int32()), pa.list_(pa.int32())),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["term", "part", "range", "n", "at", "tf", "top_tf", "top_dl"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        made: list[pa.RecordBatch] = []

        def ordered() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(made).combine_chunks()
            made.clear()
            coded = rows.column("term").chunk(0).dictionary_encode()
            rank = np.empty(len(coded.dictionary), np.int64)
            rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
            by = np.lexsort((rows.column("range").to_numpy(), rank[coded.indices.to_numpy(zero_copy_only=False)]))
            for a in range(0, len(by), SENT):
                yield from rows.take(pa.array(by[a : a + SENT])).combine_chunks().to_batches()

        def taken(last: bool) -> None:
            nonlocal held
            nos = np.concatenate([b.column(0).to_numpy() for b in held])
            tokens = pa.concat_arrays([b.column(1) for b in held])
            cut = len(nos) if last else int(np.searchsorted(nos, nos[-1] >> RANGE_BITS << RANGE_BITS))  # the last range may go on
            if cut:
                made.append(built(nos[:cut], tokens.slice(0, cut)))
            held = [pa.RecordBatch.from_arrays([pa.array(nos[cut:]), tokens.slice(cut)], names=["no", "tokens"])] if cut < len(nos) else []

        for batch in batches:
            if not batch.num_rows:
                continue
            # A task may read several files, which begin anew.
            nos = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(nos >> PART_BITS) != 0) + 1
            for a, b in zip(np.r_[0, edges].tolist(), np.r_[edges, len(nos)].tolist()):
                if held and nos[a] >> PART_BITS != held[-1].column(0)[-1].as_py() >> PART_BITS:
                    taken(True)
                    yield from ordered()
                held.append(batch.slice(a, b - a))
                if sum(h.num_rows for h in held) >= 8 * RANGE:
                    taken(False)
        if held:
            taken(True)
            yield from ordered()

    return texts.select("no", "tokens").mapInArrow(build, BLOCKS)


@dataclass
class Asked:
    """Queries of one pass: terms of each by idf; reach: the score that a query's hits need at least."""

    queries: list
    terms: dict[str, tuple[np.ndarray, np.ndarray]]
    average: float
    k: int
    reach: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def of(cls, rows: list, average: float, k: int) -> Asked:
        """rows: (query, term, idf)."""
        queries = sorted({r[0] for r in rows})
        place = {q: i for i, q in enumerate(queries)}
        by: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for q, term, idf in sorted(rows):
            by[term].append((place[q], idf))
        return cls(queries, {t: (np.array([x[0] for x in v]), np.array([x[1] for x in v])) for t, v in by.items()}, average, k, np.zeros(len(queries)))


class Part:
    """The postings of the asked terms in one part, by term and by document, and the search in it. marked: which
    documents, by range, are left out (or, if only, the only ones left)."""

    def __init__(self, rows: pa.Table, asked: Asked, only: bool):
        coded = rows.column("term").combine_chunks().dictionary_encode()
        code, terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        ranges = rows.column("range").to_numpy()
        key = code << 48 | ranges - ranges.min()
        if (np.diff(key) < 0).any():
            order = np.argsort(key, kind="stable")
            code, ranges, rows = code[order], ranges[order], rows.take(pa.array(order))
        self.ranges, spot = np.unique(ranges, return_inverse=True)
        col = lambda c: (lambda x: (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64), x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))(rows.column(c).combine_chunks())
        (at, sizes), (tf, _) = col("at"), col("tf")
        head = code == (terms.index("") if "" in terms else -1)
        if not np.isin(np.unique(spot[~head]), spot[head]).all():
            raise RuntimeError("a part's rows lie in more than one file or row group")
        place = np.repeat(spot, sizes) * RANGE + at
        heads = np.repeat(head, sizes)
        length = np.zeros(len(self.ranges) * RANGE, np.int64)
        length[place[heads]] = tf[heads]
        self.out = np.full(len(length), only)
        if "marked" in rows.column_names:
            own, many = col("marked")
            self.out[np.repeat(spot, many) * RANGE + own] = not only
        self.all_in = not self.out.any()
        # By term: where its postings begin, their places and weights, and the best weight.
        term = np.repeat(code, sizes)[~heads]
        self.place, self.weight = place[~heads], saturated(tf, length[place], asked.average)[~heads]
        self.n = np.bincount(term, minlength=len(terms))
        self.first = np.cumsum(self.n) - self.n
        self.best, full = np.zeros(len(terms)), np.flatnonzero(self.n)
        if len(full):
            self.best[full] = np.maximum.reduceat(self.weight, self.first[full])
        # By document: the same postings in the order of their terms.
        order = np.argsort(self.place, kind="stable")
        self.own_term, self.own_weight = term[order], self.weight[order]
        self.own_n = np.bincount(self.place, minlength=len(length))
        self.own_first = np.cumsum(self.own_n) - self.own_n
        # By query: its terms here and their idf.
        self.asked = asked
        held = [(t, *asked.terms[terms[t]]) for t in full.tolist()]
        of = np.concatenate([h[1] for h in held]) if held else np.zeros(0, np.int64)
        order = np.argsort(of, kind="stable")
        self.terms = np.repeat(np.array([h[0] for h in held], np.int64), [len(h[1]) for h in held])[order]
        self.idf = (np.concatenate([h[2] for h in held]) if held else np.zeros(0))[order]
        self.queries, many = np.unique(of, return_counts=True)
        self.ends = np.cumsum(many)
        # Rows of the matrix: terms that cost more to add for each query that has them than to multiply for all.
        spared = np.bincount(self.terms, minlength=len(terms)) * (CALL + self.n) - len(self.queries) * len(length) / PRODUCTS
        rows_ = np.flatnonzero((spared > 0) & (self.n >= FREQUENT))
        rows_ = rows_[np.argsort(-spared[rows_], kind="stable")[: WEIGHTS // len(length)]]
        self.row = np.full(len(terms), -1)
        self.row[rows_] = np.arange(len(rows_))
        self.matrix = np.zeros((len(rows_), len(length)), np.float32)
        for r, x in enumerate(rows_.tolist()):
            p, q = self.first[x], self.first[x] + self.n[x]
            self.matrix[r, self.place[p:q]] = self.weight[p:q]
        self.light = self.weight.astype(np.float32)

    def search(self, top: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], reach: np.ndarray, counts: np.ndarray) -> None:
        """Take this part's hits into top (scores, numbers by query and segment, as only in a segment numbers follow
        ids); counts (queries, 2): postings held and read."""
        idfs, begins = np.zeros(len(self.n)), np.r_[0, self.ends]
        step = max(1, min(SCORES // len(self.out), len(self.queries)))
        scores = np.zeros((step, len(self.out)), np.float32)
        for first in range(0, len(self.queries), step):
            some = self.queries[first : first + step].tolist()
            a, b = begins[first], begins[first + len(some)]
            own = self.row[self.terms[a:b]]
            asked = np.zeros((len(some), len(self.matrix)), np.float32)
            asked[np.repeat(np.arange(len(some)), np.diff(begins[first : first + len(some) + 1]))[own >= 0], own[own >= 0]] = self.idf[a:b][own >= 0]
            if len(self.matrix):
                np.matmul(asked, self.matrix, out=scores[: len(some)])
            else:
                scores.fill(0)
            for i, q in enumerate(some):
                a, b = begins[first + i], begins[first + i + 1]
                counts[q] += self._take(q, self.terms[a:b], self.idf[a:b], scores[i], idfs, top, reach)
                idfs[self.terms[a:b]] = 0

    def _whole(self, some: np.ndarray, idfs: np.ndarray) -> tuple[np.ndarray, int]:
        """What the terms of an idf give the documents at some places, from these documents' own postings, which are
        added in the order of terms; and how many there are."""
        n = self.own_n[some]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.own_first[some] - ends + n, n)
        more = idfs[self.own_term[at]] * self.own_weight[at]
        return np.bincount(np.repeat(np.arange(len(some)), n), more, len(some)), int(np.count_nonzero(more))

    def _take(self, q: int, terms: np.ndarray, idf: np.ndarray, scores: np.ndarray, idfs: np.ndarray, top: dict, reach: np.ndarray) -> tuple[int, int]:
        """Hits of one query, whose terms of the matrix are in the scores already; idfs are zeros. The postings held and
        read."""
        k, bound, held = self.asked.k, idf * self.best[terms], int(self.n[terms].sum())
        # How far a score is off at most, as a share of it.
        off = (len(terms) + 8) * 2.0**-23
        least, looked_up = reach[q] - ROOM, 0
        if bound.sum() < least:
            return held, 0
        rest_ = np.flatnonzero(self.row[terms] < 0)
        by = rest_[np.argsort(-bound[rest_], kind="stable")]
        own, x, n = terms[by], idf[by], self.n[terms[by]]
        # What the terms from each on can add, and how many postings they have.
        rest, left = np.r_[np.cumsum(bound[by][::-1])[::-1], 0.0].tolist(), np.r_[np.cumsum(n[::-1])[::-1], 0].tolist()
        spans = list(zip(self.first[own].tolist(), (self.first[own] + n).tolist(), x.astype(np.float32)))
        if not self.all_in:
            scores[self.out] = -np.inf
        i, some, checked = 0, None, 2 * left[0]
        while i < len(spans):
            if left[i] <= 0.5 * checked and i:
                checked = left[i]
                least = max(least, self._kth(scores) * (1 - off) - ROOM)
                if rest[i] < least:
                    some = np.flatnonzero(scores >= (least - rest[i]) * (1 - off))
                    if LOOKED_UP * len(some) <= left[i]:
                        break
            a, b, w = spans[i]
            scores[self.place[a:b]] += w * self.light[a:b]
            i += 1
        else:
            least = max(least, self._kth(scores) * (1 - off) - ROOM)
            some = np.flatnonzero(scores >= least * (1 - off)) if least > 0 else np.flatnonzero(scores > 0)
        if i < len(spans) and len(some):
            idfs[own[i:]] = x[i:]
            more, looked_up = self._whole(some, idfs)
            some = some[scores[some] + more >= least * (1 - off)]
        if len(some):
            idfs[terms] = idf
            s = self._whole(some, idfs)[0]
            if len(s) > k:
                least = max(least, np.partition(s, len(s) - k)[len(s) - k] - ROOM)
            some, s = some[s >= least], np.round(s[s >= least], 6)
        if len(some):
            v = (self.ranges[some >> RANGE_BITS] << RANGE_BITS) + (some & (RANGE - 1))
            key = q, int(self.ranges[0]) >> (SEGMENT_BITS - RANGE_BITS)
            if key in top:
                s, v = np.r_[top[key][0], s], np.r_[top[key][1], v]
            order = np.lexsort((v, -s))[:k]
            top[key] = s[order], v[order]
            if len(order) == k:
                reach[q] = max(reach[q], s[order[-1]])
        return held, held - left[i] + looked_up

    def _kth(self, scores: np.ndarray) -> float:
        """What the k best are not below: the k-th of the bests of groups, a range each or less if these are few."""
        k, wide = self.asked.k, RANGE
        while wide > 8 and len(scores) < 8 * k * wide:
            wide //= 2
        best = scores.reshape(-1, wide).max(1)
        return float(np.partition(best, len(best) - k)[len(best) - k]) if len(best) >= k else 0.0


def scored(stored: DataFrame, asked: Asked, query_type: str, only: bool = False) -> DataFrame:
    """query_id, no, score of each task's best, and rows without no that have the postings of the query held and read.
    stored: blocks and, if some are to be left out or the only ones, marked (places in the range)."""
    sent = stored.sparkSession.sparkContext.broadcast(asked)
    names = [c for c in ("term", "part", "range", "at", "tf", "marked") if c in stored.columns]
    schema = f"query_id {query_type}, no long, score double, held long, read long"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        top: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        reach, counts = own.reach.copy(), np.zeros((len(own.queries), 2), np.int64)
        held: list[pa.RecordBatch] = []

        def done() -> None:
            Part(pa.Table.from_batches(held), own, only).search(top, reach, counts)
            held.clear()

        for batch in batches:
            parts = batch.column(1).to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(parts)) + 1, len(parts)].tolist() if len(parts) else [0]
            for a, b in zip(edges, edges[1:]):
                if held and held[-1].column(1)[0].as_py() != parts[a]:
                    done()
                held.append(batch.slice(a, b - a))
        if held:
            done()
        many = [len(v[0]) for v in top.values()]
        names_ = np.array(own.queries, object)
        q = np.r_[np.repeat(np.array([q for q, _ in top], np.int64), many), np.flatnonzero(counts[:, 0])].astype(np.int64)
        n = sum(many)
        cat = lambda x: np.concatenate([v[x] for v in top.values()]) if top else np.zeros(0)
        rest = np.flatnonzero(counts[:, 0])
        none = [None] * len(rest)
        cols = [names_[q].tolist(), [*cat(1).astype(np.int64).tolist(), *none], [*cat(0).tolist(), *none], [*[None] * n, *counts[rest, 0].tolist()], [*[None] * n, *counts[rest, 1].tolist()]]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], arrow_type), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.float64(), pa.int64(), pa.int64())))], names=["query_id", "no", "score", "held", "read"])

    arrow_type = pa.string() if query_type == "string" else pa.int64() if query_type == "bigint" else pa.int32()
    return stored.select(*names).mapInArrow(search, schema)


def best(hits: DataFrame, k: int) -> DataFrame:
    """The hits (query_id, no, score) of rank k or better; equal scores share a rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"))
    return hits.withColumn("_rank", F.rank().over(w)).where(F.col("_rank") <= k).drop("_rank")
