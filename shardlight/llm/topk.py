"""Exact top-k search on a bit-sliced index.

Rows are packed into blocks of a few thousand. A block keeps, for each dimension, the slices of its integers less
their smallest: one bitmap of rows per bit. A query's score is a sum of slices weighted by powers of two, added
with carry-save bitmap arithmetic into score slices (slices of dimensions with negative query values enter
complemented, which adds a constant). The best k rows are chosen from the most significant score slice downward;
rows that tie at the boundary are taken in the order of vec_id. Blocks of rows meet blocks of queries by an
equi-join on a grid, and the best of each block are merged by rank.

Vectors that are null, or hold nulls or non-finite components, take no part, nor do rows without vec_id, nor vectors
whose squared length is over 2**62 after scaling, as products of two of those need not be longs; other columns are not
read; ties go to smaller vec_ids; shorter
vectors count as padded with zeros; rows that share the query's vec_id are its own; an empty table gives no rows. A repeated query row is one query, and
query rows that share a vec_id with other vectors are queries of their own, each with its ranks from 1 to k; other
repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ROWS, QUERIES = 8192, 2048
PACKED = "cell int, n int, dims int, width int, ids binary, ints binary, copies binary"
WIDTHS = {2: np.int16, 4: np.int32, 8: np.int64}


def width_of(m: np.ndarray) -> int:
    """Bytes of the smallest integers that hold the values."""
    return next(w for w, t in WIDTHS.items() if w == 8 or (np.iinfo(t).min <= m.min(initial=0) and m.max(initial=0) <= np.iinfo(t).max))


def packed(vectors: DataFrame, parts: int, most: int, scale: int) -> DataFrame:
    """Blocks of most rows (vec_id, embedding, copy) at most, sorted by vec_id; cell: the partition, below parts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, copies, cell = [], [], [], 0

        def block() -> pa.RecordBatch:
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            dims = max(map(len, rows))
            m = np.zeros((len(rows), dims), np.int64)
            for k, at in enumerate(order):
                m[k, : len(rows[at])] = rows[at]
            width = width_of(m)
            cols = [[cell], [len(rows)], [dims], [width], [np.array(ids, np.int64)[order].tobytes()], [m.astype(WIDTHS[width]).tobytes()], [np.array(copies, np.int32)[order].tobytes()]]
            types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["cell", "n", "dims", "width", "ids", "ints", "copies"])

        for batch in batches:
            cells, own = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            whole = np.floor(flat.astype(np.float64) * scale).astype(np.int64)
            for i, vec_id in enumerate(batch.column(0).to_pylist()):
                ids.append(vec_id)
                rows.append(whole[ends[i - 1] if i else 0 : ends[i]])
                copies.append(own[i])
                cell = cells[i]
                if len(ids) == most:
                    yield block()
                    ids, rows, copies = [], [], []
        if ids:
            yield block()

    return vectors.repartition(parts).select("vec_id", "embedding", F.spark_partition_id().alias("cell"), "copy").mapInArrow(pack, PACKED)


def slices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Bitmaps (dims, bits, words) of values (n, dims) less their smallest by dimension; those; the number of bits."""
    least = values.min(0)
    up = (values - least).astype(np.uint64)
    bits = max(1, int(up.max()).bit_length())
    n, dims = values.shape
    words = -(-n // 64)
    out = np.zeros((dims, bits, words), np.uint64)
    for b in range(bits):
        plane = np.zeros((dims, words * 64), np.uint8)
        plane[:, :n] = ((up >> np.uint64(b)) & np.uint64(1)).T
        out[:, b] = np.packbits(plane, axis=1, bitorder="little").view(np.uint64)
    return out, least, bits


def scores(planes: np.ndarray, bits: int, queries: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Score slices (queries, words), least significant first, and what each query's scores have too much."""
    size = np.abs(queries).astype(np.uint64)
    negative = np.where(queries < 0, ~np.uint64(0), np.uint64(0))
    pending: list[list[np.ndarray]] = []

    def add(weight: int, x: np.ndarray) -> None:
        while True:
            while len(pending) <= weight:
                pending.append([])
            own = pending[weight]
            own.append(x)
            if len(own) < 3:
                return
            a, b, c = own
            u = a ^ b
            carry = a & b
            carry |= u & c
            u ^= c
            own[:] = [u]
            weight, x = weight + 1, carry

    for j in range(queries.shape[1]):
        flips = negative[:, j, None]
        for b in range(bits):
            row = planes[j, b][None, :] ^ flips
            for t in range(int(size[:, j].max(initial=0)).bit_length()):
                mask = (np.uint64(0) - ((size[:, j] >> np.uint64(t)) & np.uint64(1)))[:, None]
                add(b + t, row & mask)
    out, carry = [], None
    at = 0
    while at < len(pending) or carry is not None:
        own = [*(pending[at] if at < len(pending) else []), *([carry] if carry is not None else [])]
        if len(own) == 3:
            u = own[0] ^ own[1]
            out.append(u ^ own[2])
            carry = (own[0] & own[1]) | (u & own[2])
        elif len(own) == 2:
            out.append(own[0] ^ own[1])
            carry = own[0] & own[1]
        else:
            out.append(own[0] if own else np.zeros((len(queries), planes.shape[2]), np.uint64))
            carry = None
        if carry is not None and at + 1 >= len(pending) and not carry.any():
            carry = None
        at += 1
    return out, np.where(queries < 0, size.astype(np.int64), 0).sum(1) * ((1 << bits) - 1)


def best(planes: list[np.ndarray], allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows that are sure to be among the k best, and of those that tie for what is left."""
    sure, tied = np.zeros_like(allowed), allowed.copy()
    for plane in reversed(planes):
        both = tied & plane
        more = np.bitwise_count(sure | both).sum(1) > k
        sure = np.where(more[:, None], sure, sure | both)
        tied = np.where(more[:, None], both, tied & ~plane)
    return sure, tied


def top_of_block(values: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, vec ids, scores) of the k best rows of the block for each query, in batches. ids ascend."""
    planes, least, bits = slices(values)
    n, words = len(values), planes.shape[2]
    every = np.packbits(np.arange(words * 64) < n, bitorder="little").view(np.uint64)
    step = int(np.clip(8192 // words, 16, 2048))
    for at in range(0, len(queries), step):
        q, own = queries[at : at + step], query_ids[at : at + step]
        score, over = scores(planes, bits, q)
        allowed = np.repeat(every[None, :], len(q), 0)
        lo, hi = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        for i in np.flatnonzero(hi > lo):
            for r in range(lo[i], hi[i]):
                allowed[i, r // 64] &= ~(np.uint64(1) << np.uint64(r % 64))
        sure, tied = best(score, allowed, k)
        left = k - np.bitwise_count(sure).sum(1)
        bit = lambda m: np.nonzero(np.unpackbits(m.view(np.uint8), axis=1, bitorder="little"))
        qi, ri = bit(sure)
        ti, tr = bit(tied)
        first = np.searchsorted(ti, np.arange(len(q)))
        take = np.arange(len(ti)) - first[ti] < left[ti]
        qi, ri = np.r_[qi, ti[take]], np.r_[ri, tr[take]]
        value = np.zeros(len(qi), np.int64)
        for w, plane in enumerate(score):
            value += ((plane[qi, ri // 64] >> (ri % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << w
        yield own[qi], ids[ri], value - over[qi] + (q @ least)[qi]


def search(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by every."""
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double"))
    vectors = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(good).where(square <= 2.0**62)
    asked = F.col("vec_id") % every == 0
    # Queries that share a vec_id are told apart by copy.
    same = Window.partitionBy("vec_id").orderBy("embedding")
    queried = vectors.where(asked).dropDuplicates(["vec_id", "embedding"]).withColumn("copy", F.row_number().over(same))
    n, m = vectors.agg(F.count(F.lit(1)), F.count(F.when(asked, 1))).first()
    parts, chunks = max(1, -(-n // ROWS)), max(1, -(-m // QUERIES))
    rows = written(packed(vectors.withColumn("copy", F.lit(0)), parts, ROWS, scale), "slices").select(F.col("cell").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("h"), "n", "dims", "width", "ids", "ints")
    queries = written(packed(queried, chunks, QUERIES, scale), "queries").select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("g"), F.col("cell").alias("h"), F.col("n").alias("m"), F.col("dims").alias("q_dims"), F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("ints").alias("q_ints"), F.col("copies").alias("q_copies"))
    cells = min(4096, parts * chunks)
    grid = rows.repartition(cells, "g", "h").join(queries.repartition(cells, "g", "h").hint("merge"), ["g", "h"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                values = np.frombuffer(r["ints"], WIDTHS[r["width"]]).astype(np.int64).reshape(r["n"], r["dims"])
                asked = np.frombuffer(r["q_ints"], WIDTHS[r["q_width"]]).astype(np.int64).reshape(r["m"], r["q_dims"])
                dims = max(r["dims"], r["q_dims"])
                values, asked = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (values, asked))
                if not dims:
                    values, asked = np.zeros((r["n"], 1), np.int64), np.zeros((r["m"], 1), np.int64)
                ids, q_ids, copies = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_copies"], np.int32)
                for copy in np.unique(copies):
                    for got in top_of_block(values, ids, asked[copies == copy], q_ids[copies == copy], k):
                        cols = [*got, np.full(len(got[0]), copy)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score", "copy"])

    found = grid.mapInArrow(score, "query_id long, vec_id long, score long, copy long")
    order = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2]))::bigint AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::int AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
