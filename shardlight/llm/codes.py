"""Product codes of vectors by ball k-means on integers.

Vectors are packed into blocks. In each round a block's parts move to the nearest entry of their codebook, and the
block is written again with its codes and the sums of its parts by entry, of which tasks make one row an entry and
Spark the totals; only these, of a size that the codebooks set, reach the driver, which makes the next codebooks.

In the first round each part meets all entries. Later, the parts of a block that hold an entry form its ball, with
the largest distance to the entry as radius. Only entries within twice the radius of the ball's own are its neighbours;
a ball without any, or with no entry moved among itself and its neighbours, keeps its parts. Parts nearer to their
entry than half its distance to the next one are the stable core and keep it; the others lie in rings between half
distances and meet only the neighbours up to their ring. All comparisons are of integers, so ties go to lower indexes
as in a full search.

Vectors that are null, hold null or non-finite components, or have a squared length over 2**56 after scaling
(distances of those need not be longs) are dropped. Shorter vectors count as padded with zeros, as do vectors whose
length the number of parts doesn't divide. Rows without vec_id are coded and come last among the first entries, equal
vec_ids by their integers; repeated rows are rows of their own. With fewer rows than entries each row is an entry. An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, integers, matrix, smallest_type, written

#: Rows of a block; pairs of a part and an entry that are worked on together.
ROWS, PAIRS = 8192, 1 << 18


@dataclass
class Books:
    """Codebooks (parts, entries, width), with which entries differ from the round before (None: there was none)."""

    entries: np.ndarray
    moved: np.ndarray | None = None

    def prepared(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each part, the entries by distance from each entry, and these squared distances."""
        out = []
        for c in self.entries:
            apart = np.stack([((c - x) ** 2).sum(1) for x in c])
            np.fill_diagonal(apart, -1)  # the entry itself comes first, also among equal ones
            order = np.argsort(apart, axis=1, kind="stable")
            out.append((order, np.take_along_axis(apart, order, 1)))
        return out


def exact(x: np.ndarray, c: np.ndarray) -> bool:
    """Whether inner products and squared lengths are exact as doubles."""
    return (float(np.abs(x).max(initial=0)) + float(np.abs(c).max(initial=0))) ** 2 * x.shape[1] < 2.0**52


def nearest_of_all(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    kind = np.float64 if exact(x, c) else np.int64
    c = c.astype(kind)
    step = max(1, PAIRS // len(c))
    for at in range(0, len(x), step):
        own = x[at : at + step].astype(kind)
        out[at : at + step] = ((c * c).sum(1)[None, :] - 2 * (own @ c.T)).argmin(1)
    return out


def nearest_in_balls(x: np.ndarray, c: np.ndarray, code: np.ndarray, moved: np.ndarray, order: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Codes of parts x whose nearest entries were code before the entries moved."""
    out = code.copy()
    to_own = ((x - c[code]) ** 2).sum(1)
    radius = np.full(len(c), -1, np.int64)
    np.maximum.at(radius, code, to_own)
    many = np.zeros(len(x), np.int64)
    by_ball = np.argsort(code, kind="stable")
    ends = np.searchsorted(code[by_ball], np.arange(len(c) + 1))
    for j in np.flatnonzero(radius >= 0):
        near = int(np.searchsorted(apart[j], 4 * radius[j], "right"))
        if near > 1 and moved[order[j, :near]].any():
            own = by_ball[ends[j] : ends[j + 1]]
            many[own] = np.searchsorted(apart[j, :near], 4 * to_own[own], "right")  # 1: the core
    ringed = np.flatnonzero(many > 1)
    total = np.cumsum(many[ringed])
    at = 0
    while at < len(ringed):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        own = ringed[at:upto]
        n = many[own]
        first = np.cumsum(n) - n
        ring = np.arange(n.sum()) - np.repeat(first, n)
        entry = order[np.repeat(code[own], n), ring]
        distance = ((x[np.repeat(own, n)] - c[entry]) ** 2).sum(1)
        least = np.minimum.reduceat(distance, first)
        out[own] = np.minimum.reduceat(np.where(distance == np.repeat(least, n), entry, len(c)), first)
        at = upto
    return out


def packed(vectors: DataFrame, dims: int) -> tuple[DataFrame, str]:
    """Blocks of vectors (vec_id, label, ints), and their schema; their codes and sums are still empty."""
    schema = f"ids array<long>, labels array<{dict(vectors.dtypes)['label']}>, n int, width int, ints binary, codes binary, sums binary, counts binary"
    label_type = vectors.select("label").limit(0).toArrow().schema.field(0).type

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                m = matrix(b.column(2), dims)
                kind = smallest_type(m)
                lists = [pa.array([b.column(k).to_pylist()], pa.list_(t)) for k, t in ((0, pa.int64()), (1, label_type))]
                rest = [([b.num_rows], pa.int32()), ([kind.itemsize], pa.int32()), ([m.astype(kind).tobytes()], pa.binary()), *[([b""], pa.binary())] * 3]
                yield pa.RecordBatch.from_arrays([*lists, *(pa.array(v, t) for v, t in rest)], names=["ids", "labels", "n", "width", "ints", "codes", "sums", "counts"])

    return vectors.select("vec_id", "label", "ints").mapInArrow(pack, schema), schema


def ints_of(r: dict, dims: int) -> np.ndarray:
    return np.frombuffer(r["ints"], f"i{r['width']}").reshape(r["n"], dims).astype(np.int64)


def assigned(blocks: DataFrame, schema: str, books: Books, dims: int) -> DataFrame:
    """Blocks with their codes (parts, n) by the books, and the sums and counts of their parts by entry."""
    sent = blocks.sparkSession.sparkContext.broadcast(books)
    names = blocks.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, moved = sent.value.entries, sent.value.moved
        parts, many, width = entries.shape
        tables = sent.value.prepared() if moved is not None else None
        for batch in batches:
            for k in range(batch.num_rows):
                b = batch.slice(k, 1)
                r = b.select(["n", "width", "ints", "codes"]).to_pylist()[0]
                x = ints_of(r, dims).reshape(r["n"], parts, width)
                codes = np.zeros((parts, r["n"]), np.int64)
                sums, counts = np.zeros((parts, many, width), np.int64), np.zeros((parts, many), np.int64)
                for p in range(parts):
                    own = np.ascontiguousarray(x[:, p])
                    if tables is None:
                        codes[p] = nearest_of_all(own, entries[p])
                    else:
                        before = np.frombuffer(r["codes"], np.int32).reshape(parts, r["n"])[p].astype(np.int64)
                        codes[p] = nearest_in_balls(own, entries[p], before, moved[p], *tables[p])
                    np.add.at(sums[p], codes[p], own)
                    counts[p] = np.bincount(codes[p], minlength=many)
                fresh = {"codes": codes.astype(np.int32).tobytes(), "sums": sums.tobytes(), "counts": counts.tobytes()}
                yield pa.RecordBatch.from_arrays([pa.array([fresh[c]], pa.binary()) if c in fresh else b.column(c) for c in names], names=names)

    return blocks.mapInArrow(assign, schema)


def moved_books(blocks: DataFrame, books: Books) -> Books:
    """The books with each entry at the mean of its parts, rounded down; entries without parts stay."""
    parts, many, width = books.entries.shape
    cells = [f"s{k}" for k in range(width)]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * many, width), np.int64), np.zeros(parts * many, np.int64)
        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums += np.frombuffer(s, np.int64).reshape(sums.shape)
                counts += np.frombuffer(c, np.int64)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), *(pa.array(sums[used, k]) for k in range(width))], names=["slot", "n", *cells])

    each = blocks.select("sums", "counts").mapInArrow(total, ", ".join(["slot int", "n long", *(f"{c} long" for c in cells)]))
    entries = books.entries.copy()
    for r in each.groupBy("slot").agg(*(F.sum(c).alias(c) for c in ["n", *cells])).collect():
        entries[r["slot"] // many, r["slot"] % many] = np.array(r[2:], np.int64) // r["n"]
    return Books(entries, (entries != books.entries).any(2))


def unpacked(blocks: DataFrame, books: Books, dims: int) -> DataFrame:
    """vec_id, label, code, error of the rows of blocks."""
    sent = blocks.sparkSession.sparkContext.broadcast(books)
    label = dict(blocks.dtypes)["labels"][6:-1]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = sent.value.entries
        parts, many, width = entries.shape
        digits = max(2, len(f"{many - 1:x}"))
        for batch in batches:
            for k in range(batch.num_rows):
                b = batch.slice(k, 1)
                r = b.select(["n", "width", "ints", "codes"]).to_pylist()[0]
                x, codes = ints_of(r, dims).reshape(r["n"], parts, width), np.frombuffer(r["codes"], np.int32).reshape(parts, r["n"])
                error = sum(((x[:, p] - entries[p][codes[p]]) ** 2).sum(1) for p in range(parts))
                text = ["".join(f"{v:0{digits}x}" for v in row) for row in codes.T.tolist()]
                yield pa.RecordBatch.from_arrays([b.column("ids").flatten(), b.column("labels").flatten(), pa.array(text, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(unpack, f"vec_id long, label {label}, code string, error long")


def compress(embeddings: DataFrame, entries: int = 256, parts: int = 4, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, code, error, label_error (the sum of errors over equal labels), codebooks_sha256."""
    spark = embeddings.sparkSession
    vectors = integers(embeddings, scale, F.col("label"), keyed=False)
    longest = vectors.agg(F.max(F.size("ints"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    dims = max(1, -(-longest // parts)) * parts
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    start = np.zeros((len(first), dims), np.int64)
    for k, r in enumerate(first):
        start[k, : len(r["ints"])] = r["ints"]
    books = Books(np.ascontiguousarray(start.reshape(len(first), parts, dims // parts).transpose(1, 0, 2)))
    blocks, schema = packed(vectors, dims)
    old = None
    for k in range(rounds + 1):
        blocks = written(assigned(blocks, schema, books, dims), "codes")
        if old is not None:
            discard(old)
        old = blocks
        if k < rounds:
            books = moved_books(blocks, books)
    rows = unpacked(blocks, books, dims)
    errors = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    digest = hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()
    return rows.join(errors, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


_ASSIGNED = "a{k} AS MATERIALIZED (SELECT i, p, arg_min(k, d * 256 + k) AS k, min(d) AS d FROM (SELECT i, x.p, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint AS d FROM x JOIN c{k} c ON x.p = c.p) GROUP BY i, p)"
_MOVED = """c{n} AS MATERIALIZED (SELECT c.p, c.k, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN (SELECT p, k, list(v ORDER BY j) AS c FROM
  (SELECT p, k, j, ((sum(v) - ((sum(v) % count(*) + count(*)) % count(*))) // count(*))::bigint AS v FROM (SELECT a.p, a.k, unnest(range(1, len(x) + 1)) AS j, unnest(x) AS v FROM a{k} a JOIN x ON a.i = x.i AND a.p = x.p) GROUP BY p, k, j) GROUP BY p, k) m ON m.p = c.p AND m.k = c.k)"""
ORACLE = (
    """
WITH v AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS i, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT i, p, list_slice(e, p * len(e) // 4 + 1, (p + 1) * len(e) // 4) AS x FROM v, range(4) r(p)),
c0 AS MATERIALIZED (SELECT p, i AS k, x AS c FROM x WHERE i < 256),
"""
    + ",\n".join(_ASSIGNED.format(k=k) + (",\n" + _MOVED.format(k=k, n=k + 1) if k < 4 else "") for k in range(5))
    + """,
e AS (SELECT i, string_agg(lpad(to_hex(k), 2, '0'), '' ORDER BY p) AS code, sum(d)::bigint AS error FROM a4 GROUP BY i)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) FROM c4) AS codebooks_sha256 FROM v JOIN e USING (i)
"""
)
