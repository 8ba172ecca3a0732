"""Hard negatives by coordinate pruning of an exact inner-product search.

Vectors are dealt into buckets of similar length (range partitions of their squared length), and a bucket is written
in blocks that hold, beside its integers, a list of its rows for each coordinate, sorted by that coordinate of the
row's direction. For an anchor and a score that a row has to reach, the cosine that the block's longest row would need
bounds an angle; rows within that angle have each coordinate in a range around the anchor's. The ranges of the anchor's
focus coordinates (the largest of its direction) are cut from the sorted lists, rows in all of them are candidates, and
only those are scored, exactly. A block whose longest row can't reach the score is skipped.

Anchors are sent to the blocks in passes of a bounded number of integers. In a pass, the bucket of the longest vectors
is searched first; the k-th best scores found there are what rows of all other blocks have to reach, and these
scores rise as a task goes through its blocks. The positives of the pass (at most so many for each anchor) set the
ranges in which negatives are then searched in the same way. The best rows of each task are merged by rank.

Rows take no part that have no vec_id, label or vector, a null or non-finite component, or a squared length over 2**56
after scaling, as scores of those need not be longs. Shorter vectors count as padded with zeros. Rows that share the
anchor's vec_id are its own and neither positives nor negatives; a repeated anchor row is one anchor, and anchors that
share a vec_id with other vectors or labels are anchors of their own, each with ranks from 1; other repeated rows count
each. Ties go to smaller vec_ids. A positive score below 0 leaves no range; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import integers, matrix, written

#: Rows of a block; integers of the anchors of a pass; coordinates that are cut from the lists.
ROWS, PASS, FOCUS = 8192, 1 << 20, 3
#: A score that any row reaches.
NONE = -(1 << 62)
BLOCK = "bucket int, n int, dims int, ids binary, labels binary, ints binary, orders binary"


def index(vectors: DataFrame, dims: int, buckets: int) -> DataFrame:
    """Blocks of vectors (vec_id, label, ints, square), by buckets of falling length."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []

        def block() -> pa.RecordBatch:
            ids, labels, m = (np.concatenate([h[k] for h in held]) for k in range(3))
            unit = directions(m)
            orders = np.argsort(unit, axis=0, kind="stable").T.astype(np.uint16)
            cols = [[held[0][3]], [len(ids)], [dims], [ids.tobytes()], [labels.tobytes()], [m.tobytes()], [orders.tobytes()]]
            types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["bucket", "n", "dims", "ids", "labels", "ints", "orders"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                if held and sum(len(h[0]) for h in held) + b.num_rows > ROWS:
                    yield block()
                    held = []
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2), dims), b.column(3)[0].as_py()))
        if held:
            yield block()

    dealt = vectors.repartitionByRange(buckets, F.desc("square"), "vec_id")
    return dealt.select("vec_id", F.col("label").cast("long").alias("label"), "ints", F.spark_partition_id().alias("bucket")).mapInArrow(pack, BLOCK)


def directions(m: np.ndarray) -> np.ndarray:
    """The rows of m at unit length; zero rows stay."""
    x = m.astype(np.float64)
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


@dataclass
class Block:
    """A block of the index, ready for searches."""

    ids: np.ndarray
    labels: np.ndarray
    ints: np.ndarray
    orders: np.ndarray
    sorted: np.ndarray
    longest: float

    @classmethod
    def of(cls, r: dict) -> Block:
        ints = np.frombuffer(r["ints"], np.int64).reshape(r["n"], r["dims"])
        orders = np.frombuffer(r["orders"], np.uint16).reshape(r["dims"], r["n"])
        unit = directions(ints)
        x = ints.astype(np.float64)
        longest = float(np.sqrt((x * x).sum(1).max(initial=0.0)))
        return cls(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), ints, orders, np.take_along_axis(unit.T, orders.astype(np.int64), 1), longest)

    def candidates(self, direction: np.ndarray, length: float, focus: np.ndarray, reach: int) -> np.ndarray:
        """Positions of the rows that may have an inner product of reach or more with the anchor."""
        every = np.arange(len(self.ids))
        if reach <= 0:
            return every
        most = length * self.longest
        if reach > most * (1 + 1e-9):
            return every[:0]
        angle = np.arccos(min(1.0, reach / most))
        met = np.zeros(len(self.ids), np.uint8)
        for f in focus:
            own = np.arccos(np.clip(direction[f], -1.0, 1.0))
            low, high = np.cos(min(np.pi, own + angle)) - 1e-7, np.cos(max(0.0, own - angle)) + 1e-7
            a, b = np.searchsorted(self.sorted[f], [low, high], "left")
            met[self.orders[f, a:b]] += 1
        return np.flatnonzero(met == len(focus))

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        m = self.ints if len(rows) == len(self.ids) else self.ints[rows]
        if float(np.abs(anchor).max(initial=0)) * self.longest * len(anchor) < 2.0**52:  # exact as doubles
            return (m.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
        return m @ anchor


@dataclass
class Anchors:
    """The anchors of a pass; ranges: for each, its (number, lowest score, highest score) to search negatives in."""

    ids: np.ndarray
    copies: np.ndarray
    labels: np.ndarray
    ints: np.ndarray
    ranges: list[list[tuple[int, int, int]]]
    reach: dict[tuple[int, int], int]

    def prepared(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        unit = directions(self.ints)
        x = self.ints.astype(np.float64)
        return unit, np.sqrt((x * x).sum(1)), np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]


FOUND = "anchor int, number int, vec_id long, score long"


def best(blocks: DataFrame, anchors: Anchors, k: int, same: bool) -> DataFrame:
    """anchor (place in the pass), number (of the range), vec_id, score: for each task, the k best rows of each range,
    of the anchor's label (same) or of others."""
    sent = blocks.sparkSession.sparkContext.broadcast(anchors)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        unit, length, focus = a.prepared()
        top: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        reach = dict(a.reach)
        for batch in batches:
            for r in batch.to_pylist():
                block = Block.of(r)
                for i, spans in enumerate(a.ranges):
                    if not spans:
                        continue
                    need = min(max(low, reach.get((i, n), NONE)) for n, low, _ in spans)
                    rows = block.candidates(unit[i], length[i], focus[i], need)
                    rows = rows[((block.labels[rows] == a.labels[i]) == same) & (block.ids[rows] != a.ids[i])]
                    if not len(rows):
                        continue
                    scores, ids = block.scores(rows, a.ints[i]), block.ids[rows]
                    for n, low, high in spans:
                        own = (scores >= max(low, reach.get((i, n), NONE))) & (scores <= high)
                        if not own.any():
                            continue
                        s, v = scores[own], ids[own]
                        if (i, n) in top:
                            s, v = np.r_[top[i, n][0], s], np.r_[top[i, n][1], v]
                        order = np.lexsort((v, -s))[:k]
                        top[i, n] = s[order], v[order]
                        if len(order) == k:
                            reach[i, n] = max(reach.get((i, n), NONE), int(s[order[-1]]))
        keys = list(top)
        for at in range(0, len(keys), 4096):
            part = keys[at : at + 4096]
            sizes = [len(top[x][0]) for x in part]
            cols = [np.repeat([x[0] for x in part], sizes), np.repeat([x[1] for x in part], sizes), np.concatenate([top[x][1] for x in part]), np.concatenate([top[x][0] for x in part])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["anchor", "number", "vec_id", "score"])

    return blocks.mapInArrow(search, FOUND)


def merged(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("anchor", "number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def searched(blocks: DataFrame, anchors: Anchors, k: int, same: bool) -> DataFrame:
    """merged(best()) with what the longest vectors' bucket yields as the scores to reach elsewhere."""
    first = merged(best(blocks.where("bucket = 0"), anchors, k, same), k)
    reach = {(r["anchor"], r["number"]): r["least"] for r in first.groupBy("anchor", "number").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k).collect()}
    anchors.reach = reach
    return merged(best(blocks, anchors, k, same), k)


def noisy(embeddings: DataFrame) -> Column:
    """The label, moved on by one of ten where vec_id is divisible by 7."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def mine(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, label: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row whose vec_id is divisible
    by every, and each of its best rows of equal label, the best rows of other labels with low to high hundredths of
    the positive's score. label: an expression for the labels to use."""
    spark = embeddings.sparkSession
    vectors = integers(embeddings.where("label is not null"), scale, F.coalesce(label, F.col("label")).alias("label") if label is not None else F.col("label"))
    asked = vectors.where(F.col("vec_id") % every == 0).select("vec_id", "label", "ints").dropDuplicates()
    n, dims = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("ints")), F.lit(0))).first()
    blocks = written(index(vectors, max(1, dims), max(1, -(-n // ROWS))), "lengths")
    same = Window.partitionBy("vec_id").orderBy("label", "ints")
    asked = written(asked.withColumn("copy", F.row_number().over(same)), "anchors")
    passes = max(1, -(-asked.count() * max(1, dims) // PASS))
    out = []
    for b in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == b).orderBy("vec_id", "copy").collect()
        ints = np.zeros((len(rows), max(1, dims)), np.int64)
        for i, r in enumerate(rows):
            ints[i, : len(r["ints"])] = r["ints"]
        anchors = Anchors(np.array([r["vec_id"] for r in rows], np.int64), np.array([r["copy"] for r in rows], np.int32), np.array([r["label"] for r in rows], np.int64), ints, [[(1, NONE, -NONE)] for _ in rows], {})
        pairs = searched(blocks, anchors, positives, True).collect()
        ranges: list[list[tuple[int, int, int]]] = [[] for _ in rows]
        for r in pairs:
            if r["score"] >= 0:
                ranges[r["anchor"]].append((r["rank"], -(-low * r["score"] // 100), high * r["score"] // 100))
        found = searched(blocks, Anchors(anchors.ids, anchors.copies, anchors.labels, ints, ranges, {}), negatives, False)
        told = spark.createDataFrame([(r["anchor"], r["rank"], rows[r["anchor"]]["vec_id"], r["vec_id"], r["score"]) for r in pairs], "anchor int, number int, anchor_id long, positive_id long, positive_score long")
        out.append(found.join(told, ["anchor", "number"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return reduce(DataFrame.unionByName, out)


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same, list_sum(list_transform(list_zip(a.e, v.e), lambda z: z[1] * z[2]))::bigint AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
r AS (SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::int AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM r WHERE rank <= 10
"""
