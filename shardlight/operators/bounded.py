"""Exact inner-product top-k over vectors in clusters, which skips clusters that cannot reach the k-th score.

Vectors are stored in clusters by direction: a unit centre, the widest angle of a vector to it, the shortest and the
longest length. A query at some angle to the centre is no nearer to any vector of the cluster than that angle less the
widest, which bounds its inner products. For each query the cluster of the highest bound is searched first; clusters
whose bound is below the k-th best score so far are never multiplied. Where bounds skip less than half, as with vectors
that have no clusters, what a few dozen clusters hold is multiplied at once. A few parts are searched before the others,
and their k-th best scores must be reached there.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blockmax import PART_BITS, RANGE, RANGE_BITS, ROOM, SEGMENT_BITS

#: Numbers that are clustered together, and that the queries of a pass have.
VALUES, PASS = 1 << 22, 1 << 19
#: Clusters whose bounds, and queries whose scores with a cluster, are in memory at once.
CLUSTERS_AT_ONCE, QUERIES = 64, 512
#: Scores of vectors that are multiplied at once.
SCORES = 1 << 20
#: Rounds of clustering.
ROUNDS = 3
CLUSTERS = "cluster long, part long, dims int, n int, nos array<long>, centre array<double>, cosine double, shortest double, longest double, vectors binary"


def unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at unit length (zero rows stay) and their lengths."""
    size = np.sqrt((m * m).sum(1))
    return np.divide(m, size[:, None], out=np.zeros_like(m), where=size[:, None] > 0), size


def clusters(vectors: DataFrame) -> DataFrame:
    """Clusters of vectors (no, embedding), whose parts no two partitions share. Vectors that are null or empty, or hold
    null or non-finite components, are in none."""

    def grouped(part: int, at: int, nos: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        direction, size = unit(m)
        many = max(1, int(np.sqrt(len(m))))
        centres = direction[np.linspace(0, len(m) - 1, many).astype(np.int64)].copy()
        for last in range(ROUNDS):
            own = (direction @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, direction)
            fresh, length = unit(sums)
            centres = np.where(length[:, None] > 1e-9, fresh, centres)
        own = (direction @ centres.T).argmax(1)
        order = np.argsort(own, kind="stable")
        ends = np.searchsorted(own[order], np.arange(many + 1))
        for c in range(many):
            rows = np.sort(order[ends[c] : ends[c + 1]])
            if len(rows):
                # A zero vector is at no angle; its length says enough.
                cosines = (direction[rows] @ centres[c])[size[rows] > 0]
                cols = [[(part << PART_BITS) + at + c], [part], [m.shape[1]], [len(rows)], [nos[rows]], [centres[c]], [float(cosines.min(initial=1.0))], [float(size[rows].min())], [float(size[rows].max())], [m[rows].tobytes()]]
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.float64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names=[x.split(" ")[0] for x in CLUSTERS.split(", ")])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        used: dict[int, int] = defaultdict(int)
        key: int | None = None

        def done(dims: int) -> Iterator[pa.RecordBatch]:
            rows = held.pop(dims)
            m = np.concatenate([x[1] for x in rows])
            yield from grouped(key, used[key], np.concatenate([x[0] for x in rows]), m)
            used[key] += len(m)

        for batch in batches:
            nos, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            first = np.cumsum(sizes) - sizes
            parts = nos >> PART_BITS
            for part in np.unique(parts).tolist():
                if key is not None and key != part:
                    for dims in list(held):
                        yield from done(dims)
                key = part
                for dims in np.unique(sizes[(parts == part) & (sizes > 0)]).tolist():
                    rows = np.flatnonzero((parts == part) & (sizes == dims))
                    m = flat[first[rows][:, None] + np.arange(dims)]
                    fine = np.isfinite(m).all(1)
                    held[dims].append((nos[rows[fine]], m[fine]))
                    if sum(x[1].size for x in held[dims]) >= VALUES:
                        yield from done(dims)
        for dims in list(held):
            if sum(len(x[0]) for x in held[dims]):
                yield from done(dims)

    return vectors.select("no", "embedding").mapInArrow(build, CLUSTERS)


def vectors_of(stored: DataFrame) -> DataFrame:
    """no, embedding of the vectors in clusters."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                flat = np.frombuffer(r["vectors"])
                yield pa.RecordBatch.from_arrays([pa.array(r["nos"], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(r["nos"]) + 1) * r["dims"], pa.int32()), pa.array(flat))], names=["no", "embedding"])

    return stored.select("nos", "dims", "vectors").mapInArrow(unpack, "no long, embedding array<double>")


@dataclass
class Asked:
    """The vectors of a pass's queries, all of one width; reach: the score that a query's hits need at least."""

    queries: list
    vectors: np.ndarray
    k: int
    reach: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self) -> None:
        self.reach = np.full(len(self.queries), -np.inf)


def bounds(asked: np.ndarray, centres: np.ndarray, cosines: np.ndarray, shortest: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """What no inner product of a query and a vector of a cluster is over: (queries, clusters)."""
    direction, size = unit(asked)
    apart = np.arccos(np.clip(direction @ centres.T, -1, 1)) - np.arccos(np.clip(cosines, -1, 1))[None, :]
    cosine = np.where(apart <= 0, 1.0, np.cos(apart)) + 1e-7
    return size[:, None] * np.where(cosine >= 0, cosine * longest[None, :], cosine * shortest[None, :])


def together(asked: Asked, nos: np.ndarray, m: np.ndarray, reach: np.ndarray, top: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> None:
    """Take the vectors m (numbers nos, of one segment) into top and reach, for all queries. Scores are rounded only
    where they may be among the k best."""
    segment, k, step = int(nos[0]) >> SEGMENT_BITS, asked.k, max(1, SCORES // len(nos))
    for first in range(0, len(asked.queries), step):
        score = asked.vectors[first : first + step] @ m.T
        fresh = reach[first : first + step]
        for i in np.flatnonzero(score.max(1) >= fresh - ROOM).tolist():
            q, own = first + i, score[i]
            least = reach[q] - ROOM
            if len(own) > 4 * k:
                # The k-th of the bests of groups is no more than the k-th best.
                best = own[: len(own) // (4 * k) * 4 * k].reshape(4 * k, -1).max(1)
                least = max(least, np.partition(best, 3 * k)[3 * k] - ROOM)
            fine = np.flatnonzero(own >= least)
            s, v = np.round(own[fine], 6), nos[fine]
            if (q, segment) in top:  # which may have some of these
                new = ~np.isin(v, top[q, segment][1])
                s, v = np.r_[top[q, segment][0], s[new]], np.r_[top[q, segment][1], v[new]]
            order = np.lexsort((v, -s))[:k]
            top[q, segment] = s[order], v[order]
            if len(order) == k:
                reach[q] = max(reach[q], s[order[-1]])


def scored(stored: DataFrame, asked: Asked, query_type: str, only: bool = False) -> DataFrame:
    """query_id, no, score of each task's best, and rows without no that have the vectors held and read for the query.
    stored: clusters and, if some vectors are to be left out or the only ones, marked (ranges of their part and the bits
    of each)."""
    sent = stored.sparkSession.sparkContext.broadcast(asked)
    names = [*(x.split(" ")[0] for x in CLUSTERS.split(", ")), *(["marked"] if "marked" in stored.columns else [])]
    arrow_type = pa.string() if query_type == "string" else pa.int64() if query_type == "bigint" else pa.int32()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        reach, counts = own.reach.copy(), np.zeros((len(own.queries), 2), np.int64)
        top: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def left(r: dict, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """What of a cluster is not left out; words: the marked ranges of its part, in their order, and the bits of each."""
            nos, m = np.array(r["nos"], np.int64), np.frombuffer(r["vectors"]).reshape(r["n"], r["dims"])
            if len(words):
                at = np.minimum(np.searchsorted(words[:, 0], nos >> RANGE_BITS), len(words) - 1)
                place = nos & (RANGE - 1)
                is_set = (words[at, 0] == nos >> RANGE_BITS) & ((words[at, 1 + (place >> 6)] >> (place & 63)) & 1 == 1)
                return tuple(x[is_set if only else ~is_set] for x in (nos, m))
            return (nos[:0], m[:0]) if only else (nos, m)

        def take(r: dict, asking: np.ndarray, words: np.ndarray) -> None:
            nos, m = left(r, words)
            counts[asking, 1] += len(nos)
            if not len(nos):
                return
            for first in range(0, len(asking), QUERIES):
                some = asking[first : first + QUERIES]
                score = np.round(own.vectors[some] @ m.T, 6)
                segment = int(nos[0]) >> SEGMENT_BITS
                for i in np.flatnonzero((score >= (reach[some] - ROOM)[:, None]).any(1)).tolist():
                    q = int(some[i])
                    fine = np.flatnonzero(score[i] >= reach[q] - ROOM)
                    s, v = score[i, fine], nos[fine]
                    if (q, segment) in top:
                        s, v = np.r_[top[q, segment][0], s], np.r_[top[q, segment][1], v]
                    order = np.lexsort((v, -s))[: own.k]
                    top[q, segment] = s[order], v[order]
                    if len(order) == own.k:
                        reach[q] = max(reach[q], s[order[-1]])

        # Clusters of a batch are looked at a few at a time, whose bounds and vectors alone are in memory.
        for batch in (whole.slice(r, CLUSTERS_AT_ONCE) for whole in batches for r in range(0, whole.num_rows, CLUSTERS_AT_ONCE)):
            rows = [r for r in batch.to_pylist() if r["dims"] == own.vectors.shape[1]]
            if not rows or not len(own.queries):
                continue
            sets = {}
            for r in rows:
                if r["part"] not in sets:
                    words = np.array(r.get("marked") or [], np.int64).reshape(-1, 1 + RANGE // 64)
                    sets[r["part"]] = words[np.argsort(words[:, 0])]
            counts[:, 0] += sum(r["n"] for r in rows)
            shapes = np.array([r["centre"] for r in rows]), *(np.array([r[c] for r in rows]) for c in ("cosine", "shortest", "longest"))
            most = np.concatenate([bounds(own.vectors[a : a + 16 * QUERIES], *shapes).astype(np.float32) for a in range(0, len(own.queries), 16 * QUERIES)])
            # Rounded up, as these are bounds.
            most = np.nextafter(most, np.float32(np.inf))
            best, so_far = most.argmax(1), counts[:, 1].copy()
            many = lambda most=most: len(most[0]) > 1 and 2 * np.count_nonzero(most >= (reach - ROOM)[:, None]) > most.size
            if np.isneginf(reach).any() or not many():
                for c in np.unique(best).tolist():
                    asking = np.flatnonzero((best == c) & (most[:, c] >= reach - ROOM))
                    if len(asking):
                        take(rows[c], asking, sets[rows[c]["part"]])
            if many():
                by_segment, counts[:, 1] = defaultdict(list), so_far
                for r in rows:
                    by_segment[r["part"] >> (SEGMENT_BITS - PART_BITS)].append(left(r, sets[r["part"]]))
                for held in by_segment.values():
                    nos, m = (np.concatenate([x[j] for x in held]) for j in (0, 1))
                    counts[:, 1] += len(nos)
                    if len(nos):
                        together(own, nos, m, reach, top)
                continue
            for c in np.argsort(-most.max(0), kind="stable").tolist():
                asking = np.flatnonzero((best != c) & (most[:, c] >= reach - ROOM))
                if len(asking):
                    take(rows[c], asking, sets[rows[c]["part"]])
        keys = list(top)
        told = np.flatnonzero(counts[:, 0]).tolist()
        none = [None] * len(told)
        cols = [[own.queries[q] for q, s in keys for _ in top[q, s][1]] + [own.queries[q] for q in told], [v for key in keys for v in top[key][1].tolist()] + none, [s for key in keys for s in top[key][0].tolist()] + none]
        n = len(cols[0]) - len(told)
        cols += [[None] * n + counts[told, 0].tolist(), [None] * n + counts[told, 1].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (arrow_type, pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["query_id", "no", "score", "held", "read"])

    return stored.select(*names).mapInArrow(search, f"query_id {query_type}, no long, score double, held long, read long")
