"""Retrieval: dense, sparse and hybrid top-k, reranking, and expansion by entities and neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .filters import ENTITY_FIELDS

K1, B = 1.2, 0.75
#: Queries whose vectors are broadcast at once.
QUERY_BLOCK = 4096
#: Queries and vectors whose scores are in memory at once.
SCORES = 128, 1 << 14
#: Ids that are sent to the chunks.
FEW = 1 << 18


def ranked(scored: DataFrame, k: int, by: str = "query_id", id_: str = "doc_id") -> DataFrame:
    """The k best of each query, by score rounded to six places and then id, with their rank."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), id_)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def usable(embedding: Column, dims: int | None = None) -> Column:
    """Whether a vector can be scored: no null or non-finite parts and, if given, of so many dimensions."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(embedding) > 0)
    return F.coalesce(fine if dims is None else fine & (F.size(embedding) == dims), F.lit(False))


def dense(base: DataFrame, queries: DataFrame, k: int, id_: str = "doc_id") -> DataFrame:
    """query_id, id, score, rank by inner product. base: id, embedding; queries: query_id, embedding."""
    return ranked(dense_hits(base, queries, k, id_), k, id_=id_)


def dense_hits(base: DataFrame, queries: DataFrame, k: int, id_: str = "doc_id") -> DataFrame:
    """query_id, id, score: the k best of each task, and what ties with them.

    Queries go out in blocks of bounded size, and each task keeps its own k best of each query before the merge. The
    number of dimensions is that of the first usable query; vectors that are null, hold nulls or non-finite parts, or
    have other dimensions take no part. Query ids are numbers.
    """
    spark = base.sparkSession
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("e")).where(usable(F.col("e"))).persist()
    first, n = asked.first(), asked.count()
    dims = len(first["e"]) if first else 0
    blocks = max(1, -(-n // QUERY_BLOCK))
    own = base.select(id_, F.col("embedding").cast("array<double>").alias("e")).where(usable(F.col("e"), dims))
    found = []
    for b in range(blocks):
        rows = asked.where((F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) & (F.size("e") == dims)).collect()
        sent = spark.sparkContext.broadcast((np.array([r["query_id"] for r in rows], np.int64), np.array([r["e"] for r in rows]).reshape(len(rows), dims)))

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            for batch in (whole.slice(r, SCORES[1]) for whole in batches for r in range(0, whole.num_rows, SCORES[1])):
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                vectors = flat.reshape(batch.num_rows, -1).T
                keep = min(k, batch.num_rows)
                for a in range(0, len(names), SCORES[0]):
                    s = np.round(q[a : a + SCORES[0]] @ vectors, 6)
                    cut = np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep, None]
                    qi, di = np.nonzero(s >= cut)
                    yield pa.RecordBatch.from_arrays([pa.array(names[a + qi], pa.int64()), batch.column(0).take(pa.array(di)), pa.array(s[qi, di])], names=["query_id", id_, "score"])

        found.append(own.mapInArrow(score, f"query_id long, {id_} {dict(base.dtypes)[id_]}, score double"))
    asked.unpersist()
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.withColumn("score", F.round("score", 6))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: the distinct tokens of queries (query_id, query)."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))


def bm25(average: float) -> Column:
    """The weight of a posting (tf, dl, idf), where the collection's documents have so many tokens on average."""
    return F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(average)))


def sparse(posted: DataFrame, terms: DataFrame, k: int, allowed: DataFrame | None = None, id_: str = "doc_id") -> DataFrame:
    """query_id, id, score, rank by BM25. posted: bucket, term, id, weight; terms: query_id, bucket, term. Weights are of
    the whole collection, allowed are the ids a filter leaves."""
    hits = posted.select("bucket", "term", id_, "weight").join(terms, ["bucket", "term"])
    if allowed is not None:
        hits = hits.join(allowed.select(id_), id_, "left_semi")
    return ranked(hits.groupBy("query_id", id_).agg(F.round(F.sum("weight"), 6).alias("score")), k, id_=id_)


def hybrid(dense_hits: DataFrame, sparse_hits: DataFrame, *ids: str) -> DataFrame:
    """query_id, ids, from_dense, from_sparse: both candidate lists, one row per id; their scores are not combined."""
    d = dense_hits.select("query_id", *ids, F.lit(True).alias("from_dense"), F.lit(False).alias("from_sparse"))
    s = sparse_hits.select("query_id", *ids, F.lit(False).alias("from_dense"), F.lit(True).alias("from_sparse"))
    return d.unionByName(s).groupBy("query_id", *ids).agg(F.max("from_dense").alias("from_dense"), F.max("from_sparse").alias("from_sparse"))


def rerank(candidates: DataFrame, posted: DataFrame, idf: DataFrame, terms: DataFrame, k: int, threshold: float | None = None, id_: str = "doc_id") -> DataFrame:
    """query_id, id, score, rank: the share of the query's idf that a candidate's terms cover, k best, at least threshold.
    terms: query_id, bucket, term; only their buckets are read."""
    known = idf.join(terms, ["bucket", "term"])
    whole = known.groupBy("query_id").agg(F.sum("idf").alias("whole"))
    asked = posted.select("bucket", "term", id_, "idf").join(terms.select("bucket", "term"), ["bucket", "term"], "left_semi")
    held = asked.join(candidates.select("query_id", id_), id_).join(terms, ["query_id", "bucket", "term"])
    part = held.groupBy("query_id", id_).agg(F.sum("idf").alias("part"))
    scored = candidates.select("query_id", id_).join(part, ["query_id", id_], "left").join(whole, "query_id", "left")
    scored = scored.select("query_id", id_, F.round(F.coalesce(F.try_divide("part", "whole"), F.lit(0.0)), 6).alias("score"))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return ranked(scored, k, id_=id_)


def _tags() -> Column:
    """All entities of a chunk; a kind that is null has none."""
    return F.flatten(F.array(*(F.coalesce(f, F.array().cast("array<string>")) for f in ENTITY_FIELDS)))


def entities_of(chunks: DataFrame, seeds: DataFrame) -> DataFrame:
    """entity: the distinct entities of the seeds (id), of all four kinds."""
    asked = seeds.select("id").distinct().persist(StorageLevel.DISK_ONLY)
    return chunks.join(F.broadcast(asked) if asked.count() <= FEW else asked, "id", "left_semi").select(F.explode(_tags()).alias("entity")).where("entity is not null").distinct()


def related(chunks: DataFrame, seeds: DataFrame) -> DataFrame:
    """id of chunks that share an entity of any kind with the seeds, without the seeds; none if these have no entities."""
    tags = chunks.select("id", F.explode(_tags()).alias("entity"))
    return tags.join(entities_of(chunks, seeds), "entity", "left_semi").select("id").distinct().join(seeds.select("id"), "id", "left_anti")


def neighbours(chunks: DataFrame, seeds: DataFrame, window: int = 1) -> DataFrame:
    """The chunks within window of a seed in its source, seeds included, each once. The places near a few seeds go to the
    chunks, which are not moved but for those that are near."""
    asked = seeds.select("id").distinct().persist(StorageLevel.DISK_ONLY)
    few = asked.count() <= FEW
    sent = F.broadcast if few else lambda x: x
    at = chunks.join(sent(asked), "id", "left_semi").where(F.col("chunk_index").isNotNull())
    last = F.coalesce("total_chunks", F.col("chunk_index") + window + 1) - 1
    spans = at.select(F.col("source").alias("s"), F.greatest(F.col("chunk_index") - window, F.lit(0)).alias("lo"), F.least(F.col("chunk_index") + window, last).alias("hi"))
    # By place and not by range, so that a source of very many chunks and seeds is no product of both.
    places = spans.select("s", F.explode(F.expr("if(lo <= hi, sequence(lo, hi), array())")).alias("i")).distinct()
    return chunks.join(sent(places), (F.col("source") == F.col("s")) & (F.col("chunk_index") == F.col("i")), "left_semi")


def neighbours_by_window(chunks: DataFrame, seeds: DataFrame, window: int = 1) -> DataFrame:
    """The same on clean data, as a range window over each source."""
    seen = chunks.join(seeds.select("id").distinct().withColumn("seed", F.lit(1)), "id", "left")
    w = Window.partitionBy("source").orderBy("chunk_index").rangeBetween(-window, window)
    return seen.withColumn("near", F.max("seed").over(w)).where("near = 1").select(chunks.columns)


def hint(n: Column) -> Column:
    return F.when(n == 0, F.lit("No hits: try other words, or English.")).otherwise(F.concat(F.lit("Read the best of "), n.cast("string"), F.lit(" hits before citing.")))
