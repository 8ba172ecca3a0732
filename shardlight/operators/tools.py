"""A stored collection of chunks and the seven read-only tools over it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import signed_url, snippet, source_url
from ..session import SETTINGS, Settings
from ..sources.segments import Index, chunk_terms, query_terms, weighed
from . import enrich, retrieve
from .filters import Filter


def within(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be in [{low}, {high}]")
    return value


def index(chunks: DataFrame, path: str, embed: enrich.Embedder | None = None, settings: Settings = SETTINGS) -> None:
    """Make the index at path one of these chunks alone. The chunk's metadata and content are embedded, as what a search
    compares with. Index.upsert adds to what is there."""
    Index(chunks.sparkSession, path, embed, settings).replace(chunks)


#: (query, content of a candidate) -> score; a cross-encoder is a pandas_udf with this shape.
Reranker = Callable[[Column, Column], Column]


class Collection:
    """The index at path as its last commit has it, or as an earlier version. Searches read the blocks of their terms,
    the vectors, and the chunks they rank; hits are (query_id, rank, id, score) with what hit() shows, and their ids are
    what the reading tools take."""

    def __init__(self, spark: SparkSession, path: str, embed: enrich.Embedder | None = None, rerank: Reranker | None = None, settings: Settings = SETTINGS, version: int | None = None):
        self.spark, self.path, self.settings, self.rerank = spark, path, settings, rerank
        self.embed = embed or (lambda text: enrich.hashed_vector(text, settings.embedding_dim))
        self.state = Index(spark, path, embed, settings).snapshot(version)

    @cached_property
    def chunks(self) -> DataFrame:
        return self.state.chunks()

    def _top(self, hits: DataFrame, k: int) -> DataFrame:
        """query_id, no, score, rank: the k best by score and then id, of hits that hold all that tie with the k-th.
        In a segment numbers follow ids."""
        if len(self.state.commit["segments"]) < 2:
            return retrieve.ranked(hits.select("query_id", "no", "score"), k, id_="no")
        return retrieve.ranked(hits.join(self.state.ids(), "no").select("query_id", "no", "id", "score"), k, id_="id").drop("id")

    def _terms(self, queries: DataFrame) -> DataFrame:
        return query_terms(queries, self.state.commit["analysis"])

    def _dense(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        asked = queries.select("query_id", self.embed(F.col("query")).alias("embedding"))
        return self._top(self.state.dense(asked, k, allowed)[0], k)

    def _sparse(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        return self._top(self.state.sparse(self._terms(queries), k, allowed)[0], k)

    def _candidates(self, queries: DataFrame, before: int, allowed: DataFrame | None = None) -> DataFrame:
        return retrieve.hybrid(self._dense(queries, before, allowed), self._sparse(queries, before, allowed), "no")

    def dense(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """query_id, no, id, score, rank; allowed (no): the chunks that a filter leaves."""
        return self.state.looked_up(self._dense(queries, k, allowed), "id")

    def sparse(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """The same by BM25."""
        return self.state.looked_up(self._sparse(queries, k, allowed), "id")

    def reads(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, held, read: the postings of the query's terms, and how many of them a search for k reads."""
        return self.state.sparse(self._terms(queries), k)[1]

    def multiplied(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, held, read: the vectors there are, and how many of them a search for k multiplies."""
        return self.state.dense(queries.select("query_id", self.embed(F.col("query")).alias("embedding")), k)[1]

    def candidates(self, queries: DataFrame, before: int = 30, allowed: DataFrame | None = None) -> DataFrame:
        """query_id, no, id, from_dense, from_sparse."""
        return self.state.looked_up(self._candidates(queries, before, allowed), "id")

    def _reranked(self, candidates: DataFrame, queries: DataFrame, after: int, threshold: float | None) -> DataFrame:
        """The chunks of the best candidates with query_id, score, rank."""
        rows = self.state.looked_up(candidates.select("query_id", "no"))
        if self.rerank is None:
            asked = weighed(self._terms(queries), self.state)
            own = chunk_terms(self.state.schema.names, self.state.commit["analysis"])
            add = lambda a, x: a + x["idf"]
            share = F.try_divide(F.aggregate(F.filter("terms", lambda x: F.array_contains("_own", x["term"])), F.lit(0.0), add), F.aggregate("terms", F.lit(0.0), add))
            scored = rows.withColumn("_own", F.array_distinct(own)).join(asked, "query_id", "left").withColumn("score", F.round(F.coalesce(share, F.lit(0.0)), 6)).drop("_own", "terms")
        else:
            scored = rows.join(queries.select("query_id", "query"), "query_id").withColumn("score", F.round(self.rerank(F.col("query"), F.col("content")), 6)).drop("query")
        return retrieve.ranked(scored if threshold is None else scored.where(F.col("score") >= threshold), after, id_="id")

    def reranked(self, candidates: DataFrame, queries: DataFrame, after: int = 5, threshold: float | None = None) -> DataFrame:
        """query_id, no, id, score, rank by the reranker, or by the share of the query's idf that the chunk's terms cover."""
        return self._reranked(candidates, queries, after, threshold).select("query_id", "no", "id", "score", "rank")

    def _found(self, candidates: DataFrame, queries: DataFrame, after: int) -> DataFrame:
        best = self._reranked(candidates, queries, within("top_k_after", after, 3, 10), self.settings.rerank_threshold)
        return hit(best, self.settings, "query_id", "rank", "score").select("query_id", "rank", "id", "score", *HIT[1:])

    def keyword_and_semantic_search(self, queries: DataFrame, before: int = 30, after: int = 5) -> DataFrame:
        return self._found(self._candidates(queries, within("top_k_before", before, 20, 60)), queries, after)

    def semantic_search(self, queries: DataFrame, before: int = 30, after: int = 5) -> DataFrame:
        return self._found(self._dense(queries, within("top_k_before", before, 20, 60)), queries, after)

    def keyword_search(self, queries: DataFrame, before: int = 30, after: int = 5) -> DataFrame:
        return self._found(self._sparse(queries, within("top_k_before", before, 20, 60)), queries, after)

    def filtered_search(self, queries: DataFrame, filter_: Filter, before: int = 30, after: int = 5) -> DataFrame:
        """The filter holds in both branches, before their top-k."""
        return self._found(self._candidates(queries, within("top_k_before", before, 20, 60), self.state.allowed(filter_)), queries, after)

    def find_related(self, seeds: DataFrame, queries: DataFrame, before: int = 30, after: int = 5) -> DataFrame:
        """Dense search among chunks that share an entity with the seeds (id), which are left out."""
        return self._found(self._dense(queries, within("top_k_before", before, 20, 60), self.state.related(seeds)), queries, after)

    def read_chunk(self, ids: DataFrame) -> DataFrame:
        return content(self.chunks.join(ids.select("id"), "id", "left_semi"), self.settings)

    def read_neighbors(self, ids: DataFrame, window: int = 1) -> DataFrame:
        near = retrieve.neighbours(self.chunks, ids, within("window", window, 1, 10))
        return content(near, self.settings, "chunk_index").orderBy(F.coalesce("source", F.lit("")), F.coalesce("chunk_index", F.lit(0)))


HIT = ("id", "source", "url", "page", "headings", "snippet")


def _url(settings: Settings) -> Column:
    return source_url(signed_url(settings.url_prefix, F.col("source"), settings.url_seconds), F.col("page_number")).alias("url")


def hit(chunks: DataFrame, settings: Settings = SETTINGS, *more: str) -> DataFrame:
    """id, source, url, page, headings, snippet of chunks: its context, or else the first characters of its content."""
    context = F.col("context") if "context" in chunks.columns else F.lit("")
    return chunks.select("id", "source", _url(settings), F.col("page_number").alias("page"), F.array_join("headings", " > ").alias("headings"), snippet(context, F.col("content"), settings.snippet_chars).alias("snippet"), *more)


def content(chunks: DataFrame, settings: Settings = SETTINGS, *more: str) -> DataFrame:
    """id, source, url, page, content of chunks."""
    return chunks.select("id", "source", _url(settings), F.col("page_number").alias("page"), "content", *more)
