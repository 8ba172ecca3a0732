"""Golden sets and retrieval metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip, tokens


def usable(docs: DataFrame, least: int = 100) -> DataFrame:
    """Documents of at least so many characters between white space at the ends."""
    return docs.where(F.col("text").isNotNull() & (F.length(strip(F.col("text"))) >= least))


def sample(docs: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """n documents in a seeded order that does not depend on the scan."""
    return docs.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))).orderBy("draw", "doc_id").limit(n)


def first_words(text: Column, words: int = 3) -> Column:
    """The offline question about a text: its first words."""
    return F.array_join(F.slice(tokens(text), 1, words), " ")


def golden(docs: DataFrame, ask: Callable[[Column], Column] = first_words) -> DataFrame:
    """query, relevant_chunk_ids: a question about each document's text, asked by ask (a model is a pandas_udf), without
    white space at its ends; blank questions are dropped."""
    q = strip(ask(F.col("text")))
    return docs.select(q.alias("query"), F.array(F.col("doc_id").cast("string")).alias("relevant_chunk_ids")).where("query <> ''")


GOLDEN = "struct<query: string, relevant_chunk_ids: array<string>>"


def exploded(lines: DataFrame) -> DataFrame:
    """query, chunk_id of JSON lines (value)."""
    return lines.select(F.from_json("value", GOLDEN).alias("g")).select("g.query", F.explode("g.relevant_chunk_ids").alias("chunk_id"))


def write_golden(sets: DataFrame, path: str) -> None:
    """A golden set as JSON, one object a line; it is a bounded sample, so one file holds it."""
    sets.coalesce(1).write.mode("overwrite").json(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """query, relevant_chunk_ids of JSON lines, or of one JSON array over several lines."""
    lines = spark.read.schema("query string, relevant_chunk_ids array<string>").json(path, mode="PERMISSIVE")
    if lines.where("query is not null").isEmpty():
        return spark.read.schema(lines.schema).json(path, multiLine=True)
    return lines


def hits(relevant: DataFrame, retrieved: DataFrame, id_: str = "doc_id") -> DataFrame:
    """mode, query_id, rank, hit of the retrieved, for the queries that have relevant documents."""
    known = retrieved.join(relevant.select("query_id").distinct(), "query_id", "left_semi")
    marked = known.join(relevant.select("query_id", id_, F.lit(1).alias("hit")), ["query_id", id_], "left")
    return marked.select("mode", "query_id", "rank", F.coalesce("hit", F.lit(0)).alias("hit"))


def metrics(relevant: DataFrame, retrieved: DataFrame, modes: list[str], id_: str = "doc_id") -> DataFrame:
    """mode, metric, score: recall with one hit and with all, MRR, and MAP over the relevant that were retrieved."""
    spark = relevant.sparkSession
    every = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).join(spark.createDataFrame([(m,) for m in modes], "mode string"))
    run = Window.partitionBy("mode", "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    seen = hits(relevant, retrieved, id_).withColumn("so_far", F.sum("hit").over(run))
    by_query = seen.groupBy("mode", "query_id").agg(
        F.max("hit").alias("any"), F.sum("hit").alias("got"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.avg(F.when(F.col("hit") == 1, F.col("so_far") / F.col("rank"))).alias("ap")
    )
    each = every.join(by_query, ["mode", "query_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    wide = each.groupBy("mode").agg(
        F.avg(zero(F.col("any").cast("double"))).alias("recall_single"), F.avg(zero(F.col("got") / F.col("n"))).alias("recall_multi"), F.avg(zero(1 / F.col("first"))).alias("mrr"), F.avg(zero(F.col("ap"))).alias("map")
    )
    return wide.select("mode", F.expr("stack(4, 'recall_single', recall_single, 'recall_multi', recall_multi, 'mrr', mrr, 'map', map) as (metric, score)")).withColumn("score", F.round("score", 6))


def report(scores: DataFrame) -> DataFrame:
    """One row per mode, four decimals."""
    return scores.groupBy("mode").pivot("metric", ["recall_single", "recall_multi", "mrr", "map"]).agg(F.round(F.first("score"), 4))


def batch_summary(rows: DataFrame) -> DataFrame:
    """batch, written, failed, all_ok of rows (batch, status)."""
    ok = F.col("status") == "ok"
    return rows.groupBy("batch").agg(F.sum(F.when(ok, 1).otherwise(0)).cast("long").alias("written"), F.sum(F.when(ok, 0).otherwise(1)).cast("long").alias("failed"), F.bool_and(ok).alias("all_ok"))
