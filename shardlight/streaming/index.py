"""Incremental indexing of documents: streams, exactly once by chunk id; what failed is tried again; what changed is
found by source and time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.documents import Store
from ..sources.segments import Commits, Index


def index_stream(docs: DataFrame, store: Store | Index, checkpoint: str, chunk: Callable[[DataFrame], DataFrame], status: str, replace_source: bool = False) -> StreamingQuery:
    """Each micro-batch is chunked (chunk: documents -> chunks with id and source) and upserted by id, into a
    store or an index that is searched: a batch that runs again changes nothing. A batch that fails leaves the store as it was and doesn't end the stream; what became of
    each batch is appended to the table status: batch, status (ok or failed), documents, error."""

    def upsert(batch: DataFrame, number: int) -> None:
        error = None
        try:
            store.upsert(chunk(batch), "id", replace_source)
        except Exception as e:  # noqa: BLE001
            error = str(e)[:1000]
        said = batch.agg(F.count(F.lit(1)).alias("documents"))
        said.select(F.lit(number).cast("long").alias("batch"), F.lit("failed" if error else "ok").alias("status"), "documents", F.lit(error).cast("string").alias("error")).write.mode("append").parquet(status)

    return docs.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_states(rows: DataFrame) -> DataFrame:
    """batch, status, documents, error of a status table: the last word on each batch, as one that ran again says it twice."""
    return rows.groupBy("batch").agg(F.min_by(F.struct("status", "documents", "error"), F.when(F.col("status") == "ok", 0).otherwise(1)).alias("x")).select("batch", "x.*")


class Queue:
    """The documents that failed, with attempts and error: one state, replaced by the commit of each batch."""

    def __init__(self, docs: DataFrame, path: str):
        self.spark, self.path, self.schema = docs.sparkSession, path.rstrip("/"), docs.schema
        self.commits = Commits(self.spark, self.path)

    def read(self) -> DataFrame:
        """The columns of the documents, attempts, error."""
        commit = self.commits.read(self.commits.version())
        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields) + ", attempts int, error string"
        return self.spark.read.schema(names).parquet(f"{self.path}/{commit['at']}") if commit else self.spark.createDataFrame([], names)

    def replace(self, failed: DataFrame, version: int) -> None:
        at = f"data/{uuid.uuid4().hex}"
        failed.write.parquet(f"{self.path}/{at}")
        self.commits.add({"at": at}, version + 1)


def index_with_retries(docs: DataFrame, index: Index, checkpoint: str, chunk: Callable[[DataFrame], DataFrame], queue: str, most: int = 3, key: str = "source") -> StreamingQuery:
    """Each micro-batch, and with it the queued documents that failed fewer than most times, is chunked and upserted;
    newer versions of a document (key) take the place of queued ones. chunk: documents -> chunks, with the key and,
    where single documents can fail, status (ok, or what went wrong; such rows are no chunks). A document that fails is
    queued, as are all of a batch whose chunking fails as a whole; the index then keeps what it had of them. A batch
    that runs again after a crash does the same again. Documents that used up their attempts stay in the queue, to be
    read from there."""
    own = Queue(docs, queue)

    def upsert(batch: DataFrame, number: int) -> None:
        version = own.commits.version()
        waiting = own.read().join(batch.select(key).distinct(), key, "left_anti")
        again = waiting.where(F.col("attempts") < most)
        columns = [*docs.columns, "attempts"]
        todo = batch.withColumn("attempts", F.lit(0)).select(columns).unionByName(again.select(columns))
        stage = f"{own.path}/staged/{uuid.uuid4().hex}"
        todo.write.parquet(f"{stage}/docs")
        todo = batch.sparkSession.read.schema(todo.schema).parquet(f"{stage}/docs")
        try:
            made = chunk(todo.drop("attempts"))
            made = made if "status" in made.columns else made.withColumn("status", F.lit("ok"))
            made.write.parquet(f"{stage}/chunks")
            made = batch.sparkSession.read.schema(made.schema).parquet(f"{stage}/chunks")
            bad = made.where(~F.coalesce(F.col("status") == "ok", F.lit(False))).groupBy(key).agg(F.min(F.coalesce("status", F.lit("failed"))).alias("error"))
            index.upsert(made.join(bad, key, "left_anti").drop("status"), replace_source=True)
            failed = todo.join(bad, key)
        except Exception as e:  # noqa: BLE001
            failed = todo.withColumn("error", F.lit(str(e)[:1000]))
        failed = failed.withColumn("attempts", (F.col("attempts") + 1).cast("int")).select(*columns, "error")
        own.replace(failed.unionByName(waiting.where(F.col("attempts") >= most).select(*columns, "error")), version)

    return docs.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes(listing: DataFrame, index: Index) -> tuple[DataFrame, DataFrame]:
    """(the rows of listing (source, modified_at and more) that the index lacks or has an older version of, the sources
    (source) that the index has and listing doesn't)."""
    if not index.version():
        return listing, listing.select("source").limit(0)
    known = index.snapshot().chunks().groupBy("source").agg(F.max("modified_at").alias("_known"))
    fresh = listing.join(known, "source", "left").where(F.col("_known").isNull() | (F.col("modified_at") > F.col("_known"))).select(listing.columns)
    return fresh, known.join(listing.select("source"), "source", "left_anti").select("source")


def sync(listing: DataFrame, index: Index, chunk: Callable[[DataFrame], DataFrame]) -> None:
    """Make the index one of listing: new and newer documents are chunked (chunk: rows of listing -> chunks with source
    and modified_at), those that are no longer listed go, all others are left as they are."""
    fresh, stale = changes(listing, index)
    gone = index.snapshot().chunks().join(stale, "source", "left_semi").select("id") if index.version() else None
    if gone is not None:
        index.delete(gone)
    index.upsert(chunk(fresh), replace_source=True)
