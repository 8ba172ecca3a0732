"""Chunks over the driver's documents, one a line, with made-up metadata that exercises every predicate; the tables
hold none. Only the queries of this package use it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ENTITY, chunk_id
from ..operators.filters import ENTITY_FIELDS
from ..operators.tools import Collection
from ..session import table, workspace
from ..sources.segments import Index


def line_chunks(docs: DataFrame) -> DataFrame:
    lines = docs.select("doc_id", "lang", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source"), F.size(F.split("text", "\n")).alias("total_chunks"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    rows = lines.withColumn("ents", F.array_distinct(F.regexp_extract_all("content", F.lit(ENTITY), F.lit(0))))
    of = lambda k: F.array_sort(F.filter("ents", lambda x: F.length(x) % 4 == k))
    kinds = {f: of(k) for k, f in enumerate(ENTITY_FIELDS)}
    stamp = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 90 as int), 23, 59, 59 + ((doc_id div 90) % 2) * 0.5)")
    dates = F.expr("case doc_id % 3 when 0 then cast(array() as array<string>) when 1 then array(cast(date_add(date'2024-01-01', cast(doc_id % 365 as int)) as string)) else array('2019-01-01', '2030-01-01') end")
    types = F.when(F.col("chunk_index") % 7 == 0, F.array(F.lit("table"), F.lit("text"))).otherwise(F.array(F.lit("text")))
    full = rows.withColumns({"headings": F.array("lang"), "page_number": F.floor(F.col("chunk_index") / 5).cast("int"), "content_types": types, "modified_at": stamp, "dates": dates, "keywords": F.array_sort("ents"), **kinds})
    return full.withColumn("id", chunk_id(F.col("source"), F.col("chunk_index"), F.col("content")))


_INDEXED: dict[tuple[str, str, str], str] = {}


def collection(spark: SparkSession, sf_dir: str, analysis: str = "plain") -> Collection:
    """The index of the chunks of sf_dir: written once in a session, and then read by every search. What
    a search reads beside the chunks is made by the first that does."""
    key = (spark.sparkContext.applicationId, sf_dir, analysis)
    if key not in _INDEXED:
        path = f"{workspace(spark)}/shardlight-index/{'-'.join(key).replace('/', '_').replace(':', '_')}"
        Index(spark, path, analysis=analysis, tables=[]).replace(line_chunks(table(spark, sf_dir, "documents")))
        _INDEXED[key] = path
    return Collection(spark, _INDEXED[key])
