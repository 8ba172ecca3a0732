"""Enrichment and embedding: protocols for model back ends, and deterministic offline defaults."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.text import TOKEN, tokens

#: Fields of the enrichment of a chunk.
ENRICHMENT = "context string, keywords array<string>, hypothetical_questions array<string>, dates array<string>, ent_persons array<string>, ent_organizations array<string>, ent_products array<string>, ent_locations array<string>"
#: Terms whose idf is sent to the tasks, and chunks that a task weighs at once.
COMMON, SLICE = 1 << 18, 1 << 10
#: Tokens that are hashed at once.
WORDS = 1 << 16
PROMPT = "Answer in {language}. Describe the chunk by the fields below.\n{requirements}"


def prompt(language: str, requirements: dict[str, str]) -> str:
    """One instruction for all chunks; every field is written in one language, so that keyword search works across languages."""
    return PROMPT.replace("{language}", language).replace("{requirements}", "\n".join(f"- {k}: {v}" for k, v in requirements.items()))


def enriched(chunks: DataFrame, model: Callable[[pd.Series], pd.DataFrame]) -> DataFrame:
    """chunks with the fields of ENRICHMENT and a status. A batch that fails is tried row by row, and a row that fails
    says so in its status and doesn't end the job."""

    def answers(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        try:
            out = model(frame["content"])
            yield frame.assign(**{c: out[c].values for c in out.columns}, status="ok")
        except Exception as e:  # noqa: BLE001
            if len(frame) == 1:
                yield frame.assign(status=f"failed: {e}")
            else:
                for k in range(len(frame)):
                    yield from answers(frame.iloc[k : k + 1])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield from answers(frame)

    fields = [x.split(" ")[0] for x in ENRICHMENT.split(", ")]
    base = chunks.drop(*fields, "status")
    columns = [*base.columns, *fields, "status"]

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in run(frames):
            for f in fields:
                if f not in frame:
                    frame[f] = None
            yield frame[columns]

    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*base.schema.fields, *StructType.fromDDL(ENRICHMENT).fields, StructField("status", StringType())])
    return base.mapInPandas(whole, schema)


def structured(rows: DataFrame, response: str = "response") -> DataFrame:
    """rows with the fields of ENRICHMENT, parsed from a model's JSON answer, and status: ok, or failed if the answer is
    missing, is no JSON object or lacks a context. Lists that are missing are empty."""
    names = [x.split(" ")[0] for x in ENRICHMENT.split(", ")]
    answer = F.from_json(response, ENRICHMENT, {"mode": "PERMISSIVE"})
    found = rows.drop(*names, "status").withColumn("_answer", answer)
    fields = [F.col("_answer.context").alias("context"), *(F.coalesce(F.col(f"_answer.{n}"), F.array().cast("array<string>")).alias(n) for n in names[1:])]
    status = F.when(F.col("_answer.context").isNotNull(), F.lit("ok")).otherwise(F.lit("failed")).alias("status")
    return found.select(*(c for c in found.columns if c != "_answer"), *fields, status)


def split_failures(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what goes on to be embedded and written, what is only counted)."""
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    return rows.where(ok), rows.where(~ok)


def postings(docs: DataFrame, id_: str = "doc_id") -> DataFrame:
    """id, term, tf, dl of every document with tokens."""
    listed = docs.select(id_, tokens(F.col("text")).alias("t")).withColumn("dl", F.size("t"))
    return listed.select(id_, "dl", F.explode("t").alias("term")).groupBy(id_, "term", "dl").agg(F.count(F.lit(1)).alias("tf")).select(id_, "term", "tf", F.col("dl").cast("long").alias("dl"))


def statistics(posted: DataFrame, id_: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(term, df, idf) over the whole collection, and one row of n and avgdl: documents without tokens don't count."""
    docs = posted.groupBy(id_).agg(F.first("dl").alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(F.broadcast(docs)).select("term", "df", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return idf, docs


def keywords(chunks: DataFrame, k: int = 5) -> DataFrame:
    """id, rank, term, weight: the k terms of most tf * idf of each chunk.

    Postings are counted where their chunk is and never shuffled: the idf of the COMMON most frequent terms goes to the
    tasks, which keep what can be among the k best. Only postings of the terms beyond these meet their idf by a join.
    """
    own = chunks.select("id", "content")
    # Chunks of one id are one; the hashes tell cheaply whether there are such.
    if not own.groupBy(F.xxhash64("id").alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        own = own.groupBy("id").agg(F.array_join(F.collect_list("content"), "\n").alias("content"))
    listed = own.select("id", tokens(F.col("content")).alias("t"))
    df = listed.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = own.where(F.regexp_like("content", F.lit(TOKEN))).count()
    idf = df.withColumn("idf", F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))).persist(StorageLevel.DISK_ONLY)
    common = idf.orderBy(F.desc("df"), "term").limit(COMMON + 1).select("term", "idf").toArrow()
    few = common.num_rows <= COMMON
    known_ = common.slice(0, COMMON).to_pydict()
    # What the idf of the other terms is at least and at most.
    low, high = (known_["idf"] or [0.0])[-1], float(np.log1p((n - 0.5) / 1.5)) if n else 0.0
    sent = chunks.sparkSession.sparkContext.broadcast((dict(zip(known_["term"], known_["idf"])), low, high))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, low, high = sent.value
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                lists = part.column(1)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = lists.flatten().dictionary_encode()
                names, many = coded.dictionary, max(1, len(coded.dictionary))
                keys, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * many + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
                row, term = keys // many, keys % many
                own = np.array([known.get(t, np.nan) for t in names.to_pylist()] or [np.nan])[term]
                # What can't outweigh the k-th of a chunk is not among its k best.
                least, most = tf * np.nan_to_num(own, nan=low), tf * np.nan_to_num(own, nan=high)
                ends = np.searchsorted(row, np.arange(len(sizes) + 1))
                by = np.lexsort((-least, row))
                full = np.flatnonzero(np.diff(ends) >= k)
                reach = np.full(len(sizes), -np.inf)
                reach[full] = least[by][ends[full] + k - 1]
                keep = most >= reach[row] - 1e-5
                row, term, tf, own = row[keep], term[keep], tf[keep], own[keep]
                rows = np.searchsorted(row, np.arange(len(sizes) + 1))
                made = pa.StructArray.from_arrays([names.take(pa.array(term)).cast(pa.string()), pa.array(tf, pa.int64()), pa.array(own, pa.float64(), from_pandas=True)], names=["term", "tf", "idf"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(rows, pa.int32()), made)], names=["id", "x"])

    kept = listed.mapInArrow(weigh, f"id {dict(own.dtypes)['id']}, x array<struct<term: string, tf: bigint, idf: double>>")
    weighed = lambda x: F.struct((-F.round(x["tf"] * x["idf"], 6)).alias("less"), x["term"].alias("term"))
    best = lambda c: F.slice(F.array_sort(F.transform(c, weighed)), 1, k)
    shown = lambda rows: rows.select("id", (F.col("i") + 1).alias("rank"), "y.term", (-F.col("y.less")).alias("weight"))
    if few:
        return shown(kept.select("id", F.posexplode(best("x")).alias("i", "y")))
    rare = F.exists("x", lambda x: x["idf"].isNull())
    whole = shown(kept.where(~rare).select("id", F.posexplode(best("x")).alias("i", "y")))
    each = kept.where(rare).select("id", F.explode("x").alias("x")).select("id", "x.*")
    met = each.where("idf is null").drop("idf").join(idf.select("term", "idf"), "term").select("id", "term", "tf", "idf").unionByName(each.where("idf is not null"))
    scored = met.select("id", "term", F.round(F.col("tf") * F.col("idf"), 6).alias("weight"))
    w = Window.partitionBy("id").orderBy(F.desc("weight"), "term")
    rest = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "rank", "term", "weight")
    return whole.unionByName(rest)


@F.arrow_udf(ArrayType(DoubleType()))
def _bundled(terms: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    seen: dict[str, int] = {}
    for lists, wide in terms:
        d, done = wide[0].as_py() if len(wide) else 1, []
        for first in range(0, len(lists), SLICE):
            part = lists.slice(first, SLICE)
            sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, row = part.flatten(), np.repeat(np.arange(len(sizes)), sizes)
            v = np.zeros((len(sizes), d))
            for at in range(0, len(flat), WORDS):
                coded = flat.slice(at, WORDS).dictionary_encode()
                names = coded.dictionary.to_pylist()
                if len(seen) > WORDS:
                    seen.clear()
                for t in names:
                    if t not in seen:
                        seen[t] = int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "big")
                h = np.array([seen[t] for t in names], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
                v += np.bincount(row[at : at + WORDS] * d + h % d, np.where(h // d % 2 == 0, 1.0, -1.0), len(sizes) * d).reshape(v.shape)
            norm = np.sqrt((v * v).sum(1))
            some = norm > 0
            v = v[some] / norm[some, None]
            ends = np.r_[0, np.cumsum(np.where(some, d, 0))]
            done.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v.ravel(), pa.float64()), mask=pa.array(~some)))
        yield pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.float64()))


def hashed_vector(text: Column, dims: int = 64) -> Column:
    """Signed MD5 feature hashing of tokens, scaled to unit length; null where nothing is left. The offline embedder.
    Each different token of a batch is hashed once, and a task holds the vectors of SLICE texts at a time."""
    return _bundled(tokens(F.coalesce(text, F.lit(""))), F.lit(dims))


#: text column -> vector column; a model back end is a pandas_udf with this shape.
Embedder = Callable[[Column], Column]


def vector_weights(vectors: DataFrame, id_: str = "doc_id") -> DataFrame:
    """id, dim, weight: the parts of (id, embedding) that are not 0."""
    return vectors.select(id_, F.posexplode("embedding").alias("dim", "weight")).where("weight <> 0")
