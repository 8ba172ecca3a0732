"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir or the context names it. A local session without
    one gets a temporary folder; on a cluster, where that would be one machine's own, it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shardlight-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shardlight/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete what written() wrote for frames that nothing reads any more."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of jobs whose frames are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def docs_of(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, null text as empty: other columns can't clash."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def integers(embeddings: DataFrame, scale: int, *more: Column, keyed: bool = True) -> DataFrame:
    """vec_id, more, ints (each component times scale, rounded down), square (their squared length) of vectors that
    are there with all components finite; not of those whose squared length is over 2**56, as products of these need
    not be longs; if keyed, not of those without vec_id either."""
    fine = (F.col("vec_id").isNotNull() | F.lit(not keyed)) & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = embeddings.where(fine).select("vec_id", *more, F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("ints"))
    square = F.aggregate("ints", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return ints.withColumn("square", square).where(F.col("square") <= 2.0**56)


def matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """The integers of lists as rows of one width, padded with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), dims), np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def smallest_type(m: np.ndarray) -> np.dtype:
    """The smallest of the signed integers of two bytes or more that holds the values."""
    return next(np.dtype(t) for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= m.min(initial=0) and m.max(initial=0) <= np.iinfo(t).max)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that nearby sums give unrelated keys."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, self.base, np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, self.inverse, np.uint64)], dtype=np.uint64)
        return self.up[:n], self.down[:n]


POWERS = Powers(0x9E3779B97F4A7C15)


def word_hashes(text: bytes, is_word: np.ndarray) -> np.ndarray:
    """64-bit hashes of the maximal runs of word bytes of text. is_word: 256 booleans."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = is_word[raw]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = POWERS.get(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
