"""Sources: files and tables as documents, batches, and the store with its upsert."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import basename, iso_utc


def files(spark: SparkSession, *paths: str) -> DataFrame:
    """source, modified_at, content of local or remote files, one row each."""
    raw = spark.read.format("binaryFile").load(list(paths))
    return raw.select(basename(F.col("path")).alias("source"), iso_utc(F.col("modificationTime")).alias("modified_at"), F.col("path"), F.col("content"))


def numbered(df: DataFrame, key: str, name: str = "ordinal", width: int = 4096) -> DataFrame:
    """Ordinals from 0 in the order of an integer key. Keys fall into ranges and these into wider ones; the counts of
    wide ranges, summed up in one task, give each its first ordinal, and so on down, so that no task sees all rows."""
    spot = df.withColumn("_range", F.floor(F.col(key) / width)).withColumn("_wide", F.floor(F.col("_range") / width))
    small = spot.groupBy("_wide", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wide = small.groupBy("_wide").agg(F.sum("_n").alias("_n")).select("_wide", before(Window.orderBy("_wide")).alias("_base"))
    first = small.select("_wide", "_range", before(Window.partitionBy("_wide").orderBy("_range")).alias("_first")).join(wide, "_wide")
    own = F.row_number().over(Window.partitionBy("_wide", "_range").orderBy(key))
    joined = spot.withColumn("_own", own).join(first, ["_wide", "_range"])
    return joined.withColumn(name, (F.col("_own") - 1 + F.col("_first") + F.col("_base")).cast("long")).drop("_range", "_wide", "_own", "_first", "_base")


def batches(df: DataFrame, key: str, size: int = 3) -> DataFrame:
    return numbered(df, key).withColumn("batch", F.floor(F.col("ordinal") / size).cast("long"))


def latest(rows: DataFrame, key: str = "id", order: str | None = "batch") -> DataFrame:
    """One row per id, that of the last batch; among equal ones the choice depends on their values alone."""
    last = [F.desc(order)] if order and order in rows.columns else []
    w = Window.partitionBy(key).orderBy(*last, F.xxhash64(*rows.columns))
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


class Store:
    """A Parquet collection that is overwritten by id.

    Rows lie in buckets by a hash of the id. An upsert writes new files for the buckets it touches and then a commit,
    a small file with the next number that says where each bucket's files are; the commit with the highest number
    holds. A crash before the commit changes nothing, and a commit that another writer took is an error. dims, if
    given, is what the first commit records and later openings must agree with.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, dims: int | None = None):
        self.spark, self.path, self.buckets, self.dims = spark, path.rstrip("/"), buckets, dims
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        last = self._commit()
        if last:
            self.buckets = last["buckets"]
            if dims is not None and last["dims"] not in (None, dims):
                raise ValueError(f"the store has {last['dims']} dimensions, not {dims}")

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """The number of the last commit; 0 if there is none."""
        if not self._fs.exists(self._at("commits")):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("commits"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def _commit(self) -> dict | None:
        v = self.version()
        return json.loads(self.spark.read.text(f"{self.path}/commits/{v:012d}.json", wholetext=True).first()["value"]) if v else None

    def _rows(self, commit: dict | None, only: list[int] | None = None) -> DataFrame | None:
        if not commit:
            return None
        at = [f"{self.path}/{d}" for b, d in commit["files"].items() if only is None or int(b) in only]
        schema = StructType.fromJson(commit["schema"])
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        """All rows; None if nothing was ever written."""
        return self._rows(self._commit())

    def upsert(self, rows: DataFrame, key: str = "id", replace_source: bool = False, order: str | None = None) -> None:
        """Rows replace stored rows of the same id, the last by order if an id is repeated; replace_source drops other
        rows of their sources as well."""
        old, v = self._commit(), self.version()
        bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int").alias("_bucket")
        fresh = latest(rows, key, order)
        touched = {r[0] for r in fresh.select(bucket).distinct().collect()}
        if old and replace_source:
            gone = self._rows(old).join(fresh.select("source").distinct(), "source", "left_semi")
            touched |= {r[0] for r in gone.select(bucket).distinct().collect()}
        before, all_ = self._rows(old, sorted(touched)), fresh
        if before is not None:
            kept = before.join(fresh.select("source").distinct(), "source", "left_anti").select(before.columns) if replace_source else before
            kept = kept.join(fresh.select(key), key, "left_anti").select(before.columns)
            all_ = kept.unionByName(fresh, allowMissingColumns=True)
        name = f"data/{uuid.uuid4().hex}"
        all_.select("*", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        made = {f.getPath().getName().split("=")[1] for f in self._fs.listStatus(self._at(name)) if "=" in f.getPath().getName()}
        files = {b: d for b, d in (old["files"] if old else {}).items() if int(b) not in touched}
        files |= {b: f"{name}/_bucket={b}" for b in sorted(made)}
        self._write({"buckets": self.buckets, "dims": self.dims if not old else old["dims"], "schema": json.loads(all_.schema.json()), "files": files}, v + 1)

    def _write(self, commit: dict, v: int) -> None:
        draft, last = self._at(f"commits/.{uuid.uuid4().hex}"), self._at(f"commits/{v:012d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        if self._fs.exists(last) or not self._fs.rename(draft, last):
            self._fs.delete(draft, False)
            raise RuntimeError(f"another writer took version {v}; read again and retry")

    def vacuum(self) -> None:
        """Delete files that the last commit doesn't name; no one may be reading an older version or writing."""
        commit = self._commit()
        named = {d.split("/")[1] for d in commit["files"].values()} if commit else set()
        for f in self._fs.listStatus(self._at("data")) if self._fs.exists(self._at("data")) else ():
            if f.getPath().getName() not in named:
                self._fs.delete(f.getPath(), True)


def by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks of the given ids: repeated ids count once, unknown ones vanish."""
    return chunks.join(ids.select("id"), "id", "left_semi")
