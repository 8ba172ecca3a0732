"""An index in immutable segments, which is searched as it grows.

A segment holds the chunks of one write, numbered in the order of their ids, and by number their vectors, postings
(blockmax), entities and values to filter by; it is never changed. Chunks that a later write replaces or deletes are
listed as gone, with what they take from the collection's statistics. A commit is one small file with the next number:
the segments, the lists of what is gone, and the totals. So a reader has one state of everything, whatever is written meanwhile, and a crash leaves the
last commit as it was. What is made from the chunks can be left to the first reader that asks for it. Statistics are those of the whole collection at each commit: document frequencies are summed
over segments and lists, and no weight is stored that a later write would change. Small segments are merged.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import cached_property, reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.analysis import terms as language_terms
from ..functions.text import embed_text, tokens
from ..operators import blockmax, bounded, enrich
from ..operators.filters import ENTITY_FIELDS, Filter
from ..operators.retrieve import usable
from ..session import SETTINGS, Settings
from .documents import latest

#: What a chunk has to have; context may be missing.
META = ("headings", "keywords", "dates")
#: Chunks of a part at most (of which a task holds the blocks that a search asks for), and of one that is worth a task.
PART, LEAST = 1 << 16, 1 << 11
#: Rows that are sent to the chunks they name.
FEW = 1 << 18
#: What is made from the chunks of a segment, when it is written or when it is first read; terms and stats come with postings.
TABLES = ("vectors", "entities", "values", "postings")
#: Files have one row group, so that a task reads whole parts.
WHOLE = {"parquet.block.size": str(1 << 29)}


class Commits:
    """Numbered commits in a folder. A number that another writer took is an error: the draft is renamed, without
    overwriting, which file systems do atomically; an object store needs a conditional put in this place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """The number of the last commit; 0 if there is none."""
        if not self.fs.exists(self.at("commits")):
            return 0
        names = [f.getPath().getName() for f in self.fs.listStatus(self.at("commits"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def read(self, version: int) -> dict | None:
        if not version:
            return None
        return json.loads(self.spark.read.text(f"{self.path}/commits/{version:012d}.json", wholetext=True).first()["value"])

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def rename(self, old, new) -> None:
        """Rename, or fail if the new name is taken."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(old, new, none)

    def named(self, draft: str, folder: str, *tables: str) -> None:
        """Move tables from draft to folder. What another reader moved there meanwhile holds the same rows and stays."""
        for t in tables:
            try:
                self.rename(self.at(f"{draft}/{t}"), self.at(f"{folder}/{t}"))
            except Exception:
                if not self.exists(f"{folder}/{t}"):
                    raise
        self.fs.delete(self.at(draft), True)

    def add(self, commit: dict, version: int) -> None:
        draft, last = self.at(f"commits/.{uuid.uuid4().hex}"), self.at(f"commits/{version:012d}.json")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        try:
            self.rename(draft, last)
        except Exception as e:
            self.fs.delete(draft, False)
            raise RuntimeError(f"another writer took version {version}; read again and retry") from e


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def entities_of_chunk(columns: list[str]) -> Column:
    """The different entities of a chunk, of all kinds; kinds that are missing have none."""
    none = F.array().cast("array<string>")
    kinds = [F.coalesce(F.col(f), none) for f in ENTITY_FIELDS if f in columns]
    return F.filter(F.array_distinct(F.flatten(F.array(*kinds))), lambda x: x.isNotNull()) if kinds else none


def chunk_terms(columns: list[str], analysis: str) -> Column:
    """What of a chunk is indexed: the tokens of its metadata and content, by its lang if the analysis is by language."""
    text = embed_text([F.col(c) for c in META], F.col("content"))
    return language_terms(text, F.col("lang")) if analysis == "language" and "lang" in columns else tokens(text)


def query_terms(queries: DataFrame, analysis: str) -> DataFrame:
    """query_id, term: the distinct terms of queries (query_id, query and, for an analysis by language, lang)."""
    own = language_terms(F.col("query"), F.col("lang")) if analysis == "language" and "lang" in queries.columns else tokens(F.col("query"))
    return queries.select("query_id", F.explode(F.array_distinct(own)).alias("term"))


#: The values of a segment: for each and range of numbers, which chunks have it, as bits in words of 64.
WORDS = [f"w{k}" for k in range(blockmax.RANGE // 64)]
VALUES = "field string, value string, day date, at timestamp_ntz, range long, " + ", ".join(f"{w} long" for w in WORDS)


def _words() -> list[Column]:
    """WORDS of the numbers (no) in a range."""
    place = F.col("no").bitwiseAND(F.lit(blockmax.RANGE - 1)).cast("int")
    bit = F.expr(f"shiftleft(1L, cast((no & {blockmax.RANGE - 1}) % 64 as int))")
    return [F.bit_or(F.when(F.floor(place / 64) == k, bit).otherwise(F.lit(0).cast("long"))).alias(w) for k, w in enumerate(WORDS)]


def bits(rows: DataFrame) -> DataFrame:
    """range and WORDS: which numbers of a range rows (no) have, one bit a chunk. Only these are shuffled."""
    return rows.groupBy(F.shiftright("no", blockmax.RANGE_BITS).alias("range")).agg(*_words())


def _places(kind: str) -> Column:
    """The places in a range whose bits are set."""
    word = f"element_at(array({', '.join(WORDS)}), cast(i div 64 as int) + 1)"
    return F.expr(f"transform(filter(sequence(0, {blockmax.RANGE - 1}), i -> (shiftright({word}, cast(i % 64 as int)) & 1) = 1), i -> cast(i as {kind}))")


def numbers(found: DataFrame) -> DataFrame:
    """no of the bits that are set."""
    each = found.select("range", F.explode(_places("int")).alias("place"))
    return each.select((F.shiftleft("range", blockmax.RANGE_BITS) + F.col("place")).alias("no"))


def kept(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows (no) whose bit is set: bits go to the rows, which are not moved."""
    own = rows.withColumn("_range", F.shiftright("no", blockmax.RANGE_BITS)).join(F.broadcast(found.withColumnRenamed("range", "_range")), "_range")
    word = f"element_at(array({', '.join(WORDS)}), cast((no & {blockmax.RANGE - 1}) div 64 as int) + 1)"
    return own.where(F.expr(f"shiftright({word}, cast(no % 64 as int)) & 1 = 1")).select(*rows.columns)


def without(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows (no) whose bit is not set, by the same way."""
    marks = found.select(F.col("range").alias("_range"), F.array(*WORDS).alias("_words"))
    own = rows.withColumn("_range", F.shiftright("no", blockmax.RANGE_BITS)).join(F.broadcast(marks), "_range", "left")
    word = f"element_at(_words, cast((no & {blockmax.RANGE - 1}) div 64 as int) + 1)"
    return own.where(F.expr(f"_words is null or shiftright({word}, cast(no % 64 as int)) & 1 = 0")).select(*rows.columns)


@contextmanager
def one_file_a_task(spark: SparkSession) -> Iterator[None]:
    """While this holds, a task reads one file at most, however small; as each file is a part, what a task sorts is one
    part and no more where there are many."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def values_of(chunks: DataFrame) -> DataFrame:
    """VALUES of chunks: what a Filter may ask for. Null elements are no values, text that is no day is no day."""
    none = [F.lit(None).cast("string").alias("value"), F.lit(None).cast("date").alias("day"), F.lit(None).cast("timestamp_ntz").alias("at")]
    lists = {f: F.col(f) for f in ("keywords", "content_types") if f in chunks.columns} | {"entities": entities_of_chunk(chunks.columns)}
    frames = [chunks.select("no", F.lit(f).alias("field"), F.explode(F.array_distinct(c)).alias("value"), *none[1:]).where("value is not null") for f, c in lists.items()]
    if "dates" in chunks.columns:
        days = chunks.select("no", F.lit("dates").alias("field"), none[0], F.explode(F.array_distinct(F.transform("dates", lambda x: x.try_cast("date")))).alias("day"), none[2])
        frames.append(days.where("day is not null"))
    if "modified_at" in chunks.columns:
        frames.append(chunks.where("modified_at is not null").select("no", F.lit("modified_at").alias("field"), none[0], none[1], F.col("modified_at").cast("timestamp_ntz").alias("at")))
    return union(frames).groupBy("field", "value", "day", "at", F.shiftright("no", blockmax.RANGE_BITS).alias("range")).agg(*_words())


def write_table(chunks: DataFrame, at: str, table: str, embed: enrich.Embedder, analysis: str) -> None:
    """Write one of TABLES from the chunks (no and more) of a segment; those that were merged have their vectors
    (embedding) already."""
    if table == "vectors":
        text = embed_text([F.col(c) for c in META], F.col("content"))
        own = chunks.select("no", "embedding") if "embedding" in chunks.columns else chunks.select("no", text.alias("text")).select("no", embed(F.col("text")).alias("embedding"))
        bounded.clusters(own.select("no", F.col("embedding").cast("array<double>").alias("embedding"))).write.options(**WHOLE).parquet(f"{at}/vectors")
    elif table == "entities":
        # Sorted by value and number, so that an entity of very many chunks lies in many files, and a rare one in one.
        tags = chunks.select(F.explode(entities_of_chunk(chunks.columns)).alias("entity"), "no")
        tags.repartitionByRange("entity", "no").sortWithinPartitions("entity", "no").write.parquet(f"{at}/entities")
    elif table == "values":
        # Kept, as the ranges are drawn from the values before these are dealt out.
        values = values_of(chunks).persist(StorageLevel.DISK_ONLY)
        values.repartitionByRange("field", "value", "day", "at", "range").sortWithinPartitions("field", "value", "day", "at", "range").write.parquet(f"{at}/values")
        values.unpersist()
    else:
        spark = chunks.sparkSession
        made = blockmax.blocks(chunks.select("no", chunk_terms(chunks.columns, analysis).alias("tokens")))
        with one_file_a_task(spark):
            made.write.options(**WHOLE).parquet(f"{at}/postings")
        written = spark.read.schema(blockmax.BLOCKS).parquet(f"{at}/postings")
        written.where("term <> ''").groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{at}/terms")
        heads = written.where("term = ''").groupBy("part").agg(F.sum("n").alias("n"), F.sum(F.expr("size(filter(tf, x -> x > 0))")).alias("full"), F.sum(F.expr("aggregate(tf, 0L, (a, x) -> a + x)")).alias("length"), (F.count(F.lit(1)) > F.countDistinct("range")).alias("torn")).collect()
        if any(r["torn"] for r in heads):
            raise RuntimeError("a part was read by more than one task: its file has more than one row group")
        totals = [(sum(r["full"] for r in heads), sum(r["length"] for r in heads))]
        spark.createDataFrame(totals, "n long, length long").coalesce(1).write.parquet(f"{at}/stats")


class Snapshot:
    """The index as one commit has it. A table of a segment that isn't there is made before it is read, under another
    name until it is whole; so is what a list of gone chunks takes from the statistics."""

    def __init__(self, spark: SparkSession, path: str, commit: dict, embed: enrich.Embedder):
        self.spark, self.path, self.commit, self.embed = spark, path, commit, embed
        self._commits = Commits(spark, path)
        self._there: set[str] = set()

    def _read(self, table: str, schema: str | StructType, segments: list[dict] | None = None) -> DataFrame:
        own = self.commit["segments"] if segments is None else segments
        for s in own:
            self._make(s, table)
        at = [f"{self.path}/segments/{s['name']}/{table}" for s in own]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def _make(self, segment: dict, table: str) -> None:
        at = f"segments/{segment['name']}"
        if table == "chunks" or f"{at}/{table}" in self._there:
            return
        if not self._commits.exists(f"{at}/{table}"):
            chunks = self.spark.read.schema(self.schema).parquet(f"{self.path}/{at}/chunks")
            draft, name = f"{at}/.{uuid.uuid4().hex}", "postings" if table in ("terms", "stats") else table
            write_table(chunks, f"{self.path}/{draft}", name, self.embed, self.commit["analysis"])
            self._commits.named(draft, at, *(("stats", "terms", "postings") if name == "postings" else (name,)))
        self._there.add(f"{at}/{table}")

    def _lost(self, name: str) -> DataFrame:
        """term, df, dl, full of a list of what is gone: less of each term, and beside the empty term all tokens and the
        chunks that have some."""
        at = f"gone/{name}"
        if not self._commits.exists(f"{at}/terms"):
            own = self.spark.read.schema("no long").parquet(f"{self.path}/{at}/numbers")
            texts = kept(self._read("chunks", self.schema), bits(own)).select(chunk_terms(self.schema.names, self.commit["analysis"]).alias("t"))
            each = texts.select(F.size("t").cast("long").alias("dl"), F.explode(F.concat(F.array_distinct("t"), F.array(F.lit("")))).alias("term"))
            less = each.groupBy("term").agg((-F.count(F.lit(1))).alias("df"), F.sum("dl").alias("dl"), F.count(F.when(F.col("dl") > 0, 1)).alias("full"))
            draft = f"{at}/.{uuid.uuid4().hex}"
            less.write.parquet(f"{self.path}/{draft}/terms")
            self._commits.named(draft, at, "terms")
        return self.spark.read.schema("term string, df long, dl long, full long").parquet(f"{self.path}/{at}/terms")

    @cached_property
    def totals(self) -> tuple[int, int]:
        """Chunks that have tokens, and all tokens."""
        if self.commit["n"] is not None:
            return self.commit["n"], self.commit["length"]
        more = self._read("stats", "n long, length long").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
        less = [self._lost(g).where("term = ''").agg(F.sum("full").alias("n"), F.sum("dl").alias("length")).first() for g in self.commit["gone"]]
        n, length = ((more[c] or 0) - sum(r[c] or 0 for r in less) for c in ("n", "length"))
        return n, length

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(self.commit["schema"])

    @cached_property
    def gone(self) -> DataFrame | None:
        """no of the chunks that are gone; None if there are none."""
        at = [f"{self.path}/gone/{g}/numbers" for g in self.commit["gone"]]
        return self.spark.read.schema("no long").parquet(*at) if at else None

    def live(self, rows: DataFrame) -> DataFrame:
        """rows (no) without what is gone."""
        return rows if self.gone is None else without(rows, bits(self.gone))

    def chunks(self, segments: list[dict] | None = None) -> DataFrame:
        """no and the columns of the chunks there are."""
        return self.live(self._read("chunks", self.schema, segments))

    def ids(self) -> DataFrame:
        """no, id of all chunks, those that are gone as well."""
        return self._read("chunks", self.schema).select("no", "id")

    def looked_up(self, rows: DataFrame, *columns: str) -> DataFrame:
        """rows (no and more) with the columns of their chunks; all columns, if none are given. A few rows go to the
        chunks, which are not moved; with more, the chunks that none of them names are dropped before they are moved."""
        stored = self.live(self._read("chunks", self.schema).select("no", *columns)) if columns else self.chunks()
        own = rows.persist(StorageLevel.DISK_ONLY)
        if own.count() <= FEW:
            return F.broadcast(own).join(stored, "no")
        return own.join(kept(stored, bits(own)), "no")

    def entities(self) -> DataFrame:
        """entity, no: the chunks of each entity, of any kind."""
        return self.live(self._read("entities", "entity string, no long"))

    def related(self, seeds: DataFrame) -> DataFrame:
        """no of the chunks that share an entity with the seeds (id), without these. Entities are looked up where they
        are stored, in their order; no chunk is read but the seeds."""
        known = self.seeds(seeds)
        own = known.select(F.explode("entities").alias("entity")).distinct()
        found = bits(self.entities().join(own, "entity", "left_semi").select("no"))
        seen = bits(known).select("range", *(F.col(w).alias(f"_{w}") for w in WORDS))
        without = [F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"_{w}", F.lit(0).cast("long")))).alias(w) for w in WORDS]
        return numbers(found.join(seen, "range", "left").select("range", *without))

    def seeds(self, ids: DataFrame) -> DataFrame:
        """no, entities of the chunks with these ids. A few ids go to the chunks, which are not moved."""
        asked = ids.select("id").distinct().persist(StorageLevel.DISK_ONLY)
        own = self.chunks().select("no", "id", entities_of_chunk(self.schema.names).alias("entities"))
        return own.join(F.broadcast(asked) if asked.count() <= FEW else asked, "id", "left_semi").select("no", "entities").persist(StorageLevel.DISK_ONLY)

    def allowed(self, filter_: Filter) -> DataFrame:
        """no of the chunks that a filter leaves, from the bits of its values: those of a condition are joined by or,
        conditions by and. Chunks are not read."""
        conditions = filter_.conditions()
        if not conditions:
            return self.live(self.ids().select("no"))
        values, met = self._read("values", VALUES), None
        for c in conditions:
            own = values.where(c).groupBy("range").agg(*(F.bit_or(w).alias(w) for w in WORDS))
            met = own if met is None else met.join(own.select("range", *(F.col(w).alias(f"_{w}") for w in WORDS)), "range").select("range", *(F.col(w).bitwiseAND(F.col(f"_{w}")).alias(w) for w in WORDS))
        return self.live(numbers(met))

    def vectors(self, segments: list[dict] | None = None) -> DataFrame:
        """no, embedding of the chunks whose vectors can be compared."""
        return self.live(bounded.vectors_of(self._read("vectors", bounded.CLUSTERS, segments)))

    def terms(self) -> DataFrame:
        """term, df, idf over the whole collection."""
        own = self._read("terms", "term string, df long")
        less = [self._lost(g).where("term <> ''").select("term", "df") for g in self.commit["gone"]]
        n = F.lit(self.totals[0])
        summed = union([own, *less]).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0") if less or len(self.commit["segments"]) > 1 else own
        return summed.withColumn("idf", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))

    @property
    def average(self) -> float:
        """Tokens of a chunk that has some."""
        n, length = self.totals
        return length / n if n else 1.0

    def blocks(self, terms: list[str]) -> DataFrame:
        """The blocks of terms, and the lengths."""
        listed = ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in [*terms, ""])
        return self._read("postings", blockmax.BLOCKS).where(F.expr(f"term IN ({listed})"))  # one expression: thousands of literals take seconds

    def postings(self, terms: DataFrame) -> DataFrame:
        """terms (term and more) with no, tf of the chunks that have them."""
        asked = terms.persist(StorageLevel.DISK_ONLY)
        rows = self._read("postings", blockmax.BLOCKS).select("term", "range", "at", "tf").join(F.broadcast(asked) if asked.count() <= FEW else asked, "term")
        each = rows.select(*terms.columns, "range", F.explode(F.arrays_zip("at", "tf")).alias("x"))
        return self.live(each.select(*terms.columns, (F.shiftleft("range", blockmax.RANGE_BITS) + F.col("x.at")).alias("no"), F.col("x.tf").alias("tf")))

    def sparse(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(query_id, no, score of the k best by BM25, with all that tie with the k-th; query_id, held, read: the
        postings of the query's terms and how many of them were read). queries: query_id, term; allowed (no): the
        chunks that a filter leaves."""
        kind = dict(queries.dtypes)["query_id"]
        # Queries of the same terms are searched once, by the smallest id.
        terms = queries.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
        same = terms.groupBy("terms").agg(F.min("query_id").alias("first"), F.collect_list("query_id").alias("all")).persist(StorageLevel.DISK_ONLY)
        once = same.select(F.col("first").alias("query_id"), F.explode("terms").alias("term"))
        known = once.join(self.terms(), "term").select("query_id", "term", "idf").persist()
        passes = max(1, -(-known.count() // blockmax.PAIRS))
        found, marked = [], self._marked_ranges(self._marked(allowed))
        for b in range(passes):
            rows = known.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == b).collect()
            asked = blockmax.Asked.of([tuple(r) for r in rows], self.average, k)
            found.append(self._pass(blockmax, self.blocks(list(asked.terms)), marked, asked, kind, allowed is not None))
        known.unpersist()
        each = same.select(F.col("first").alias("query_id"), F.explode("all").alias("_query"))
        return tuple(rows.join(each, "query_id").select(F.col("_query").alias("query_id"), *rows.columns[1:]) for rows in self._told(found, k))

    def dense(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(query_id, no, score of the k best by inner product, with all that tie with the k-th; query_id, held, read:
        the vectors there are and how many of them were multiplied). queries: query_id, embedding; those of the first
        usable one's width are asked."""
        kind = dict(queries.dtypes)["query_id"]
        known = queries.select("query_id", F.col("embedding").cast("array<double>").alias("e")).where(usable(F.col("e"))).persist()
        first, n = known.first(), known.count()
        dims = len(first["e"]) if first else 0
        passes = max(1, -(-n * dims // bounded.PASS))
        found, marked = [], self._marked_parts(self._marked(allowed))
        for b in range(passes):
            rows = known.where((F.pmod(F.xxhash64("query_id"), F.lit(passes)) == b) & (F.size("e") == dims)).collect()
            asked = bounded.Asked([r["query_id"] for r in rows], np.array([r["e"] for r in rows]).reshape(len(rows), dims), k)
            stored = self._read("vectors", bounded.CLUSTERS).where(F.col("dims") == dims)
            found.append(self._pass(bounded, stored, marked, asked, kind, allowed is not None))
        known.unpersist()
        return self._told(found, k)

    def _told(self, found: list[DataFrame], k: int) -> tuple[DataFrame, DataFrame]:
        all_ = union(found)
        hits = blockmax.best(all_.where("no is not null").select("query_id", "no", "score"), k)
        return hits, all_.where("no is null").groupBy("query_id").agg(F.sum("held").alias("held"), F.sum("read").alias("read"))

    def _marked(self, allowed: DataFrame | None) -> DataFrame | None:
        """range and WORDS of the allowed or, without a filter, of what is gone, found once for all passes; None if
        nothing is."""
        marked = allowed if allowed is not None else self.gone
        return None if marked is None else bits(marked).persist(StorageLevel.DISK_ONLY)

    def _marked_ranges(self, found: DataFrame | None) -> DataFrame | None:
        """range, marked: the places of the same."""
        return None if found is None else found.select("range", _places("short").alias("marked"))

    def _marked_parts(self, found: DataFrame | None) -> DataFrame | None:
        """part, marked: the ranges and words of each part that has some, one after the other."""
        if found is None:
            return None
        return found.groupBy(F.shiftright("range", blockmax.PART_BITS - blockmax.RANGE_BITS).alias("part")).agg(F.flatten(F.collect_list(F.array("range", *WORDS))).alias("marked"))

    def _pass(self, way, stored: DataFrame, marked: DataFrame | None, asked, kind: str, only: bool) -> DataFrame:
        """What a pass finds in blocks or clusters. Where there are many parts, a few show first what to reach."""
        if marked is not None:
            stored = stored.join(F.broadcast(marked), marked.columns[0], "inner" if only else "left")
        parts = sorted(((n, p) for s in self.commit["segments"] for p, n in s["parts"]), reverse=True)
        first = [p for _, p in parts[: max(1, self.spark.sparkContext.defaultParallelism // 2)]]
        if len(parts) > 2 * len(first):
            found = blockmax.best(way.scored(stored.where(F.col("part").isin(first)), asked, kind, only).where("no is not null"), asked.k)
            least = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= asked.k).collect()
            place = {q: i for i, q in enumerate(asked.queries)}
            for r in least:
                asked.reach[place[r["query_id"]]] = r["least"]
        return way.scored(stored, asked, kind, only)


class Index:
    """The index at path, as its writers see it. Rows are chunks: id, source, content, META and more."""

    def __init__(self, spark: SparkSession, path: str, embed: enrich.Embedder | None = None, settings: Settings = SETTINGS, most: int = 8, analysis: str = "plain", tables: Sequence[str] = TABLES):
        """analysis: plain, or language, by the column lang of chunks and queries; that of the first commit holds.
        tables: those of TABLES that a write makes at once; the others are made by the first reader that needs them, who
        has to have the same embed."""
        if analysis not in ("plain", "language"):
            raise ValueError(f"no such analysis: {analysis}")
        self.spark, self.path, self.settings, self.most = spark, path.rstrip("/"), settings, most
        self.embed, self.tables = embed or (lambda text: enrich.hashed_vector(text, settings.embedding_dim)), tuple(tables)
        self.commits = Commits(spark, self.path)
        last = self.commits.read(self.commits.version())
        self.analysis = last["analysis"] if last else analysis

    def version(self) -> int:
        return self.commits.version()

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The last state, or an earlier one."""
        commit = self.commits.read(self.version() if version is None else version)
        if commit is None:
            raise ValueError(f"no index at {self.path}")
        return Snapshot(self.spark, self.path, commit, self.embed)

    def read(self) -> DataFrame | None:
        """All chunks; None if nothing was ever written."""
        v = self.version()
        return self.snapshot(v).chunks().drop("no") if v else None

    def replace(self, chunks: DataFrame) -> None:
        """These chunks, and nothing of what was there."""
        v = self.version()
        old = self.commits.read(v)
        segment, schema = self._segment(self._staged(chunks), old["next"] if old else 1, True)
        self.commits.add(self._commit([segment], [], schema, segment["seq"] + 1), v + 1)

    def upsert(self, chunks: DataFrame, key: str = "id", replace_source: bool = False, order: str | None = None) -> None:
        """Chunks replace those of the same id, the last by order if an id is repeated; replace_source drops other
        chunks of their sources as well."""
        if key != "id":
            raise ValueError("chunks are kept by id")
        v = self.version()
        old = self.commits.read(v)
        segment, schema = self._segment(self._staged(chunks), old["next"] if old else 1, True, order)
        if old is None:
            return self.commits.add(self._commit([segment], [], schema, segment["seq"] + 1), v + 1)
        snapshot = Snapshot(self.spark, self.path, old, self.embed)
        fresh = self.spark.read.schema(schema).parquet(f"{self.path}/segments/{segment['name']}/chunks")
        again = snapshot.chunks().join(fresh.select("id"), "id", "left_semi").select("no")
        if replace_source:
            again = again.unionByName(snapshot.chunks().join(fresh.select("source").distinct(), "source", "left_semi").select("no")).distinct()
        gone = self._gone(snapshot, again)
        names = {f.name for f in snapshot.schema.fields}
        both = StructType([*snapshot.schema.fields, *(f for f in schema.fields if f.name not in names)])
        commit = self._commit([*old["segments"], segment] if segment["parts"] else old["segments"], [*old["lists"], *gone], both, segment["seq"] + 1)
        self.commits.add(self._merged(commit), v + 1)

    def delete(self, ids: DataFrame) -> None:
        """Chunks of these ids go."""
        v = self.version()
        snapshot = self.snapshot(v)
        gone = self._gone(snapshot, snapshot.chunks().join(ids.select("id"), "id", "left_semi").select("no"))
        c = snapshot.commit
        self.commits.add(self._commit(c["segments"], [*c["lists"], *gone], snapshot.schema, c["next"]), v + 1)

    def vacuum(self) -> None:
        """Delete files that the last commit doesn't name; no one may be reading an older version or writing."""
        c = self.commits.read(self.version())
        for folder, named in (("segments", {s["name"] for s in c["segments"]} if c else set()), ("gone", set(c["gone"]) if c else set()), ("staged", set())):
            at = self.commits.at(folder)
            for f in self.commits.fs.listStatus(at) if self.commits.fs.exists(at) else ():
                if f.getPath().getName() not in named:
                    self.commits.fs.delete(f.getPath(), True)

    def _staged(self, chunks: DataFrame) -> DataFrame:
        """The chunks, written: what follows reads them more than once."""
        own = chunks if "context" in chunks.columns else chunks.withColumn("context", F.lit(None).cast("string"))
        path = f"{self.path}/staged/{uuid.uuid4().hex}"
        own.drop("no").write.parquet(path)
        return self.spark.read.schema(own.drop("no").schema).parquet(path)

    def _segment(self, stage: DataFrame, seq: int, repeated: bool = False, order: str | None = None) -> tuple[dict, StructType]:
        """Write a segment of staged chunks, or merged ones, which have their vectors (embedding) already. Where ids may
        be repeated, the last by order is found in the same ranges of ids that are the parts."""
        name = f"{seq:08d}-{uuid.uuid4().hex}"
        at = f"{self.path}/segments/{name}"
        n = stage.count()
        parts = max(1, -(-n // PART), min(self.spark.sparkContext.defaultParallelism, n // LEAST))
        made = F.monotonically_increasing_id()
        no = F.shiftleft(F.lit(seq).cast("long"), blockmax.SEGMENT_BITS) + F.shiftleft(F.shiftright(made, 33), blockmax.PART_BITS) + made.bitwiseAND(F.lit((1 << 33) - 1))
        dealt = stage.repartitionByRange(parts, "id")
        numbered = (latest(dealt, "id", order) if repeated else dealt).sortWithinPartitions("id").select(no.alias("no"), *stage.columns)
        numbered.write.options(**WHOLE).parquet(f"{at}/chunks")
        chunks = self.spark.read.schema(numbered.schema).parquet(f"{at}/chunks")
        held = chunks.groupBy(F.shiftright("no", blockmax.PART_BITS).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
        if any(r["n"] > 1 << blockmax.PART_BITS for r in held):
            raise RuntimeError("a part has more chunks than numbers")
        for table in TABLES:
            if table in self.tables or (table == "vectors" and "embedding" in chunks.columns):
                draft = f"segments/{name}/.{table}"
                write_table(chunks, f"{self.path}/{draft}", table, self.embed, self.analysis)
                self.commits.named(draft, f"segments/{name}", *(("stats", "terms", "postings") if table == "postings" else (table,)))
        r = self.spark.read.schema("n long, length long").parquet(f"{at}/stats").first() if "postings" in self.tables else None
        kept_ = StructType([f for f in numbered.schema.fields if f.name != "embedding"])
        return {"seq": seq, "name": name, "n": r and r["n"], "length": r and r["length"], "rows": sum(r["n"] for r in held), "parts": [[r["part"], r["n"]] for r in sorted(held)]}, kept_

    def _gone(self, snapshot: Snapshot, numbers: DataFrame) -> list[dict]:
        """Write a list of what is gone and, if postings are made at once, what this takes from the statistics; nothing
        if it is empty."""
        name = uuid.uuid4().hex
        at = f"{self.path}/gone/{name}"
        numbers.write.parquet(f"{at}/numbers")
        rows = self.spark.read.schema("no long").parquet(f"{at}/numbers").count()
        r = snapshot._lost(name).where("term = ''").first() if rows and "postings" in self.tables else None
        return [{"name": name, "rows": rows, "n": r and r["full"], "length": r and r["dl"]}] if rows else []

    def _commit(self, segments: list[dict], gone: list[dict], schema: StructType, following: int) -> dict:
        known = lambda c: all(x[c] is not None for x in [*segments, *gone])
        minus = lambda c: sum(s[c] for s in segments) - sum(g[c] for g in gone) if known(c) else None
        return {"segments": segments, "gone": [g["name"] for g in gone], "lists": gone, "n": minus("n"), "length": minus("length"), "rows": minus("rows"), "schema": json.loads(schema.json()), "next": following, "analysis": self.analysis}

    def _merged(self, commit: dict) -> dict:
        """The commit with its smallest segments made one, if it has more than most."""
        if len(commit["segments"]) <= self.most:
            return commit
        by_size = sorted(commit["segments"], key=lambda s: s["rows"])
        small = by_size[: len(by_size) - self.most // 2]
        now = Snapshot(self.spark, self.path, commit, self.embed)
        # Vectors that are there are not made again.
        embedded = any(self.commits.exists(f"segments/{s['name']}/vectors") for s in small)
        rows = (now.chunks(small).join(now.vectors(small), "no", "left") if embedded else now.chunks(small)).drop("no")
        path = f"{self.path}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        segment, _ = self._segment(self.spark.read.schema(rows.schema).parquet(path), commit["next"])
        rest = [s for s in commit["segments"] if s not in small]
        gone: list[dict] = []
        if now.gone is not None:
            kept = {s["seq"] for s in rest}
            left = now.gone.where(F.shiftright("no", blockmax.SEGMENT_BITS).isin(list(kept)) if kept else F.lit(False))
            gone = self._gone(now, left)
        return self._commit([*rest, segment] if segment["parts"] else rest, gone, now.schema, segment["seq"] + 1)


def weighed(queries: DataFrame, snapshot: Snapshot) -> DataFrame:
    """query_id, terms: the distinct terms (term, idf) of each query (query_id, term), idf 0 where no chunk has it."""
    known = queries.join(snapshot.terms().select("term", "idf"), "term", "left").select("query_id", F.struct("term", F.coalesce("idf", F.lit(0.0)).alias("idf")).alias("x"))
    return known.groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("terms"))
