"""Secret scans: an incremental ledger of content-addressed blobs.

Every version of a text is a blob named by its SHA-256. A rule version scans only the blobs that the ledger does
not yet hold for it; the ledger keeps findings by blob and rule version, and those of earlier and of new scans are
joined back to all paths (documents) that hold the blob.
DataFrame functions only. The place of a match is the length of the text between the matches before it, which
split() gives, plus the lengths of those matches, summed by a window over the matches of one blob and rule.

Null text is the empty blob; repeated rows are paths of one blob; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import docs_of

RULE_VERSION = "1"
#: kind: (pattern, least characters of the group that counts, that group, text that a match must hold or None). Base kinds first.
RULES = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, None),
    "access": (r"AKIA[A-Z0-9]+", 20, 0, "AKIA"),
    "hex": (r"[0-9a-f]{24,}", 24, 0, None),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0, "PRIVATE KEY-----"),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 1, 0, ".eyJ"),
}
BASE = ("assign", "access", "hex")
#: What the ledger keeps of a match.
MATCH = ("kind", "rank", "start", "end")


def paths_of(docs: DataFrame) -> DataFrame:
    return docs_of(docs).withColumn("blob", F.sha2("text", 256))


def unseen(blobs: DataFrame, ledger: DataFrame | None, version: str = RULE_VERSION) -> DataFrame:
    """One row of text for each blob that the rule version has not scanned. ledger: blob, rule_version."""
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    return blobs.select("blob", "text").dropDuplicates(["blob"])


def findings(blobs: DataFrame) -> DataFrame:
    """blob, kind, rank (of the kind), start, end: the matches in each blob, in code points."""
    found = []
    for rank, (kind, (pattern, least, group, hint)) in enumerate(RULES.items()):
        text = F.col("text")
        holds = text.rlike(pattern) if hint is None else text.contains(hint) & text.rlike(pattern)
        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        parts = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
        found.append(F.when(holds, F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), F.lit(least).alias("least"), F.arrays_zip(F.split("text", pattern, -1).alias("gap"), hits.alias("hit"), parts.alias("part")).alias("m"))))
    each = blobs.select("blob", F.explode(F.array_compact(F.array(*found))).alias("f")).select("blob", "f.kind", "f.rank", "f.least", F.posexplode("f.m").alias("i", "m"))
    run = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.coalesce(F.length("m.hit"), F.lit(0))
    at = each.withColumn("end", F.sum(F.length("m.gap") + size).over(run)).where(F.col("m.hit").isNotNull() & (F.length("m.part") >= F.col("least")))
    return at.select("blob", "kind", "rank", (F.col("end") - size).alias("start"), "end")


def report(paths: DataFrame, found: DataFrame) -> DataFrame:
    """Findings joined back to all paths: one row per document."""
    span = F.struct(F.col("start"), F.col("rank"), F.concat_ws(":", "kind", "start", "end").alias("span"))
    by_blob = found.groupBy("blob").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE), F.array_sort(F.collect_list(span)).alias("s"))
    texts = lambda c: F.concat_ws(",", F.transform(c, lambda x: x["span"]))
    by_blob = by_blob.select("blob", *(f"n_{k}" for k in BASE), texts(F.filter("s", lambda x: x["rank"] < len(BASE))).alias("base"), texts(F.col("s")).alias("spans"))
    joined = paths.select("doc_id", "blob").join(by_blob, "blob", "left")
    return joined.select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def recorded(fresh: DataFrame, found: DataFrame, version: str) -> DataFrame:
    """The ledger's rows for the blobs of fresh: blob, rule_version, found (an array of matches, empty if clean)."""
    own = found.groupBy("blob").agg(F.collect_list(F.struct(*MATCH)).alias("found"))
    return fresh.select("blob").join(own, "blob", "left").select("blob", F.lit(version).alias("rule_version"), F.coalesce("found", F.array().cast(own.schema["found"].dataType)).alias("found"))


def stored(ledger: DataFrame, paths: DataFrame, version: str) -> DataFrame:
    """The ledger's findings for the rule version in the blobs of paths, in the columns of findings()."""
    own = ledger.where(F.col("rule_version") == version).join(paths.select("blob"), "blob", "left_semi").dropDuplicates(["blob"])
    return own.select("blob", F.explode("found").alias("f")).select("blob", *(f"f.{c}" for c in MATCH))


def scan(docs: DataFrame, ledger: DataFrame | None = None, version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(the report on all docs, from newly scanned blobs and from the ledger; the rows to append to the ledger: blob,
    rule_version, found). Blobs that the ledger holds without findings (null, or no such column) are scanned again."""
    paths = paths_of(docs)
    ledger = None if ledger is None or "found" not in ledger.columns else ledger.where("found is not null")
    fresh = unseen(paths, ledger, version)
    new = findings(fresh)
    every = new if ledger is None else new.unionByName(stored(ledger, paths, version))
    return report(paths, every), recorded(fresh, new, version)


def _oracle() -> str:
    union = []
    for rank, (kind, (pattern, least, group, _)) in enumerate(RULES.items()):
        p = pattern.replace("'", "''")
        union.append(f"SELECT rid, '{kind}' AS kind, {rank} AS rank, {least} AS least, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}', 0) AS hits, regexp_extract_all(text, '{p}', {group}) AS parts FROM d")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(union)}),
e AS (SELECT rid, kind, rank, least, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, parts FROM m),
p AS (SELECT rid, kind, rank, list_sum(list_transform(list_slice(gaps, 1, i), lambda g: length(g)))::bigint + coalesce(list_sum(list_transform(list_slice(hits, 1, i - 1), lambda h: length(h))), 0)::bigint AS s, length(hits[i]) AS n FROM e WHERE length(parts[i]) >= least),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) AS spans FROM p GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::bigint AS n_assign, coalesce(n_access, 0)::bigint AS n_access, coalesce(n_hex, 0)::bigint AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
"""


ORACLE = _oracle()
