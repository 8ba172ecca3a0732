"""Column expressions for text, ids, snippets and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
ENTITY = r"\p{Lu}\p{Ll}{7,}"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends; trim() takes blanks only."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def snippet(context: Column, content: Column, chars: int = 300) -> Column:
    """The context if there is one, else the first characters of the content."""
    return F.coalesce(F.when(context != "", context), F.substring(F.coalesce(content, F.lit("")), 1, chars))


def source_url(url: Column, page: Column) -> Column:
    """A link with a page anchor; page 0 and no page have none."""
    return F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(url, F.lit("#page="), page.cast("string"))).otherwise(url)


def signed_url(prefix: str, name: Column, seconds: int = 3600) -> Column:
    """A deterministic stand-in for a signed link of an object store."""
    return F.concat(F.lit(prefix), name, F.lit(f"?expires={seconds}&sig="), F.substring(F.md5(name), 1, 8))


def chunk_id(source: Column, index: Column, content: Column) -> Column:
    """SHA-256 of source:index:content; a missing source reads None."""
    return F.sha2(F.concat(F.coalesce(source, F.lit("None")), F.lit(":"), index.cast("string"), F.lit(":"), content), 256)


def contextualized(headings: Column, content: Column) -> Column:
    return F.concat_ws("\n", headings, content)


def embed_text(meta: list[Column], content: Column) -> Column:
    """What the document side embeds: the listed fields, flattened, then the content."""
    return F.concat_ws("\n", *meta, content)


def iso_utc(ts: Column) -> Column:
    """ISO 8601 with +00:00, and microseconds only where there are some."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")), F.lit("+00:00"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
