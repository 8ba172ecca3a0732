"""SQL, as DuckDB runs it, with the same rows as each query."""

from __future__ import annotations

from ..functions.analysis import STOP_WORDS, pattern
from ..operators.convert import ITEM, LABELS, REFERENCES
from ..session import SETTINGS
from .queries import FILTERED, FILTERS

_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def tok(c: str) -> str:
    return _TOK.format(c)


def _by_language(c: str) -> str:
    """The tokens of c in the terms of lang."""
    own = lambda n, words: f"WHEN '{n}' THEN list_transform(list_filter({tok(c)}, lambda x: x NOT IN ({', '.join(repr(w) for w in words)})), lambda x: regexp_replace(x, '{pattern(n)}', '\\1'))"
    return f"CASE lang {' '.join(own(n, w) for n, w in STOP_WORDS.items())} ELSE {tok(c)} END"


_META = r"""[lang] AS headings, (chunk_index // 5)::int AS page_number,
 CASE WHEN chunk_index % 7 = 0 THEN ['table', 'text'] ELSE ['text'] END AS content_types,
 TIMESTAMP '2024-01-01 00:00:00' + to_days((doc_id % 90)::int) + INTERVAL 86399 SECOND + to_milliseconds(((doc_id // 90) % 2) * 500) AS modified_at,
 CASE doc_id % 3 WHEN 0 THEN []::varchar[] WHEN 1 THEN [((DATE '2024-01-01' + (doc_id % 365)::int))::varchar] ELSE ['2019-01-01', '2030-01-01'] END AS dates, list_sort(ents) AS keywords,
 list_sort(list_filter(ents, lambda x: length(x) % 4 = 0)) AS ent_persons, list_sort(list_filter(ents, lambda x: length(x) % 4 = 1)) AS ent_organizations,
 list_sort(list_filter(ents, lambda x: length(x) % 4 = 2)) AS ent_products, list_sort(list_filter(ents, lambda x: length(x) % 4 = 3)) AS ent_locations"""
_ENTS = r"list_distinct(regexp_extract_all(content, '\p{Lu}\p{Ll}{7,}')) AS ents"
FX = rf"""l AS (SELECT doc_id, lang, source || '/' || doc_id AS source, len(string_split(text, chr(10)))::int AS total_chunks, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10)))))::int AS chunk_index FROM documents),
fe AS (SELECT *, {_ENTS} FROM l),
fx AS (SELECT *, sha256(source || ':' || chunk_index || ':' || content) AS id, {_META} FROM fe)"""
SEEDS = "seeds AS (SELECT id FROM fx WHERE doc_id % 20 = 0 AND chunk_index = 0)"
PACK = rf"""ln AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, string_split(text, chr(10)) AS parts FROM documents),
sz AS (SELECT doc_id, i, parts[i] AS line, len({tok('parts[i]')}) AS n FROM ln),
pk AS (SELECT doc_id, i, 0 AS chunk, n AS used FROM sz WHERE i = 1
  UNION ALL SELECT s.doc_id, s.i, CASE WHEN p.used + s.n > 128 THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN p.used + s.n > 128 THEN s.n ELSE p.used + s.n END FROM pk p JOIN sz s ON s.doc_id = p.doc_id AND s.i = p.i + 1),
ck AS (SELECT doc_id, chunk::int AS chunk_index, sum(n)::bigint AS n_tokens, (min(i) - 1)::int AS first_item, (max(i) - 1)::int AS last_item, string_agg(line, chr(10) ORDER BY i) AS content FROM pk JOIN sz USING (doc_id, i) GROUP BY 1, 2)"""
DOCS_POST = f"""tk AS (SELECT doc_id, {tok('text')} AS t FROM documents),
po AS (SELECT doc_id, term, count(*) AS tf, dl FROM (SELECT doc_id, len(t)::bigint AS dl, unnest(t) AS term FROM tk) GROUP BY doc_id, term, dl),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT doc_id, dl FROM po)),
idf AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM po GROUP BY term), st)"""
POST = f"""{FX}, et AS (SELECT id, array_to_string(list_concat(headings, keywords, dates, [content]), chr(10)) AS text FROM fx),
tk AS (SELECT id, {tok('text')} AS t FROM et),
po AS (SELECT id, term, count(*) AS tf, dl FROM (SELECT id, len(t)::bigint AS dl, unnest(t) AS term FROM tk) GROUP BY id, term, dl),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT id, dl FROM po)),
idf AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM po GROUP BY term), st)"""
QUERIES = f"""qs AS (SELECT item_id AS query_id, text AS query FROM benchmark),
qt AS (SELECT DISTINCT query_id, unnest({tok('query')}) AS term FROM qs)"""


def sparse(k: int, name: str = "sp", allowed: str = "") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM po JOIN qt USING (term) JOIN idf USING (term), st {allowed} GROUP BY 1, 2)) WHERE rank <= {k})"""


def _hash(source: str, id_: str, text: str, name: str) -> str:
    h = "('0x' || substring(md5(term), 1, 8))::bigint"
    return f"""{name}0 AS (SELECT {id_}, term, count(*) AS tf FROM (SELECT {id_}, unnest({tok(text)}) AS term FROM {source}) GROUP BY 1, 2),
{name}1 AS (SELECT {id_}, ({h} % 64)::int AS dim, sum(CASE WHEN ({h} // 64) % 2 = 0 THEN tf ELSE -tf END)::double AS w FROM {name}0 GROUP BY 1, 2),
{name} AS (SELECT {id_}, dim, w / sqrt(sum(w * w) OVER (PARTITION BY {id_})) AS weight FROM {name}1 WHERE w <> 0)"""


DENSE_BASE = f"{_hash('et', 'id', 'text', 'dv')}, {_hash('qs', 'query_id', 'query', 'qv')}"


def dense(k: int, name: str = "de", allowed: str = "true") -> str:
    # Every pair of a query and a document with tokens has a score, 0 where no dimension is shared.
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT q.query_id, d.id, coalesce(round(s.score, 6), 0) AS score FROM (SELECT DISTINCT query_id FROM qv) q CROSS JOIN (SELECT DISTINCT id FROM dv WHERE {allowed}) d
  LEFT JOIN (SELECT query_id, id, sum(qv.weight * dv.weight) AS score FROM qv JOIN dv USING (dim) GROUP BY 1, 2) s ON s.query_id = q.query_id AND s.id = d.id)) WHERE rank <= {k})"""


HYBRID = "hy AS (SELECT query_id, id, max(d) AS from_dense, max(s) AS from_sparse FROM (SELECT query_id, id, true AS d, false AS s FROM de UNION ALL SELECT query_id, id, false, true FROM sp) GROUP BY 1, 2)"


def rerank(candidates: str, k: int, threshold: float | None = None, name: str = "rr") -> str:
    where = "" if threshold is None else f"WHERE score >= {threshold}"
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT * FROM (
  SELECT c.query_id, c.id, round(coalesce(sum(CASE WHEN p.term IS NOT NULL THEN t.idf ELSE 0 END) / nullif(sum(t.idf), 0), 0), 6) AS score
  FROM {candidates} c JOIN (SELECT query_id, term, coalesce(idf, 0) AS idf FROM qt LEFT JOIN idf USING (term)) t USING (query_id) LEFT JOIN po p ON p.id = c.id AND p.term = t.term GROUP BY 1, 2) {where})) WHERE rank <= {k})"""


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def predicate(keywords=(), entities=(), content_types=(), date_from="", date_to="", modified_from="", modified_to="") -> str:
    parts = []
    if keywords:
        parts.append(f"list_has_any(keywords, {_list(keywords)})")
    if entities:
        parts.append("(" + " OR ".join(f"list_has_any({f}, {_list(entities)})" for f in ("ent_persons", "ent_organizations", "ent_products", "ent_locations")) + ")")
    if content_types:
        parts.append(f"list_has_any(content_types, {_list(content_types)})")
    if date_from:
        parts.append(f"len(list_filter(dates, lambda x: try_cast(x AS date) >= DATE '{date_from}')) > 0")
    if date_to:
        parts.append(f"len(list_filter(dates, lambda x: try_cast(x AS date) <= DATE '{date_to}')) > 0")
    if modified_from:
        parts.append(f"modified_at >= TIMESTAMP '{modified_from}'")
    if modified_to:
        parts.append(f"modified_at <= TIMESTAMP '{modified_to if 'T' in modified_to else modified_to + 'T23:59:59'}'")
    return " AND ".join(parts) or "true"


def strip(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '^\s+', ''), '\s+$', '')"


_SIGNED = "('https://files.local/' || source || '?expires=3600&sig=' || substring(md5(source), 1, 8))"
_NEAR = "FROM fx c WHERE EXISTS (SELECT 1 FROM fx s WHERE s.id IN (SELECT id FROM seeds) AND s.source = c.source AND c.chunk_index BETWEEN greatest(s.chunk_index - 1, 0) AND least(s.chunk_index + 1, s.total_chunks - 1))"
_URL = f"CASE WHEN coalesce(page_number, 0) <> 0 THEN {_SIGNED} || '#page=' || page_number ELSE {_SIGNED} END"


def _html() -> str:
    html = "coalesce(html, '')"
    for tag in ("script", "style", "nav", "footer", "aside", "form", "head"):
        html = rf"regexp_replace({html}, '<{tag}[\s>].*?</{tag}>', '', 'gs')"
    html = f"regexp_replace({html}, '<div class=\"ad\">.*?</div>', '', 'gs')"
    text = "regexp_replace(x, '<[^>]*>', ' ', 'g')"
    for ref, char in REFERENCES:
        text = f"replace({text}, '{ref}', '{char.replace(chr(39), chr(39) * 2)}')"
    label = " ".join(f"WHEN '{t}' THEN '{v}'" for t, v in LABELS.items())
    return rf"""WITH h AS (SELECT page_id, {html} AS html FROM pages),
m AS (SELECT page_id, regexp_extract_all(html, '{ITEM}', 1) AS tags, regexp_extract_all(html, '{ITEM}', 2) AS texts FROM h),
e AS (SELECT page_id, unnest(range(len(tags)))::int AS item_no, unnest(tags) AS tag, unnest(texts) AS x FROM m)
SELECT page_id, item_no, CASE tag {label} ELSE 'section_header_' || substring(tag, 2, 1) END AS label, trim(regexp_replace({text}, '[ \t\r\n]+', ' ', 'g')) AS text FROM e WHERE trim(regexp_replace({text}, '[ \t\r\n]+', ' ', 'g')) <> ''"""


RELEVANT = "rel AS (SELECT item_id AS query_id, id FROM benchmark b JOIN fx d ON contains(d.content, b.text))"
HIT = "SELECT query_id, id, score, rank::int AS rank FROM"
_HIT = f"{_URL} AS url, page_number AS page, array_to_string(headings, ' > ') AS headings, substring(content, 1, 300) AS snippet"
SHOWN = f"SELECT query_id, rank::int AS rank, id, score, source, {_HIT} FROM rr JOIN fx USING (id)"
T = SETTINGS.rerank_threshold
_GOLD = f"ok AS (SELECT * FROM documents WHERE length({strip('text')}) >= 100), sa AS (SELECT *, md5('42:' || doc_id) AS draw FROM ok ORDER BY draw, doc_id LIMIT 50)"
_ENTITIES = "en AS (SELECT DISTINCT unnest(ents) AS entity FROM fx WHERE id IN (SELECT id FROM seeds))"
_SAID = f"""qs AS (SELECT doc_id AS query_id, content AS query FROM fx WHERE doc_id % 20 = 0 AND chunk_index = 0 AND len(ents) > 0),
qt AS (SELECT DISTINCT query_id, unnest({tok('query')}) AS term FROM qs)"""
BASE = f"WITH RECURSIVE {POST}, {QUERIES}"
ALL = f"""{BASE}, {RELEVANT}, {DENSE_BASE}, {sparse(5, 's5')}, {dense(5, 'd5')}, {sparse(30)}, {dense(30)}, {HYBRID}, {rerank('hy', 5)},
got AS (SELECT 'sparse' AS mode, query_id, id, rank FROM s5 UNION ALL SELECT 'dense', query_id, id, rank FROM d5 UNION ALL SELECT 'hybrid', query_id, id, rank FROM rr),
hit AS (SELECT g.mode, g.query_id, g.rank, (r.id IS NOT NULL)::int AS hit FROM got g LEFT JOIN rel r USING (query_id, id)),
run AS (SELECT *, sum(hit) OVER (PARTITION BY mode, query_id ORDER BY rank) AS so_far FROM hit),
per AS (SELECT mode, query_id, max(hit) AS any_hit, sum(hit) AS found, min(CASE WHEN hit = 1 THEN rank END) AS first, avg(CASE WHEN hit = 1 THEN so_far / rank END) AS ap FROM run GROUP BY 1, 2),
ev AS (SELECT m.mode, r.query_id, r.n, coalesce(any_hit, 0) AS any_hit, coalesce(found, 0) AS found, coalesce(1.0 / first, 0)::double AS rr1, coalesce(ap, 0) AS ap FROM (SELECT query_id, count(*) AS n FROM rel GROUP BY 1) r CROSS JOIN (SELECT unnest(['sparse', 'dense', 'hybrid']) AS mode) m LEFT JOIN per USING (mode, query_id)),
mt AS (SELECT mode, avg(any_hit::double) AS recall_single, avg(found / n) AS recall_multi, avg(rr1) AS mrr, avg(ap) AS map FROM ev GROUP BY mode)"""
BATCH = "bt AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::bigint AS ordinal FROM documents)"


def oracle_sql() -> dict[str, str]:
    fx = lambda cols, tail="": f"WITH {FX} SELECT {cols} FROM fx {tail}"
    ck = lambda cols: f"WITH RECURSIVE {PACK} SELECT {cols} FROM ck"
    out = {
        "src_documents": "SELECT doc_id, source, lang, length(text)::bigint AS n_chars, sha256(text) AS digest FROM documents",
        "src_batches": f"WITH {BATCH} SELECT doc_id, ordinal, ordinal // 3 AS batch FROM bt",
        "src_modified_at": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') <> '000000' THEN '.' || strftime(ts, '%f') ELSE '' END || '+00:00' AS modified_at FROM events",
        "src_basename": "SELECT page_id, string_split(url, '/')[-1] AS basename FROM pages",
        "scan_all": fx("id, source, chunk_index, length(content)::bigint AS n_chars"),
        "scan_by_id": f"WITH {FX}, {SEEDS} SELECT id, source, chunk_index FROM fx WHERE id IN (SELECT id FROM seeds)",
        "sink_upsert": fx("id, CASE WHEN doc_id % 3 = 0 THEN page_number + 100 ELSE page_number END::int AS page_number, (doc_id % 3 = 0)::int AS batch"),
        "conv_html_items": _html(),
        "conv_text_items": "WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents) SELECT doc_id, unnest(range(len(p)))::int AS item_no, 'text' AS label, unnest(p) AS text FROM s",
        "conv_tree_items": "WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE doc_id % 10 <> 7) SELECT doc_id, unnest(range(len(p)))::int AS item_no, 'text' AS label, unnest(p) AS text FROM s",
        "chunk_pack": ck("doc_id, chunk_index, n_tokens, first_item, last_item, content"),
        "chunk_ordinals": ck("doc_id, chunk_index, count(*) OVER (PARTITION BY doc_id)::int AS total_chunks"),
        "chunk_contextualize": fx("id, array_to_string(list_concat(headings, [content]), chr(10)) AS content"),
        "chunk_page_min": ck("doc_id, chunk_index, CASE WHEN doc_id % 10 <> 9 THEN (first_item // 5)::int END AS page_number"),
        "chunk_content_types": ck("doc_id, chunk_index, array_to_string(list_sort(list_distinct(list_transform(range(first_item, last_item + 1), lambda i: CASE WHEN i % 7 = 0 THEN 'table' ELSE 'text' END))), ',') AS content_types"),
        "chunk_id": ck("doc_id, chunk_index, sha256(CASE WHEN doc_id % 11 <> 0 THEN 'doc/' || doc_id ELSE 'None' END || ':' || chunk_index || ':' || content) AS id"),
        "agg_chunk_counts": fx("count(DISTINCT doc_id) AS documents, count(*) AS chunks"),
        "enrich_keywords": f"""WITH {FX}, k AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({tok('content')}) AS term FROM fx) GROUP BY 1, 2), n AS (SELECT count(DISTINCT id) AS n FROM k),
f AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM k GROUP BY 1), n),
w AS (SELECT id, term, round(tf * idf, 6) AS weight FROM k JOIN f USING (term)) SELECT id, rank, term, weight FROM (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY weight DESC, term))::int AS rank FROM w) WHERE rank <= 5""",
        "enrich_entities": fx(", ".join(["id", *(f"array_to_string({f}, ',') AS {f}" for f in ("ent_persons", "ent_organizations", "ent_products", "ent_locations"))])),
        "enrich_structured": fx("id, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN doc_id % 3 <> 0 THEN 'About ' || source END AS context, CASE WHEN doc_id % 3 = 1 THEN array_to_string(keywords, ',') ELSE '' END AS keywords"),
        "enrich_failure_split": fx(f"id, CASE WHEN len({tok('content')}) >= 3 THEN 'written' ELSE 'counted' END AS branch"),
        "embed_text": fx("id, array_to_string(list_concat(headings, keywords, dates, [content]), chr(10)) AS text"),
        "embed_dense_hash": f"WITH {_hash('documents', 'doc_id', 'text', 'dv')} SELECT doc_id, dim, round(weight, 6) AS weight FROM dv",
        "sparse_postings": f"WITH {DOCS_POST} SELECT doc_id, term, tf, dl FROM po",
        "sparse_idf": f"WITH {DOCS_POST} SELECT term, df, round(idf, 6) AS idf FROM idf",
        "search_semantic": """WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda z: z[1]::double * z[2]::double)), 6) AS score FROM embeddings q CROSS JOIN embeddings d WHERE q.vec_id % 20 = 0)
SELECT query_id, doc_id, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::int AS rank FROM s) WHERE rank <= 5""",
        # Whatever the cuts are: no chunk is over the limit, and no text is lost.
        "chunk_budget": rf"SELECT doc_id, true AS within, len({tok('text')})::bigint AS n_tokens, sha256(regexp_replace(text, '\s+', '', 'g')) AS digest FROM documents WHERE len(string_split(text, chr(10))) > 0 AND regexp_replace(text, '\n', '', 'g') <> ''",
        "search_keyword": f"{BASE}, {sparse(5)} {HIT} sp",
        "search_keyword_language": f"WITH RECURSIVE {POST.replace(tok('text') + ' AS t FROM et', _by_language('text') + ' AS t FROM et JOIN (SELECT id, lang FROM fx) USING (id)')}, {_SAID.replace('query_id, content AS query', 'query_id, lang, content AS query').replace(' AND len(ents) > 0', '').replace(tok('query'), _by_language('query'))}, {sparse(5)} {HIT} sp",
        "index_changes": f"WITH documents AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || 'changed since' ELSE text END AS text FROM main.documents WHERE doc_id % 7 <> 0), {FX} SELECT id, source, chunk_index, total_chunks FROM fx",
        "index_increment": f"{BASE}, {sparse(5)} {HIT} sp",
        "hybrid_candidates": f"{BASE}, {DENSE_BASE}, {sparse(30)}, {dense(30)}, {HYBRID} SELECT * FROM hy",
        "search_hybrid": f"{BASE}, {DENSE_BASE}, {sparse(30)}, {dense(30)}, {HYBRID}, {rerank('hy', 5, T)} {SHOWN}",
        "semantic_search": f"{BASE}, {DENSE_BASE}, {dense(30)}, {rerank('de', 5, T)} {SHOWN}",
        "keyword_search": f"{BASE}, {sparse(30)}, {rerank('sp', 5, T)} {SHOWN}",
        "filtered_search": f"{BASE}, al AS (SELECT id FROM fx WHERE {predicate(**FILTERED)}), {DENSE_BASE}, {sparse(30, allowed='WHERE id IN (SELECT id FROM al)')}, {dense(30, allowed='id IN (SELECT id FROM al)')}, {HYBRID}, {rerank('hy', 5, T)} {SHOWN}",
        "rerank_topk": f"{BASE}, {sparse(30)}, {rerank('sp', 5)} {HIT} rr",
        "rerank_threshold": f"{BASE}, {sparse(30)}, {rerank('sp', 10, T)} {HIT} rr",
        "find_related": f"{BASE}, {SEEDS}, {_ENTITIES}, al AS (SELECT DISTINCT id FROM (SELECT id, unnest(ents) AS entity FROM fx) JOIN en USING (entity) WHERE id NOT IN (SELECT id FROM seeds)), {DENSE_BASE}, {dense(30, allowed='id IN (SELECT id FROM al)')}, {rerank('de', 5, T)} {SHOWN}",
        "related_chunks": f"WITH {FX}, {SEEDS}, {_ENTITIES} SELECT DISTINCT id, source, chunk_index FROM (SELECT id, source, chunk_index, unnest(ents) AS entity FROM fx) JOIN en USING (entity) WHERE id NOT IN (SELECT id FROM seeds)",
        "find_related_passages": f"""{BASE.replace(QUERIES, _SAID)}, {SEEDS}, {_ENTITIES}, al AS (SELECT DISTINCT id FROM (SELECT id, unnest(ents) AS entity FROM fx) JOIN en USING (entity) WHERE id NOT IN (SELECT id FROM seeds)),
  {DENSE_BASE}, {dense(30, allowed='id IN (SELECT id FROM al)')}, {rerank('de', 5, T)} {SHOWN}""",
        "agg_seed_entities": f"WITH {FX}, {SEEDS}, {_ENTITIES} SELECT entity FROM en",
        "read_chunk": f"WITH {FX}, {SEEDS} SELECT id, source, {_URL} AS url, page_number AS page, content FROM fx WHERE id IN (SELECT id FROM seeds)",
        "read_neighbors": f"WITH {FX}, {SEEDS} SELECT id, source, {_URL} AS url, page_number AS page, content, chunk_index {_NEAR}",
        "read_neighbors_window": f"WITH {FX}, {SEEDS} SELECT id, source, chunk_index {_NEAR}",
        "prj_search_hit": fx(f"id, source, {_HIT}"),
        "prj_snippet": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'About ' || source ELSE substring(text, 1, 300) END AS snippet FROM documents",
        "prj_source_url": fx(f"id, {_URL} AS url"),
        "prj_hint": f"{BASE}, {sparse(30)} SELECT query_id, CASE WHEN n IS NULL THEN 'No hits: try other words, or English.' ELSE 'Read the best of ' || n || ' hits before citing.' END AS hint FROM qs LEFT JOIN (SELECT query_id, count(*) AS n FROM sp GROUP BY 1) USING (query_id)",
        "fn_scalars": f"""SELECT doc_id, sha256(text) AS sha, length({strip('text')})::bigint AS n_stripped, substring(text, 1, 300) AS head, contains(text, 'T') AS has_t, replace(source, 'src', 's') AS replaced, len(string_split(text, ','))::bigint AS n_parts, starts_with(lang, 'e') AS starts, coalesce(nullif(lang, 'en'), 'default') AS fallback,
greatest(doc_id - 5, 0) AS clipped, len(list_distinct(string_split(text, ' ')))::bigint AS n_distinct, try_cast('2024-' || lpad((doc_id % 14)::varchar, 2, '0') || '-01' AS date)::varchar AS day FROM documents""",
        "golden_min_chars": f"SELECT doc_id, length({strip('text')})::bigint AS n_chars FROM documents WHERE length({strip('text')}) >= 100",
        "golden_sample": f"WITH {_GOLD} SELECT doc_id, draw FROM sa",
        "golden_build": f"WITH {_GOLD}, g AS (SELECT array_to_string(list_slice({tok('text')}, 1, 3), ' ') AS query, doc_id::varchar AS relevant_chunk_ids FROM sa) SELECT * FROM g WHERE query <> ''",
        "golden_explode": f"WITH {FX}, {QUERIES}, {RELEVANT} SELECT query, id AS chunk_id FROM rel JOIN qs USING (query_id)",
        "eval_report": f"{ALL} SELECT mode, round(round(recall_single, 6), 4) AS recall_single, round(round(recall_multi, 6), 4) AS recall_multi, round(round(mrr, 6), 4) AS mrr, round(round(map, 6), 4) AS map FROM mt",
        "agg_batch_summary": f"WITH {FX}, {BATCH}, s AS (SELECT ordinal // 3 AS batch, len({tok('content')}) >= 3 AS ok FROM fx JOIN bt USING (doc_id)) SELECT batch, count(*) FILTER (ok) AS written, count(*) FILTER (NOT ok) AS failed, bool_and(ok) AS all_ok FROM s GROUP BY 1",
        "svc_rate_window": "SELECT user_id, date_trunc('second', ts) AS second, count(*) AS requests, count(*) > 1 AS limited FROM events GROUP BY 1, 2",
    }
    out |= {name: fx("id, source, chunk_index", f"WHERE {predicate(**f)}") for name, f in FILTERS.items()}
    out |= {f"{name}_indexed": out[name] for name in FILTERS}
    return out | {f"eval_{m}": f"{ALL} SELECT mode, round({m}, 6) AS score FROM mt" for m in ("recall_single", "recall_multi", "mrr", "map")}
