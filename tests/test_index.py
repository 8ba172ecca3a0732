"""The index in segments and its block-max search, against brute force over the chunks there are."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shardlight.operators import blockmax, bounded, enrich, tools
from shardlight.operators.filters import Filter
from shardlight.plans import fixture
from shardlight.sources import segments
from shardlight.sources.segments import Index
from shardlight.streaming.index import Queue, batch_states, changes, index_stream, index_with_retries, sync

DOC = "doc_id long, lang string, source string, text string"


def documents(spark, rows):
    return spark.createDataFrame([(k, "en", "s", text) for k, text in rows], DOC)


def some_text(r, n):
    """Lines over a few words, some frequent and some rare."""
    words = [f"w{k}" for k in range(60)]
    return "\n".join(" ".join(r.choices(words, [1 / (k + 1) for k in range(60)], k=r.randint(1, 25))) for _ in range(n))


def by_hand(chunks, queries, k, ids=None):
    """query_id, id, score by BM25 over the embedded text, from its definition; ids: those that a filter leaves."""
    tokens = lambda t: re.findall(r"\w+", t.lower())
    own = {r.id: Counter(tokens("\n".join([*r.headings, *r.keywords, *r.dates, r.content]))) for r in chunks}
    own = {i: t for i, t in own.items() if t}
    length = {i: t.total() for i, t in own.items()}
    average = sum(length.values()) / len(own)
    df = Counter(term for t in own.values() for term in t)
    out = []
    for q, text in queries:
        scores = Counter()
        for term in set(tokens(text)):
            idf = math.log1p((len(own) - df[term] + 0.5) / (df[term] + 0.5))
            for i, t in own.items():
                if t[term] and (ids is None or i in ids):
                    scores[i] += idf * t[term] * 2.2 / (t[term] + 1.2 * (0.25 + 0.75 * length[i] / average))
        best = sorted((-round(s, 6), i) for i, s in scores.items())[:k]
        out += [(q, i, -s) for s, i in best]
    return sorted(out)


def found(collection, queries, k, spark, allowed=None):
    q = spark.createDataFrame(queries, "query_id long, query string")
    return sorted((r.query_id, r.id, r.score) for r in collection.sparse(q, k, allowed).collect())


def close(a, b):
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert np.allclose([x[2] for x in a], [x[2] for x in b], atol=2e-6)


QUERIES = [(1, "w0 w1 w2 w40"), (2, "w55"), (3, "w3 w3 w17 nothing"), (4, "nothing"), (5, " ".join(f"w{k}" for k in range(60)))]


@pytest.fixture
def small_parts(monkeypatch):
    """Many parts and ranges from few chunks."""
    monkeypatch.setattr(segments, "PART", 40)
    monkeypatch.setattr(segments, "LEAST", 20)


def test_search_equals_brute_force_and_reads_less(spark, tmp_path, small_parts):
    r = random.Random(1)
    docs = documents(spark, [(k, some_text(r, 12)) for k in range(100)] + [(900, "w0 w1\nw0 w1\n\n!!")])
    tools.index(fixture.line_chunks(docs), str(tmp_path / "i"))
    c = tools.Collection(spark, str(tmp_path / "i"))
    assert len(c.state.commit["segments"][0]["parts"]) > 10
    chunks = c.chunks.collect()
    for k in (1, 5, 2000):
        close(found(c, QUERIES, k, spark), by_hand(chunks, QUERIES, k))
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    reads = {x.query_id: x for x in c.reads(q, 3).collect()}
    assert all(x.read <= x.held for x in reads.values()) and sum(x.read for x in reads.values()) < sum(x.held for x in reads.values())
    assert 4 not in reads
    allowed = c.chunks.where("doc_id % 10 = 3")
    close(found(c, QUERIES, 4, spark, allowed.select("no")), by_hand(chunks, QUERIES, 4, {x.id for x in allowed.collect()}))
    assert found(c, QUERIES, 4, spark, allowed.where("false").select("no")) == []


def test_ties_go_to_smaller_ids_also_over_segments(spark, tmp_path, small_parts):
    own = Index(spark, str(tmp_path / "i"))
    for a in (0, 30, 60):
        own.upsert(fixture.line_chunks(documents(spark, [(3 * k, "same words here\nsame words here") for k in range(a, a + 30)])))
    c = tools.Collection(spark, str(tmp_path / "i"))
    assert len(c.state.commit["segments"]) == 3
    ids = sorted(r.id for r in c.chunks.collect())
    assert [x[1] for x in found(c, [(1, "words")], 7, spark)] == ids[:7]
    q = spark.createDataFrame([(1, "same words here")], "query_id long, query string")
    assert sorted(r.id for r in c.dense(q, 7).collect()) == ids[:7]


def test_frontiers_bound_their_blocks(spark):
    r = random.Random(2)
    rows = [(k, [f"w{min(int(r.expovariate(0.2)), 30)}" for _ in range(r.randint(0, 40))]) for k in range(1500)]
    made = blockmax.blocks(spark.createDataFrame(rows, "no long, tokens array<string>").coalesce(1)).collect()
    lengths = {(x.range << blockmax.RANGE_BITS) + a: n for x in made if x.term == "" for a, n in zip(x.at, x.tf)}
    assert lengths == {k: len(t) for k, t in rows}
    got = {}
    for x in made:
        if x.term:
            own = [((x.range << blockmax.RANGE_BITS) + a, tf) for a, tf in zip(x.at, x.tf)]
            got.update({(no, x.term): tf for no, tf in own})
            assert x.n == len(own)
            for average in (1.0, 20.0, 500.0):
                best = max(blockmax.saturated(tf, lengths[no], average) for no, tf in own)
                assert math.isclose(best, max(blockmax.saturated(a, b, average) for a, b in zip(x.top_tf, x.top_dl)))
    assert got == {(k, t): ts.count(t) for k, ts in rows for t in set(ts)}


def test_bounded_search_equals_brute_force_and_skips_clusters(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(20, 8)) * 5
    m = np.concatenate([centres[r.integers(0, 20, 1500)] + r.normal(size=(1500, 8)) * 0.3, np.zeros((2, 8))])
    m[7] = m[3]
    nos = np.concatenate([np.arange(700), (1 << bounded.PART_BITS) + np.arange(802)])
    rows = [(int(n), x.tolist()) for n, x in zip(nos, m)]
    odd = [(5000, None), (5001, [1.0, None] * 4), (5002, [float("nan")] * 8), (5003, []), (5004, [1.0, 2.0])]
    stored = bounded.clusters(spark.createDataFrame(sorted(rows + odd), "no long, embedding array<double>").coalesce(1)).persist()
    back = {x.no: x.embedding for x in bounded.vectors_of(stored).collect()}
    assert back == {**dict(rows), 5004: [1.0, 2.0]}
    asked = bounded.Asked(list(range(30)), centres[r.integers(0, 20, 30)] + r.normal(size=(30, 8)), 5)
    got = bounded.scored(stored, asked, "bigint").collect()
    scores = np.round(asked.vectors @ m.T, 6)
    for q in range(30):
        best = np.lexsort((nos, -scores[q]))[:5]
        own = sorted(((-x.score, x.no) for x in got if x.query_id == q and x.no is not None))[:5]
        assert [x[1] for x in own] == nos[best].tolist() and np.allclose([-x[0] for x in own], scores[q, best])
    told = [x for x in got if x.no is None]
    assert {x.query_id for x in told} == set(range(30)) and all(x.held == 1502 for x in told)
    assert sum(x.read for x in told) < 0.5 * sum(x.held for x in told)


def test_bounds_hold_for_every_vector():
    r = np.random.default_rng(6)
    for _ in range(50):
        m = r.normal(size=(40, 5)) * r.uniform(0, 3, (40, 1))
        centre = bounded.unit(m.sum(0)[None])[0]
        cosine = (bounded.unit(m)[0] @ centre[0]).min()
        size = np.sqrt((m * m).sum(1))
        asked = r.normal(size=(20, 5)) * 10
        assert (bounded.bounds(asked, centre, np.array([cosine]), np.array([size.min()]), np.array([size.max()]))[:, 0] >= (asked @ m.T).max(1) - 1e-6).all()


def test_related_chunks_by_hand(spark, tmp_path):
    docs = documents(spark, [(1, "Zebracrossing and Lionsharing"), (2, "Zebracrossing alone"), (3, "nothing here"), (4, "Lionsharing\nZebracrossing again"), (5, "Tigerclub only"), (6, "nothing\nTigerclub")])
    chunks = fixture.line_chunks(docs).withColumn("ent_products", F.lit(None).cast("array<string>"))
    own = Index(spark, str(tmp_path / "i"))
    own.upsert(chunks.where("doc_id < 5"))
    own.upsert(chunks.where("doc_id >= 5"))
    c = tools.Collection(spark, str(tmp_path / "i"))
    rows = {r.id: r for r in c.chunks.collect()}
    id_of = {r.content: i for i, r in rows.items()}
    kind = {f: {r.content: list(r[f] or []) for r in rows.values()} for f in ("ent_persons", "ent_organizations", "ent_locations")}
    assert any(kind["ent_organizations"].values()) and any(kind["ent_locations"].values())
    of = lambda *s: sorted(rows[i].content for i in (r.id for r in c.state.related(spark.createDataFrame([(id_of.get(x, x),) for x in s], "id string")).join(c.state.ids(), "no").collect()))
    assert of("Zebracrossing alone") == ["Zebracrossing again", "Zebracrossing and Lionsharing"]
    assert of("Zebracrossing and Lionsharing", "unknown") == ["Lionsharing", "Zebracrossing again", "Zebracrossing alone"]
    assert of("nothing here") == of("unknown") == of() == []
    own.delete(spark.createDataFrame([(id_of["Zebracrossing again"],)], "id string"))
    c = tools.Collection(spark, str(tmp_path / "i"))
    assert of("Zebracrossing alone") == ["Zebracrossing and Lionsharing"]
    q = spark.createDataFrame([(1, "Zebracrossing and Lionsharing")], "query_id long, query string")
    hits = c.find_related(spark.createDataFrame([(id_of["Zebracrossing alone"],)], "id string"), q).collect()
    assert [h.id for h in hits] == [id_of["Zebracrossing and Lionsharing"]]


def test_an_index_that_grew_equals_a_fresh_one(spark, tmp_path, small_parts):
    r = random.Random(3)
    state = {k: some_text(r, 6) for k in range(40)}
    own = Index(spark, str(tmp_path / "grown"), most=4)
    own.upsert(fixture.line_chunks(documents(spark, list(state.items()))))
    for step in range(5):
        new = {k: some_text(r, r.randint(1, 6)) for k in r.sample(range(50), 6)}
        state |= new
        own.upsert(fixture.line_chunks(documents(spark, list(new.items()))), replace_source=True)
        if step == 2:
            dropped = fixture.line_chunks(documents(spark, [(7, state.pop(7))]))
            own.delete(dropped.select("id"))
    fresh = Index(spark, str(tmp_path / "fresh"))
    fresh.replace(fixture.line_chunks(documents(spark, list(state.items()))))
    a, b = (tools.Collection(spark, str(tmp_path / p)) for p in ("grown", "fresh"))
    assert len(a.state.commit["segments"]) <= 4
    assert {x: a.state.commit[x] for x in ("n", "length", "rows")} == {x: b.state.commit[x] for x in ("n", "length", "rows")}
    cols = ["id", "source", "chunk_index", "total_chunks", "content"]
    assert sorted(map(tuple, a.chunks.select(cols).collect())) == sorted(map(tuple, b.chunks.select(cols).collect()))
    assert sorted(map(tuple, a.state.terms().collect())) == sorted(map(tuple, b.state.terms().collect()))
    close(found(a, QUERIES, 5, spark), found(b, QUERIES, 5, spark))
    close(found(a, QUERIES, 5, spark), by_hand(b.chunks.collect(), QUERIES, 5))
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    for search in ("keyword_and_semantic_search", "semantic_search", "keyword_search"):
        assert sorted(map(tuple, getattr(a, search)(q).collect())) == sorted(map(tuple, getattr(b, search)(q).collect()))
    filter_ = Filter(modified_from="2024-01-05", modified_to="2024-01-20")
    assert sorted(map(tuple, a.filtered_search(q, filter_).collect())) == sorted(map(tuple, b.filtered_search(q, filter_).collect()))


def test_readers_keep_their_state_and_a_crash_changes_nothing(spark, tmp_path, monkeypatch):
    own = Index(spark, str(tmp_path / "i"))
    assert own.read() is None
    with pytest.raises(ValueError):
        own.snapshot()
    own.upsert(fixture.line_chunks(documents(spark, [(1, "one two"), (2, "two three")])))
    before = tools.Collection(spark, str(tmp_path / "i"))
    own.upsert(fixture.line_chunks(documents(spark, [(3, "two four")])))
    assert before.chunks.count() == 2 and len(found(before, [(1, "two")], 5, spark)) == 2
    assert len(found(tools.Collection(spark, str(tmp_path / "i")), [(1, "two")], 5, spark)) == 3
    assert len(found(tools.Collection(spark, str(tmp_path / "i"), version=1), [(1, "two")], 5, spark)) == 2
    with monkeypatch.context() as m:
        m.setattr(segments.Commits, "add", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            own.upsert(fixture.line_chunks(documents(spark, [(4, "two five")])))
    assert own.version() == 2 and own.read().count() == 3
    stale = Index(spark, str(tmp_path / "i"))
    monkeypatch.setattr(stale.commits, "version", lambda: 1)
    with pytest.raises(RuntimeError, match="took version"):
        stale.upsert(fixture.line_chunks(documents(spark, [(4, "two five")])))
    own.vacuum()
    assert own.read().count() == 3 and len(found(tools.Collection(spark, str(tmp_path / "i")), [(1, "two")], 5, spark)) == 3


def test_an_index_of_nothing(spark, tmp_path):
    own = Index(spark, str(tmp_path / "i"))
    own.upsert(fixture.line_chunks(documents(spark, [])))
    c = tools.Collection(spark, str(tmp_path / "i"))
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    assert c.keyword_and_semantic_search(q).count() == 0 and c.chunks.count() == 0
    own.upsert(fixture.line_chunks(documents(spark, [(1, "!!\n??")])))
    assert found(tools.Collection(spark, str(tmp_path / "i")), QUERIES, 3, spark) == []
    own.upsert(fixture.line_chunks(documents(spark, [(2, "w55 here")])))
    assert len(found(tools.Collection(spark, str(tmp_path / "i")), QUERIES, 3, spark)) == 2


def test_a_stream_fills_what_is_searched(spark, tmp_path):
    docs = documents(spark, [(1, "w0 w1\nw2"), (2, "w0 w5")])
    own = Index(spark, str(tmp_path / "i"))
    for batch in (docs, docs.where("doc_id = 1").withColumn("text", F.lit("w9 alone"))):
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
        index_stream(stream, own, str(tmp_path / "at"), fixture.line_chunks, str(tmp_path / "status"), replace_source=True).awaitTermination()
    c = tools.Collection(spark, str(tmp_path / "i"))
    assert sorted(r.content for r in c.chunks.collect()) == ["w0 w5", "w9 alone"]
    assert [r.status for r in batch_states(spark.read.parquet(str(tmp_path / "status"))).collect()] == ["ok", "ok"]
    assert len(found(c, [(1, "w0")], 5, spark)) == 1 and found(c, [(1, "w2")], 5, spark) == []


def test_a_document_that_failed_is_indexed_by_the_next_run(spark, tmp_path):
    docs = documents(spark, [(1, "good one"), (2, "bad words"), (3, "good three")]).withColumn("source", F.concat(F.lit("s/"), F.col("doc_id").cast("string")))
    index, works = Index(spark, str(tmp_path / "i")), []

    def chunk(rows):
        made = fixture.line_chunks(rows.withColumn("source", F.lit("s")))
        broken = F.col("content").startswith("bad") & F.lit("fixed" not in works) | F.col("content").startswith("never")
        return made.withColumn("status", F.when(broken, F.lit("no answer")).otherwise(F.lit("ok")))

    def run(rows=None, chunk_=chunk):
        if rows is not None:
            rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
        index_with_retries(stream, index, str(tmp_path / "at"), chunk_, str(tmp_path / "queue"), most=3).awaitTermination()
        return sorted(r.content for r in index.read().collect()), sorted((r.source, r.attempts, r.error) for r in Queue(docs, str(tmp_path / "queue")).read().collect())

    assert run(docs) == (["good one", "good three"], [("s/2", 1, "no answer")])
    other = docs.where("doc_id = 3").withColumns({"doc_id": F.lit(4).cast("long"), "source": F.lit("s/4"), "text": F.lit("never good")})
    assert run(other) == (["good one", "good three"], [("s/2", 2, "no answer"), ("s/4", 1, "no answer")])
    works.append("fixed")
    third = docs.where("doc_id = 1").withColumn("text", F.lit("good again"))
    assert run(third) == (["bad words", "good again", "good three"], [("s/4", 2, "no answer")])

    def fails(rows):
        raise ValueError("all of it")

    fifth = docs.where("doc_id = 3").withColumn("text", F.lit("good later"))
    assert run(fifth, fails) == (["bad words", "good again", "good three"], [("s/3", 1, "all of it"), ("s/4", 3, "all of it")])
    sixth = docs.where("doc_id = 1").withColumn("text", F.lit("good end"))
    assert run(sixth) == (["bad words", "good end", "good later"], [("s/4", 3, "all of it")])  # used up its attempts


def test_changes_by_source_and_time(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "doc_id long, lang string, source string, text string, at string").withColumn("modified_at", F.col("at").cast("timestamp_ntz")).drop("at")
    chunk = lambda r: fixture.line_chunks(r.withColumn("source", F.lit("s"))).drop("modified_at").join(r.select("doc_id", "modified_at"), "doc_id")
    index = Index(spark, str(tmp_path / "i"))
    sync(rows((1, "en", "s/1", "a\nb", "2024-01-01"), (2, "en", "s/2", "c", "2024-01-01"), (3, "en", "s/3", "d", "2024-01-01")), index, chunk)
    now = rows((1, "en", "s/1", "a", "2024-01-02"), (2, "en", "s/2", "unseen as its time is the same", "2024-01-01"), (4, "en", "s/4", "e", "2023-01-01"))
    fresh, stale = changes(now, index)
    assert sorted(r.source for r in fresh.collect()) == ["s/1", "s/4"] and [r.source for r in stale.collect()] == ["s/3"]
    sync(now, index, chunk)
    assert sorted((r.source, r.content) for r in index.read().collect()) == [("s/1", "a"), ("s/2", "c"), ("s/4", "e")]
    assert [x.count() for x in changes(now, index)] == [0, 0]


def test_one_bad_row_fails_alone(spark):
    def model(contents):
        if (contents == "bad").any():
            raise RuntimeError("no answer")
        return pd.DataFrame({"context": contents})

    rows = spark.createDataFrame([(str(k), "bad" if k == 3 else "fine") for k in range(8)], "id string, content string").coalesce(1)
    assert {r.id: r.status for r in enrich.enriched(rows, model).collect()} == {str(k): "failed: no answer" if k == 3 else "ok" for k in range(8)}


def test_bitmaps_leave_what_the_predicate_leaves(spark, tmp_path, small_parts):
    r = random.Random(9)
    some = lambda *values: r.choice([None, [], [None], *([v] for v in values), list(values[:2]), [values[0], None]])
    rows = []
    for k in range(150):
        at = r.choice([None, "2024-01-31T23:59:59", "2024-01-31T23:59:59.500000", "2024-02-01T00:00:00", "2023-05-05T12:00:00"])
        rows.append((f"id{k:03}", "s", f"w{k}", ["h"], some("x", "y"), some("2024-01-01", "2024-13-45", "2019-01-01", "soon", "2030-01-01"), some("text", "table"), some("p", "q"), some("p"), some("z"), some("q", "z"), at))
    names = "id string, source string, content string, headings array<string>, keywords array<string>, dates array<string>, content_types array<string>, ent_persons array<string>, ent_organizations array<string>, ent_products array<string>, ent_locations array<string>, at string"
    chunks = spark.createDataFrame(rows, names).withColumn("modified_at", F.col("at").cast("timestamp_ntz")).drop("at")
    index = Index(spark, str(tmp_path / "i"))
    index.upsert(chunks)
    index.upsert(chunks.where("id < 'id020'").withColumn("keywords", F.array(F.lit("y"))))
    c = tools.Collection(spark, str(tmp_path / "i"))
    for own in ({}, {"keywords": ["x"]}, {"keywords": ["y", "none"], "content_types": ["text"]}, {"entities": ["p", "z"]}, {"date_from": "2024-01-01"}, {"date_from": "2020-01-01", "date_to": "2025-01-01"}, {"modified_to": "2024-01-31"}, {"modified_from": "2024-01-31", "modified_to": "2024-02-01"}, {"entities": ["q"], "keywords": ["y"], "modified_from": "2023-01-01"}, {"keywords": ["none"]}):
        filter_ = Filter(**own)
        want = sorted(x.no for x in c.chunks.where(filter_.predicate()).select("no").collect())
        got = [x.no for x in c.state.allowed(filter_).collect()]
        assert sorted(got) == want, own
    with pytest.raises(ValueError):
        c.state.allowed(Filter(date_from="soon"))
    plan = c.state.allowed(Filter(keywords=["x"]))._jdf.queryExecution().toString()
    assert "w0:bigint" in plan and "content:string" not in plan


def test_tables_are_made_by_the_first_reader_and_kept(spark, tmp_path, small_parts):
    r = random.Random(11)
    first, then = ({k: some_text(r, 5) for k in ks} for ks in (range(30), range(20, 35)))
    for name, tables in (("at_once", segments.TABLES), ("later", [])):
        own = Index(spark, str(tmp_path / name), tables=tables)
        own.upsert(fixture.line_chunks(documents(spark, list(first.items()))))
        own.upsert(fixture.line_chunks(documents(spark, list(then.items()))), replace_source=True)
        own.delete(fixture.line_chunks(documents(spark, [(33, then[33])])).select("id"))
    made = lambda name: {f.name for f in (tmp_path / name / "segments").glob("*/*")} | {f.name for f in (tmp_path / name / "gone").glob("*/*")}
    assert made("later") == {"chunks", "numbers"}
    a, b = (tools.Collection(spark, str(tmp_path / p)) for p in ("at_once", "later"))
    close(found(a, QUERIES, 5, spark), found(b, QUERIES, 5, spark))
    close(found(b, QUERIES, 5, spark), by_hand(a.chunks.collect(), QUERIES, 5))
    assert made("later") == {"chunks", "numbers", "terms", "stats", "postings"}
    assert b.state.totals == (a.state.commit["n"], a.state.commit["length"])
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    filter_ = Filter(modified_from="2024-01-05", modified_to="2024-01-20")
    assert sorted(map(tuple, a.filtered_search(q, filter_).collect())) == sorted(map(tuple, b.filtered_search(q, filter_).collect()))
    assert made("later") == made("at_once") - {"entities"}


def test_repeated_ids_are_one_chunk_the_last(spark, tmp_path, small_parts):
    chunks = fixture.line_chunks(documents(spark, [(k, f"w{k} same") for k in range(60)]))
    own = Index(spark, str(tmp_path / "i"))
    again = chunks.withColumn("batch", F.lit(2)).withColumn("page_number", F.lit(7))
    own.upsert(chunks.withColumn("batch", F.lit(1)).unionByName(again).unionByName(chunks.withColumn("batch", F.lit(0))), order="batch")
    rows = own.read().collect()
    assert len({x.id for x in rows}) == len(rows) == 60 and {x.page_number for x in rows} == {7}
    assert own.snapshot().commit["rows"] == 60


def test_blocks_leave_a_task_by_part_term_and_range(spark, monkeypatch):
    r = random.Random(12)
    rows = [((part << blockmax.PART_BITS) + k, [f"é{min(int(r.expovariate(0.2)), 30)}" for _ in range(r.randint(0, 9))]) for part in (3, 1) for k in range(9000)]
    made = blockmax.blocks(spark.createDataFrame(rows, "no long, tokens array<string>").coalesce(1)).select("part", "term", "range").collect()
    for part in (3, 1):
        own = [(x.term.encode(), x.range) for x in made if x.part == part]
        assert own == sorted(own) and len(own) == len(set(own))
    assert [x.part for x in made] == sorted((x.part for x in made), reverse=True)


def test_queries_of_the_same_terms_are_searched_once(spark, tmp_path, small_parts, monkeypatch):
    r = random.Random(13)
    tools.index(fixture.line_chunks(documents(spark, [(k, some_text(r, 12)) for k in range(60)])), str(tmp_path / "i"))
    c, asked = tools.Collection(spark, str(tmp_path / "i")), []
    of = blockmax.Asked.of
    monkeypatch.setattr(blockmax.Asked, "of", lambda rows, *more: asked.extend(rows) or of(rows, *more))
    queries = [(1, "w0 w1 w5"), (2, "W5 w1 w0 w0"), (3, "w2"), (4, "w1 w0 w5")]
    close(found(c, queries, 4, spark), by_hand(c.chunks.collect(), queries, 4))
    assert {x[0] for x in asked} == {1, 3}
    assert [x.query_id for x in c.reads(spark.createDataFrame(queries, "query_id long, query string"), 4).orderBy("query_id").collect()] == [1, 2, 3, 4]


def test_frequent_terms_are_multiplied_for_all_queries_at_once(spark, tmp_path, monkeypatch):
    """Parts, whose frontiers are not read, with many terms in their matrix, few, or none."""
    r = random.Random(14)
    docs = documents(spark, [(k, some_text(r, 12)) for k in range(60)] + [(900 + k, "w0 w1 w3 w9\nw0 w1") for k in range(9)])
    Index(spark, str(tmp_path / "i"), tables=["postings"]).replace(fixture.line_chunks(docs))
    c = tools.Collection(spark, str(tmp_path / "i"))
    chunks = c.chunks.collect()
    queries = [*QUERIES, *((10 + k, x.content) for k, x in enumerate(r.sample(chunks, 20)))]
    terms = c._terms(spark.createDataFrame(queries, "query_id long, query string")).join(c.state.terms(), "term").select("query_id", "term", "idf").collect()
    names = [x.split(" ")[0] for x in blockmax.BLOCKS.split(", ") if not x.startswith("top_")]
    rows = c.state.blocks(sorted({x.term for x in terms})).select(names).toArrow()
    right = by_hand(chunks, queries, len(chunks))
    for frequent, scores in ((1, 1 << 22), (100, 1 << 12), (1 << 20, 1)):
        monkeypatch.setattr(blockmax, "FREQUENT", frequent)
        monkeypatch.setattr(blockmax, "SCORES", scores)
        for k in (1, 4, 500):
            asked = blockmax.Asked.of([tuple(x) for x in terms], c.state.average, k)
            hits: dict[int, list] = {q: [] for q in asked.queries}
            for part in sorted(set(rows["part"].to_pylist())):
                one = blockmax.Part(rows.filter(blockmax.pc.equal(rows["part"], part)), asked, False)
                assert (len(one.matrix) > 0) == (frequent < 1 << 20)
                top, counts = {}, np.zeros((len(asked.queries), 2), np.int64)
                one.search(top, asked.reach.copy(), counts)
                assert (counts[:, 1] <= counts[:, 0]).all()
                for (q, _), (s, v) in top.items():
                    hits[asked.queries[q]] += zip((-s).tolist(), v.tolist())
            ids = {x.no: x.id for x in chunks}
            first = [sorted(((q, i, s) for q, i, s in right if q == of), key=lambda x: (-x[2], x[1]))[:k] for of in asked.queries]
            close(sorted((q, ids[v], -s) for q, own in hits.items() for s, v in sorted(own)[:k]), sorted(x for own in first for x in own))


def test_vectors_of_many_clusters_are_multiplied_at_once():
    r = np.random.default_rng(15)
    for many, k, scores in ((700, 5, 1 << 20), (90, 30, 1000), (7, 30, 1)):
        m, q = r.normal(size=(many, 4)).round(1), r.normal(size=(40, 4)).round(1)
        asked = bounded.Asked(list(range(40)), q, k)
        top, reach = {}, asked.reach.copy()
        before, bounded.SCORES = bounded.SCORES, scores
        for a in range(0, many, 300):  # in no order of their numbers
            bounded.together(asked, np.arange(many)[::-1][a : a + 300], m[::-1][a : a + 300], reach, top)
        bounded.SCORES = before
        for i in range(40):
            s = np.round(m @ q[i], 6)
            by = np.lexsort((np.arange(many), -s))[:k]
            assert top[i, 0][1].tolist() == by.tolist() and np.allclose(top[i, 0][0], s[by])
