"""Hand-built frames for what the tables do not show."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shardlight.functions import text as T
from shardlight.operators import convert, enrich, evaluate, filters, retrieve, tools
from shardlight.plans import fixture
from shardlight.sources import documents as src


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


ARRAYS = "id string, keywords array<string>, dates array<string>, content_types array<string>, ent_persons array<string>, ent_organizations array<string>, ent_products array<string>, ent_locations array<string>, modified_at timestamp_ntz"


def chunk(spark, *rows):
    full = [(r.get("id"), r.get("keywords"), r.get("dates"), r.get("content_types"), r.get("p"), r.get("o"), r.get("pr"), r.get("l"), r.get("m")) for r in rows]
    return spark.createDataFrame(full, ARRAYS)


def kept(df, **supplied):
    return ids(df.where(filters.Filter(**supplied).predicate()))


def test_array_filters_do_not_yield_null(spark):
    df = chunk(spark, {"id": "a", "keywords": ["x", None]}, {"id": "b", "keywords": [None]}, {"id": "c"}, {"id": "d", "l": ["x"]})
    assert kept(df, keywords=["x"]) == ["a"]
    assert kept(df, entities=["x"]) == ["d"]
    assert kept(df) == ["a", "b", "c", "d"]


def test_different_dates_may_meet_the_two_bounds(spark):
    df = chunk(spark, {"id": "a", "dates": ["2019-01-01", "2030-01-01"]}, {"id": "b", "dates": ["2024-13-45"]}, {"id": "c", "dates": ["2024-06-01"]})
    assert kept(df, date_from="2024-01-01", date_to="2025-01-01") == ["a", "c"]
    with pytest.raises(ValueError):
        kept(df, date_from="soon")


def test_last_day_ends_before_its_last_second_is_over(spark):
    at = lambda s: dt.datetime.fromisoformat(s)
    df = chunk(spark, {"id": "a", "m": at("2024-01-31T23:59:59")}, {"id": "b", "m": at("2024-01-31T23:59:59.500000")}, {"id": "c", "m": at("2024-02-01T00:00:00")})
    assert kept(df, modified_to="2024-01-31") == ["a"]
    assert kept(df, modified_to="2024-02-01T00:00:00") == ["a", "b", "c"]


def test_none_of_keeps_unknown_values_out_of_the_way(spark):
    df = chunk(spark, {"id": "a"}, {"id": "b"}, {"id": None})
    assert [r.id for r in df.where(filters.none_of("id", ["b", "zz"])).collect()] == ["a", None]
    assert df.where(filters.none_of("id", [])).count() == 3


def test_page_anchor_and_snippet(spark):
    df = spark.createDataFrame([(None, None, None), (0, "", "\U0001f600" * 301), (3, "ctx", None)], "page int, context string, content string")
    got = df.select(T.source_url(F.lit("u"), F.col("page")), T.snippet(F.col("context"), F.col("content"))).collect()
    assert [tuple(r) for r in got] == [("u", ""), ("u", "\U0001f600" * 300), ("u#page=3", "ctx")]


SPOTS = "id string, source string, chunk_index int, total_chunks int"


def test_neighbours(spark):
    rows = [(f"a{i}", "a", i, 4) for i in range(4)] + [("b1", "b", 1, 3), ("a1x", "a", 1, 4), ("n", "a", None, None), ("a9", "a", 9, 4)]
    df = spark.createDataFrame(rows, SPOTS)
    of = lambda seeds, w=1: ids(retrieve.neighbours(df, spark.createDataFrame([(s,) for s in seeds], "id string"), w))
    assert of(["a0"]) == ["a0", "a1", "a1x"]
    assert of(["a3", "a2", "a2", "zz"]) == ["a1", "a1x", "a2", "a3"]
    assert of(["n"]) == []
    with pytest.raises(ValueError):
        tools.within("window", 11, 1, 10)


def test_seeds_without_entities_are_related_to_nothing(spark):
    df = chunk(spark, {"id": "a", "p": [], "o": [], "pr": [], "l": []}, {"id": "b", "p": ["x"], "o": [], "pr": [], "l": []}, {"id": "c", "p": [], "o": ["x"], "pr": [], "l": []})
    seeds = lambda *s: spark.createDataFrame([(x,) for x in s], "id string")
    assert ids(retrieve.related(df, seeds("a"))) == []
    assert ids(retrieve.related(df, seeds("b", "unknown"))) == ["c"]


def test_threshold_is_inclusive_and_failures_stop(spark):
    posted = spark.createDataFrame([(0, "a", 1, 1.0), (0, "b", 1, 1.0), (0, "a", 2, 1.0)], "bucket int, term string, doc_id long, idf double")
    idf = spark.createDataFrame([(0, "a", 1.0), (0, "b", 1.0)], "bucket int, term string, idf double")
    q = spark.createDataFrame([(7, 0, "a"), (7, 0, "b")], "query_id long, bucket int, term string")
    c = spark.createDataFrame([(7, 1), (7, 2), (7, 3)], "query_id long, doc_id long")
    assert [r.doc_id for r in retrieve.rerank(c, posted, idf, q, 5, 0.5).orderBy("rank").collect()] == [1, 2]
    assert [r.score for r in retrieve.rerank(c, posted, idf, q, 5).orderBy("rank").collect()] == [1.0, 0.5, 0.0]
    chunks = spark.createDataFrame([("x", "fine"), ("y", "bad")], "id string, content string").repartition(2, "id")

    def model(s):
        if (s == "bad").any():
            raise RuntimeError("no answer")
        return pd.DataFrame({"context": s, "keywords": [["k"]] * len(s)})

    ok, failed = enrich.split_failures(enrich.enriched(chunks, model))
    assert [r.keywords for r in ok.collect()] == [["k"]] and [r.id for r in failed.collect()] == ["y"]


def test_structured_answers(spark):
    rows = [("a", '{"context": "c", "keywords": ["k"], "dates": null}'), ("b", "no json"), ("c", None), ("d", '{"keywords": ["k"]}'), ("e", '{"context": "c", "keywords": 3}')]
    got = {r.id: r for r in enrich.structured(spark.createDataFrame(rows, "id string, response string")).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "ok", "b": "failed", "c": "failed", "d": "failed", "e": "ok"}
    assert got["a"].keywords == ["k"] and got["a"].dates == [] and got["e"].keywords == []


def test_dense_takes_no_broken_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.5, None]), ("c", None), ("d", [1.0]), ("e", [float("nan"), 1.0]), ("f", [0.2, 3.0])]
    base = spark.createDataFrame(rows, "id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (2, None)], "query_id long, embedding array<double>")
    got = retrieve.dense(base, asked, 5, "id").orderBy("rank").collect()
    assert [(r.query_id, r.id, r.score) for r in got] == [(1, "f", 3.2), (1, "a", 1.0)]
    assert retrieve.dense(base, asked.where("query_id = 2"), 5, "id").count() == 0


def test_conversion_fails_file_by_file(spark):
    def convert_(contents):
        if contents.str.contains("bad").any():
            raise ValueError("no")
        return '{"items": [{"label": "text", "text": "' + contents + '", "pages": [2, 1]}]}'

    files = spark.createDataFrame([("x", "fine"), ("y", "bad"), ("z", "good")], "source string, content string").coalesce(1)
    got = {r.source: r for r in convert.tree_items(convert.converted(files, convert_)).collect()}
    assert got["x"]["items"][0].text == "fine" and got["z"].status == "ok" and got["y"].status == "failed: no" and got["y"]["items"] is None


def test_chunks_follow_headings(spark):
    items = [("section_header_1", "Top"), ("text", "a b c"), ("text", "d e"), ("section_header_2", "Sub"), ("list_item", "f"), ("section_header_2", "Next"), ("text", "g h i j k l m"), ("text", "n"), ("section_header_1", "End")]
    rows = [(1, "kept", [(label, text, [k + 1]) for k, (label, text) in enumerate(items)]), (2, None, None), (3, None, [])]
    docs = spark.createDataFrame(rows, f"doc_id long, lang string, items {convert.ITEMS}")
    got = convert.chunked(docs, 5).orderBy("chunk_index").collect()
    assert [(r.content, r.headings, r.n_tokens, r.page_number) for r in got] == [
        ("Top\na b c", [], 4, 1), ("d e", ["Top"], 2, 3), ("Sub\nf", ["Top"], 2, 4), ("Next", ["Top"], 1, 6), ("g h i j k l m", ["Top", "Next"], 7, 7), ("n", ["Top", "Next"], 1, 8), ("End", [], 1, 9)]
    assert {r.total_chunks for r in got} == {7} and {r.lang for r in got} == {"kept"} and got[2].content_types == ["list_item", "section_header"]


def test_search_read_and_widen(spark, tmp_path):
    docs = spark.createDataFrame([(i, "en", "s", f"line about Zebracrossing number {i}\nplain words here\nanother {'tiger' if i == 3 else 'lion'} line") for i in range(6)], "doc_id long, lang string, source string, text string")
    tools.index(fixture.line_chunks(docs), str(tmp_path / "i"))
    c = tools.Collection(spark, str(tmp_path / "i"))
    q = spark.createDataFrame([(1, "the tiger")], "query_id long, query string")
    best = c.keyword_search(q).where("rank = 1")
    assert best.columns == ["query_id", "rank", "id", "score", "source", "url", "page", "headings", "snippet"]
    assert c.read_chunk(best).first().content == "another tiger line"
    assert [r.content for r in c.read_neighbors(best).collect()] == ["plain words here", "another tiger line"]
    assert {r.snippet for r in c.find_related(best, q).collect()} <= {r.content for r in c.chunks.collect()}
    assert all(r.source == "s/3" for r in c.filtered_search(q, filters.Filter(modified_from="2024-01-04", modified_to="2024-01-04")).collect())
    scored = tools.Collection(spark, str(tmp_path / "i"), rerank=lambda query, content: F.length(content).cast("double"))
    got = scored.keyword_and_semantic_search(q).orderBy("rank").collect()
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True) and got[0].score == len("line about Zebracrossing number 0")


def test_metrics_tell_mrr_from_map(spark):
    rel = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 20)], "query_id long, doc_id long")
    got = spark.createDataFrame([("m", 1, 10, 1), ("m", 1, 99, 2), ("m", 1, 11, 3), ("m", 2, 98, 1), ("m", 3, 10, 1)], "mode string, query_id long, doc_id long, rank int")
    scores = {r.metric: r.score for r in evaluate.metrics(rel, got, ["m"]).collect()}
    assert scores == {"recall_single": 0.5, "recall_multi": round(2 / 3 / 2, 6), "mrr": 0.5, "map": round((1 + 2 / 3) / 2 / 2, 6)}


def test_upsert_twice_is_upsert_once(spark, tmp_path):
    store = src.Store(spark, str(tmp_path / "store"), 4, dims=8)
    assert store.read() is None
    one = spark.createDataFrame([("a", "s", 1), ("b", "s", 1)], "id string, source string, v int")
    store.upsert(one)
    store.upsert(one)
    assert store.read().count() == 2
    store.upsert(spark.createDataFrame([("a", "s", 2)], one.schema))
    assert {(r.id, r.v) for r in store.read().collect()} == {("a", 2), ("b", 1)}
    store.upsert(spark.createDataFrame([("a", "s", 5), ("a", "s", 4), ("a", "s", 3)], one.schema), order="v")
    store.vacuum()
    assert {(r.id, r.v) for r in src.Store(spark, str(tmp_path / "store"), dims=8).read().collect()} == {("a", 5), ("b", 1)}
    store.upsert(spark.createDataFrame([("c", "s", 3)], one.schema), replace_source=True)
    assert ids(store.read()) == ["c"]
    with pytest.raises(ValueError):
        src.Store(spark, str(tmp_path / "store"), dims=9)


def test_a_crash_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    store = src.Store(spark, str(tmp_path / "store"), 2)
    one = spark.createDataFrame([("a", "s", 1)], "id string, source string, v int")
    store.upsert(one)
    monkeypatch.setattr(src.Store, "_write", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        store.upsert(spark.createDataFrame([("a", "s", 2)], one.schema))
    monkeypatch.undo()
    assert [r.v for r in store.read().collect()] == [1] and store.version() == 1
    stale = src.Store(spark, str(tmp_path / "store"), 2)
    monkeypatch.setattr(stale, "version", lambda: 0)
    with pytest.raises(RuntimeError, match="took version"):
        stale.upsert(one)


def test_stream_indexes_once(spark, tmp_path):
    from shardlight.streaming.index import batch_states, index_stream

    docs = spark.createDataFrame([(1, "en", "s", "one line\nEnststung here"), (2, "fr", "s", "une ligne")], "doc_id long, lang string, source string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    store = src.Store(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        index_stream(stream, store, str(tmp_path / "at"), fixture.line_chunks, str(tmp_path / "status")).awaitTermination()
    assert store.read().count() == 3

    def failing(batch):
        raise ValueError("no chunks")

    index_stream(stream, store, str(tmp_path / "at2"), failing, str(tmp_path / "status2")).awaitTermination()
    assert store.read().count() == 3
    ok, failed = (batch_states(spark.read.parquet(str(tmp_path / p))).collect() for p in ("status", "status2"))
    assert {r.status for r in ok} == {"ok"} and sum(r.documents for r in ok) == 2
    assert {(r.status, r.error) for r in failed} == {("failed", "no chunks")}


def test_settings_from_the_environment():
    from shardlight.session import Settings

    got = Settings.from_environment("X_", {"X_BATCH_SIZE": "7", "X_RERANK_THRESHOLD": "0.4", "OTHER": "1"})
    assert got.batch_size == 7 and got.rerank_threshold == 0.4 and got.language == "English"
    with pytest.raises(ValueError):
        Settings.from_environment("X_", {"X_BATCH_SIZE": "many"})


def test_ordinals_over_wide_ranges(spark):
    keys = [3, 1, 1 << 40, -5, 90_000, 90_001, 17_000_000]
    got = src.numbered(spark.createDataFrame([(k,) for k in keys], "k long"), "k", width=16).collect()
    assert {r.k: r.ordinal for r in got} == {k: i for i, k in enumerate(sorted(keys))}


def test_files_are_documents(spark, tmp_path):
    (tmp_path / "x.txt").write_text("hello")
    r = src.files(spark, str(tmp_path / "x.txt")).first()
    assert r.source == "x.txt" and r.modified_at.endswith("+00:00") and bytes(r.content) == b"hello"


def test_missing_source_reads_none(spark):
    import hashlib

    r = spark.range(1).select(T.chunk_id(F.lit(None).cast("string"), F.lit(2), F.lit("c"))).first()[0]
    assert r == hashlib.sha256(b"None:2:c").hexdigest()
    assert "fr" in enrich.prompt("fr", {"keywords": "3 to 8"})


def test_strip_takes_all_white_space(spark):
    assert spark.range(1).select(T.strip(F.lit(" \n\tx y\t\n"))).first()[0] == "x y"
    assert spark.range(1).select(T.strip(F.lit(" "))).first()[0] == ""


def test_golden_files(spark, tmp_path):
    sets = spark.createDataFrame([("où est", ["a", "b"]), ("q", ["c"])], "query string, relevant_chunk_ids array<string>")
    evaluate.write_golden(sets, str(tmp_path / "g"))
    assert sorted(r.query for r in evaluate.read_golden(spark, str(tmp_path / "g")).collect()) == ["où est", "q"]
    (tmp_path / "one.json").write_text('[\n {"query": "x",\n  "relevant_chunk_ids": ["1"]}\n]')
    assert evaluate.read_golden(spark, str(tmp_path / "one.json")).collect()[0].relevant_chunk_ids == ["1"]


def test_keywords_do_not_shuffle_postings_and_are_the_same_with_few_common_terms(spark, monkeypatch):
    import math
    from collections import Counter

    from shardlight.operators import enrich

    rng = random.Random(5)
    rows = [(f"c{i}", " ".join(f"w{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(rng.randrange(25)))) for i in range(150)] + [("c7", "w1 again again"), ("none", None), ("blank", " ,. ")]
    texts: dict[str, list[str]] = {}
    for i, t in rows:
        texts.setdefault(i, []).extend((t or "").replace(",", " ").replace(".", " ").split())
    n, df = sum(bool(t) for t in texts.values()), Counter(w for t in texts.values() for w in set(t))
    want = set()
    for i, t in texts.items():
        weights = sorted((-round(c * math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)), 6), w) for w, c in Counter(t).items())
        want |= {(i, r, w, -x) for r, (x, w) in enumerate(weights[:5], 1)}
    chunks = spark.createDataFrame(rows, "id string, content string")
    for common in (1 << 18, 20, 1):
        monkeypatch.setattr(enrich, "COMMON", common)
        got = enrich.keywords(chunks)
        assert {tuple(r) for r in got.collect()} == want
    monkeypatch.setattr(enrich, "COMMON", 1 << 18)
    own = chunks.where("id <> 'c7'")
    assert "Exchange" not in enrich.keywords(own)._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_the_same_whatever_is_hashed_at_once(spark, monkeypatch):
    import hashlib

    texts = ["one two two Drei", None, "", "a " * 700 + "b", " ,", *(f"w{i} w{i % 7} x" for i in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = dict(docs.select("doc_id", enrich.hashed_vector(F.col("text"), 8)).collect())
    for i, text in enumerate(texts):
        v = [0.0] * 8
        for t in (text or "").replace(",", " ").lower().split():
            h = int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
            v[h % 8] += 1 if h // 8 % 2 == 0 else -1
        size = sum(x * x for x in v) ** 0.5
        assert got[i] == ([x / size for x in v] if size else None)
    import pyarrow as pa

    monkeypatch.setattr(enrich, "SLICE", 3)
    monkeypatch.setattr(enrich, "WORDS", 5)
    lists = pa.array([["a", "b", "a"], None, [], ["c"] * 12, ["d"]], pa.list_(pa.string()))
    small = pa.concat_arrays(list(enrich._bundled.func(iter([(lists, pa.array([8] * 5))])))).to_pylist()
    monkeypatch.setattr(enrich, "WORDS", 1 << 18)
    assert small == pa.concat_arrays(list(enrich._bundled.func(iter([(lists, pa.array([8] * 5))])))).to_pylist() and small[1] is small[2] is None


def test_chunking_takes_a_few_documents_at_a_time(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(150))], names=["id"])
    assert [b.num_rows for b in convert.few(iter([batch, batch.slice(0, 1)]))] == [64, 64, 22, 1]
    docs = spark.range(300).select("id", convert.lines_as_items(F.lit("a b\nc d")).alias("items")).coalesce(1)
    for made in (convert.chunked(docs, 2), convert.hybrid_chunks(docs, 2)):
        assert sorted(r.id for r in made.select("id").collect()) == sorted([*range(300)] * 2)


def test_dense_scores_are_in_memory_a_block_at_a_time(spark, monkeypatch):
    import numpy as np

    rows = [(i, [float((i * 7) % 11), float(i % 5)]) for i in range(200)]
    base = spark.createDataFrame(rows, "doc_id long, embedding array<double>").coalesce(1)
    asked = base.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    v = np.array([r[1] for r in rows])
    want = {(q, r, d) for q in range(0, 200, 20) for r, d in enumerate(np.lexsort((np.arange(200), -(v @ v[q])))[:5].tolist(), 1)}
    for block in ((128, 1 << 14), (3, 17)):
        monkeypatch.setattr(retrieve, "SCORES", block)
        assert {(r.query_id, r["rank"], r.doc_id) for r in retrieve.dense(base, asked, 5).collect()} == want


def test_few_seeds_go_to_the_chunks(spark):
    from unittest.mock import patch

    rows = [(f"{s}/{i}", s, i, 50) for s in "abc" for i in range(50)]
    chunks = spark.createDataFrame(rows, "id string, source string, chunk_index int, total_chunks int").repartition(3).localCheckpoint()
    seeds = spark.createDataFrame([("a/0",), ("a/1",), ("b/49",), ("b/49",), ("none",)], "id string").localCheckpoint()
    want = ["a/0", "a/1", "a/2", "b/48", "b/49"]
    near = retrieve.neighbours(chunks, seeds)
    assert ids(near) == want and "SortMergeJoin" not in near._jdf.queryExecution().executedPlan().toString()
    with patch.object(retrieve, "FEW", 1):
        assert ids(retrieve.neighbours(chunks, seeds)) == want


def test_bits_name_the_rows_that_are_kept(spark):
    from shardlight.sources import segments

    nos = [0, 63, 64, 511, 512, (1 << 44) + (3 << 20) + 700, (1 << 44) + (3 << 20) + 703]
    rows = spark.createDataFrame([(n,) for n in [*nos, *nos]], "no long")
    found = segments.bits(rows)
    assert sorted(r.no for r in segments.numbers(found).collect()) == nos
    other = spark.createDataFrame([(n + d,) for n in nos for d in (0, 1)], "no long")
    assert sorted(r.no for r in segments.kept(other, found).collect()) == sorted(n + d for n in nos for d in (0, 1) if n + d in nos)


def test_a_task_reads_one_part(spark, tmp_path):
    from shardlight.sources import segments

    spark.range(90).repartition(9).write.parquet(f"{tmp_path}/parts")
    read = lambda: spark.read.parquet(f"{tmp_path}/parts").rdd.getNumPartitions()
    with segments.one_file_a_task(spark):
        assert read() == 9
    assert read() < 9
