"""The pipeline on a small table, stage by stage against brute force."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_operators import brute_components, brute_hits, brute_lines
from tokenizers import Tokenizer

from shardlight.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls int"


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(21)
    word = lambda k: f"w{k}"
    texts = [" ".join(word(x) for x in rng.integers(0, 400, 60)) + "." for _ in range(40)]
    texts += [t + " and a little more" for t in texts[:6]] + [texts[1], texts[2]]
    texts = [t if i % 3 else t + "\n" + texts[5][:90] + "\nshort line here now" for i, t in enumerate(texts)]
    bad = ["*** BUY NOW !!! " * 12 + word(i).upper() for i in range(20)]
    docs = [(i, t, "en", "s", len(t), 1) for i, t in enumerate(texts)] + [(100 + i, t, "en", None, len(t), None) for i, t in enumerate(bad)]
    docs += [docs[4], (200, None, None, None, None, None), (201, "", "en", "s", 0, 1), (None, "a row that has no id at all", None, None, None, None)]
    items = [(1, " ".join(texts[9].split()[4:16])), (2, None)]
    d = str(tmp_path)
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    marks = [(i, 1) for i in range(len(texts))] + [(100 + i, 0) for i in range(20)]
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    frame, stage = spark.read.parquet(f"{d}/documents.parquet"), dict(corpus_pipeline.STAGES)

    def step(name, before):
        stage[name](spark, before, d).write.parquet(f"{d}/{name}")
        return spark.read.parquet(f"{d}/{name}")

    one = step("quality_classifier", frame)
    good = quality.classify(frame, spark.read.parquet(f"{d}/labels.parquet")).where("predicted = 1").select("doc_id")
    assert Counter(r.doc_id for r in one.collect()) == Counter(r.doc_id for r in good.collect()) and one.columns == frame.columns
    two = step("line_dedup", one)
    had = rows(one)
    want = []
    for (i, x), gone in zip(had, brute_lines(had)):
        left = None if x is None else "\n".join(s for k, s in enumerate(x.split("\n")) if k not in gone)
        if not gone or left.strip():
            want.append((i, left))
    assert rows(two) == sorted(want, key=repr) and two.where("n_chars <> length(text)").count() == 0
    three = step("ngram_jaccard_join", two)
    had = [r for r in rows(two) if r[0] is not None and (r[1] or "").strip()]
    assert sorted(r[0] for r in rows(three) if r[0] is not None and (r[1] or "").strip()) == sorted({i for i, _, c in brute_components(had, 5, 80) if i == c})
    four = step("benchmark_decontamination", three)
    assert rows(four) == [r for r in rows(three) if not brute_hits(r[1], items)[4]] and four.columns == frame.columns
    five = stage["best_fit_packing"](spark, four, d)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
    assert Counter((r.doc_id, r.ids_crc32) for r in five.collect()) == Counter((i, zlib.crc32(ids(x))) for i, x in rows(four))
    pieces = ["doc_id", "piece", "length", "ids_crc32"]
    assert Counter(map(tuple, corpus_pipeline.run(spark, d).select(pieces).collect())) == Counter(map(tuple, five.select(pieces).collect()))


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    assert corpus_pipeline.run(spark, d).select(F.count("*")).first()[0] == 0
