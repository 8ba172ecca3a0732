"""Terms by language: the rules against a slow version, and the same terms on both sides of a search."""

import re

import pytest
from pyspark.sql import functions as F

from shardlight.functions import analysis
from shardlight.operators import tools
from shardlight.plans import fixture
from shardlight.sources.segments import Index


def by_hand(text, language):
    words = re.findall(r"[^\W_]+", text.lower())
    if language not in analysis.STOP_WORDS:
        return words
    out = []
    for w in words:
        if w not in analysis.STOP_WORDS[language]:
            cut = [w[: -len(e)] for e in analysis.ENDINGS[language] if w.endswith(e) and len(w) - len(e) >= analysis.STEM]
            out.append(min(cut, key=len, default=w))
    return out


def test_terms_equal_the_slow_version(spark):
    texts = ["The indexing of INDEXES, and indexed things", "Die Wohnungen und Häuser der Freiheiten es ein", "Les maisons élevées et l'été dans des situations", "Las canciones más rápidamente olvidadas y los niños", "es us des", "", None]
    rows = [(k, t, lang) for k, t in enumerate(texts) for lang in ("en", "de", "fr", "es", "it", None)]
    got = spark.createDataFrame(rows, "k int, text string, lang string").select("text", "lang", analysis.terms(F.col("text"), F.col("lang")).alias("t")).collect()
    assert all((r.t if r.text is None else list(r.t)) == (None if r.text is None else by_hand(r.text, r.lang)) for r in got)
    assert by_hand("The indexing of INDEXES", "en") == ["index", "index"]


def test_searches_by_language(spark, tmp_path):
    docs = spark.createDataFrame([(3, "en", "s", "indexing the houses\nsinging"), (6, "de", "s", "die Häuser der Freiheiten"), (9, "fr", "s", "les maisons"), (12, None, "s", "houses")], "doc_id long, lang string, source string, text string")
    with pytest.raises(ValueError):
        Index(spark, str(tmp_path / "x"), analysis="guess")
    own = Index(spark, str(tmp_path / "i"), analysis="language")
    own.upsert(fixture.line_chunks(docs.where("doc_id < 9")))
    again = Index(spark, str(tmp_path / "i"))  # the first commit's analysis holds
    again.upsert(fixture.line_chunks(docs.where("doc_id >= 9")))
    again.upsert(fixture.line_chunks(docs.where("doc_id = 6").withColumn("text", F.lit("die Häuser der Freiheiten"))), replace_source=True)
    c = tools.Collection(spark, str(tmp_path / "i"))
    fresh = Index(spark, str(tmp_path / "f"), analysis="language")
    fresh.replace(fixture.line_chunks(docs))
    f = tools.Collection(spark, str(tmp_path / "f"))
    assert sorted(map(tuple, c.state.terms().collect())) == sorted(map(tuple, f.state.terms().collect()))
    names = {r.id: r.content for r in c.chunks.collect()}
    q = spark.createDataFrame([(1, "the house index", "en"), (2, "das Haus Freiheit", "de"), (3, "la maison", "fr"), (4, "houses", None), (5, "the of and", "en")], "query_id long, query string, lang string")
    got = {}
    for r in c.sparse(q, 5).collect():
        got.setdefault(r.query_id, set()).add(names[r.id])
    assert got == {1: {"indexing the houses"}, 2: {"die Häuser der Freiheiten"}, 3: {"les maisons"}, 4: {"houses"}}
    assert sorted(map(tuple, c.keyword_search(q).collect())) == sorted(map(tuple, f.keyword_search(q).collect()))
