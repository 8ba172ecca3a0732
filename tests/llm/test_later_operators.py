"""Hard negatives, passages and vector codes against brute force, and their defined results on odd and empty tables."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shardlight.llm import automata, codes, lines, negatives, packing, topk

VECTORS = "vec_id long, embedding array<double>, label int, ints int, square string, bucket int, copy int, n int, code string, _label int"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 2, 3, 4, "c", 5) for r in rows], VECTORS).repartition(3)


@pytest.fixture(scope="module")
def vectors(spark):
    """Ties, zeros, repeated rows, repeated ids, short vectors, nulls, huge and non-finite components, null labels."""
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=6).tolist(), int(r.integers(0, 3))) for i in range(120)]
    rows += [(200 + i, [0.5, 0.25, -0.5, 0.0, 0.125, 1.0], i % 2) for i in range(8)]
    rows += [(300, [0.0] * 6, 1), (300, [0.0] * 6, 1), (300, [1.0] * 6, 0), (303, [1.0, 2.0], 2), (304, [], 1), (305, None, 1), (306, [1.0, None], 1), (307, [float("nan")] * 6, 1), (308, [float("inf")] * 6, 0), (309, [1e300, 1.0], 1), (310, [3.0] * 6, None), (None, [0.1] * 6, 1)]
    rows += [rows[5], rows[100], rows[100]]
    return rows


def whole(rows, scale, keyed=True):
    out = []
    for v, e, label in rows:
        if e is None or any(x is None or not np.isfinite(x) for x in e) or (keyed and v is None):
            continue
        ints = [int(np.floor(x * scale)) for x in e]
        if sum(float(x) * float(x) for x in ints) <= 2.0**56:
            out.append((v, ints + [0] * (6 - len(ints)), label))
    return out


def hard_negatives(rows, every=20, low=30, high=90):
    base = [(v, np.array(m), (label + 1) % 10 if v % 7 == 0 else label) for v, m, label in whole(rows, 256) if label is not None]
    asked = {(v, label, tuple(m.tolist())): (v, m, label) for v, m, label in base if v % every == 0}
    out = []
    for v, m, label in asked.values():
        scored = sorted(((-int(m @ x), w, y) for w, x, y in base if w != v))
        for s, w, _ in [x for x in scored if x[2] == label][:5]:
            fine = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= high * -s]
            out += [(v, w, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fine[:10])]
    return sorted(out)


@pytest.mark.parametrize("rows_of_block", [8192, 16])
def test_hard_negatives_equal_brute_force(spark, vectors, monkeypatch, rows_of_block):
    monkeypatch.setattr(negatives, "ROWS", rows_of_block)
    monkeypatch.setattr(negatives, "PASS", 20 if rows_of_block == 16 else 1 << 20)
    e = rows_of(spark, vectors)
    got = negatives.mine(e, every=20, label=negatives.noisy(e))
    assert sorted(tuple(r) for r in got.collect()) == hard_negatives(vectors)


def test_coordinate_ranges_lose_no_row():
    r = np.random.default_rng(1)
    m = r.integers(-300, 300, (500, 8)).astype(np.int64)
    unit = negatives.directions(m)
    orders = np.argsort(unit, axis=0, kind="stable").T.astype(np.uint16)
    block = negatives.Block.of({"n": 500, "dims": 8, "ids": np.arange(500).tobytes(), "labels": np.zeros(500, np.int64).tobytes(), "ints": m.tobytes(), "orders": orders.tobytes()})
    cut = 0
    for a in r.integers(-300, 300, (40, 8)).astype(np.int64):
        d, length = negatives.directions(a[None, :])[0], float(np.sqrt((a * a).sum()))
        focus = np.argsort(-np.abs(d))[: negatives.FOCUS]
        for reach in np.quantile(m @ a, [0.5, 0.9, 0.99, 1.0]).astype(int):
            found = block.candidates(d, length, focus, int(reach))
            assert set(np.flatnonzero(m @ a >= reach)) <= set(found)
            cut += 500 - len(found)
    assert cut > 1000


def test_hard_negatives_of_nothing(spark):
    assert negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert negatives.mine(rows_of(spark, [(0, None, 1), (100, [1.0], None)])).count() == 0


# Vector codes


def product_codes(rows, entries, parts, rounds, scale):
    kept = sorted(whole(rows, scale, False), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([m for _, m, _ in kept], np.int64).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        apart = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        code = apart.argmin(2)
        if k < rounds:
            for p in range(parts):
                for j in set(code[:, p].tolist()):
                    own = x[code[:, p] == j, p]
                    books[p, j] = own.sum(0) // len(own)
    error = apart.min(2).sum(1)
    by_label = Counter()
    for (_, _, label), e in zip(kept, error):
        by_label[label] += int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted(map(repr, ((v, "".join(f"{c:02x}" for c in code[i]), int(error[i]), by_label[label], digest) for i, (v, _, label) in enumerate(kept))))


@pytest.mark.parametrize(("entries", "rounds"), [(256, 4), (12, 4), (12, 9), (1, 2)])
def test_codes_equal_a_full_search(spark, vectors, entries, rounds):
    got = codes.compress(rows_of(spark, vectors), entries, 3, rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == product_codes(vectors, entries, 3, rounds, 1024)


def test_balls_leave_out_most_pairs_and_lose_none():
    r = np.random.default_rng(2)
    x = (r.normal(size=(4000, 4)) * 50 + r.integers(0, 20, (4000, 1)) * 400).astype(np.int64)
    c = x[:64].copy()
    code = codes.nearest_of_all(x, c)
    for _ in range(4):
        before = c.copy()
        for j in set(code.tolist()):
            c[j] = x[code == j].sum(0) // (code == j).sum()
        (order, apart), = codes.Books(c[None]).prepared()
        got = codes.nearest_in_balls(x, c, code, (c != before).any(1), order, apart)
        assert (got == codes.nearest_of_all(x, c)).all()
        code = got
    assert (apart[code] <= 4 * ((x - c[code]) ** 2).sum(1)[:, None]).sum() < 0.3 * 64 * 4000


def test_codes_of_nothing(spark):
    assert codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert codes.compress(rows_of(spark, [(0, None, 1), (1, [None], None)])).count() == 0
    assert [r.code for r in codes.compress(rows_of(spark, [(0, [], 1), (1, [], None)])).collect()] == ["00000000"] * 2


# Passages


def passages(rows, window):
    first = {}
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in texts:
        for k in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[k : k + window])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            if d is not None and first[tuple(w[k : k + window])] < d:
                gone |= set(range(k, k + window))
        kept = b" ".join(w[k] for k in range(len(w)) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def copied():
    r = random.Random(11)
    word = lambda: r.choice(["la", "le", "lo", "lu", "ré", "ka"])
    base = [word() for _ in range(400)]
    rows = [(k, " ".join(base[a : a + r.randint(5, 120)])) for k, a in enumerate(r.choices(range(300), k=60))]
    for k in range(60, 90):
        own = list(base)
        for _ in range(r.randint(0, 4)):
            own[r.randrange(len(own))] = "edited"
        rows.append((k, (" \n" if k % 2 else "  ").join(own)))
    rows += [(90, "same " * 90), (91, "same " * 120 + "end"), (91, "other text " + " ".join(base[:70])), (92, rows[3][1]), (92, rows[3][1]), (None, " ".join(base)), (93, None), (94, ""), (95, " \t\n"), (96, "word")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("window", "many"), [(50, 256), (7, 256), (7, 2)])
def test_passages_equal_brute_force(spark, copied, monkeypatch, window, many):
    monkeypatch.setattr(automata, "RUNS", many)
    docs = spark.createDataFrame([(d, t, 1, "x", 2, 3) for d, t in copied], "doc_id long, text string, doc int, digest string, part int, n_words int").repartition(4)
    got = automata.remove(docs, window)
    assert sorted(repr(tuple(r)) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text").collect()) == passages(copied, window)


def test_passages_of_odd_rows_and_of_nothing(odd, none):
    got = automata.remove(odd, keep_text=False)
    want = [eval(r)[:4] for r in passages([(r.doc_id, r.text) for r in odd.collect()], 50)]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, want))
    assert automata.remove(none).count() == 0


def test_automaton_matches_the_longest_runs():
    r = random.Random(7)
    for _ in range(200):
        taken = [[r.randint(0, 2) for _ in range(r.randint(0, 12))] for _ in range(r.randint(1, 4))]
        a = automata.Automaton()
        for t in taken:
            a.add(t)
        held = {tuple(t[i:j]) for t in taken for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        asked = [r.randint(0, 3) for _ in range(20)]
        want = [max((n for n in range(1, k + 2) if tuple(asked[k + 1 - n : k + 1]) in held), default=0) for k in range(20)]
        assert a.matched(asked) == want


def test_anchors_are_those_of_brute_force():
    words = np.random.default_rng(4).integers(0, 1 << 60, 300).astype(np.uint64)
    for n in (2, 7, 50):
        each = automata.of_runs(words, n // 2, automata._ODD[0])
        assert automata.anchors(words, n).tolist() == [min(each[k : k + n - n // 2 + 1].tolist()) for k in range(300 - n + 1)]
    seen = defaultdict(set)
    for k, h in enumerate(automata.of_runs(np.r_[words, words], 50, automata._ODD[1]).tolist()):
        seen[h].add(k % 300)
    assert all(len(v) == 1 for v in seen.values())


# Earlier operators


def test_packing_rounds_configurations_that_are_not_full():
    fewest = lambda h: sum(m for m, _ in packing.plan(h, 2048))
    alone = lambda h: sum(m for m, _ in packing.fitted(dict(h), [], 2048))
    h = {1040: 600, 550: 600, 530: 600, 470: 1200}
    assert fewest(h) == 900 < alone(h)
    assert fewest({900: 500, 600: 500, 540: 500}) == 500
    lengths = np.random.default_rng(2).choice([1040, 550, 530, 470, 333, 700], 3000)
    h = {int(k): int(v) for k, v in Counter(lengths.tolist()).items()}
    groups = packing.plan(h, 2048)
    placed = Counter()
    for many, items in groups:
        assert sum(n * a for n, a in items) <= 2048
        for n, a in items:
            placed[n] += many * a
    assert placed == h and sum(m for m, _ in groups) < 0.95 * alone(h)


def test_topk_of_large_components(spark):
    rows = [(0, [1e300, 1.0]), (50, [2.0**21, -1.0]), (100, [-(2.0**21), 3.0]), (1, [2.0**20, 0.5]), (2, [1.0, 2.0]), (3, [3.0e38, 0.0]), (4, [-5.0, 1e9])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    ints = {v: [int(np.floor(256 * x)) for x in e] for v, e in rows}
    ints = {v: e for v, e in ints.items() if sum(x * x for x in e) <= 2**62}
    assert set(ints) == {50, 100, 1, 2}
    want = []
    for q in (50, 100):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], e)), v) for v, e in ints.items() if v != q)
        want += [(q, k + 1, v, -s) for k, (s, v) in enumerate(scored)]
    assert sorted(tuple(r) for r in got) == sorted(want)


@pytest.mark.parametrize("room", [0, 3, 500_000])
def test_packing_looks_a_word_up_once(monkeypatch, room):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [f"start{i % 3} these words, those words.\nnext a{i} it's " for i in range(40)] + [" led", "", "two  blanks", "<|endoftext|> x"]
    cut = []
    monkeypatch.setattr(packing, "_parts", lambda w, parts=packing._parts: cut.append(w) or parts(w))
    monkeypatch.setattr(packing, "CACHE", room)
    monkeypatch.setattr(packing, "_WORKER", {})
    t = packing.tokenizer(path)[0]
    for _ in range(2):
        cut.clear()
        got = packing.encode_ids(texts, path)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert all(len(kept) <= room for kept in packing._WORKER[path][2:4])
    if room > 3:  # the second time, only first words are cut into parts
        assert len(cut) < 10


def test_lines_meet_by_indexed_words(spark):
    """The shorter prefix of the smaller set is enough: every similar pair is met, later class first, by fewer postings."""
    r = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(25):
        base = r.sample(words, r.choice([4, 9, 30, 70, 120]))
        for _ in range(4):
            texts.append(" ".join(w for w in base if r.random() > 0.06) + "".join(f" {w}" for w in r.sample(words, r.choice([0, 1, 3]))))
    docs = lines.placed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    own = lines.lines_of(docs, lines.rarity(docs), 80, 1).withColumn("shut", F.col("doc") % 7 == 0).cache()
    own = own.join(own.groupBy("cls").agg(F.min("doc").alias("doc")), ["cls", "doc"]).cache()
    sets = {i: frozenset(texts[i].split()) for i in (x.doc for x in own.collect())}
    want = {(x, y) for x in sets for y in sets if y < x and x % 7 and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])}
    got = {(p.doc_x, p.doc_y) for p in lines.sifted(own, 80).collect()}
    assert len(want) > 40 and want <= got and all(y < x and x % 7 for x, y in got)
    assert lines.posted(own, 80, only_indexed=True).count() < 0.7 * lines.posted(own, 80).count()


def test_lines_send_only_what_may_match(spark):
    """Documents that lose nothing stay where they are, a word is sent as 32 bits, and a tag only if a doc_id repeats."""
    r = random.Random(4)
    texts = {i: "\n".join(" ".join(f"w{r.randrange(5000)}" for _ in range(12)) for _ in range(3)) for i in range(300)}
    texts |= {i: texts[i - 300] for i in range(300, 310)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {x.tag for x in docs.select(lines.tag_of(docs).alias("tag")).collect()} == {0}
    twice = docs.unionByName(docs.where("doc_id = 7"))
    assert {x.tag for x in twice.select(lines.tag_of(twice).alias("tag")).collect()} != {0}
    wanted = spark.createDataFrame([(i,) for i in range(300, 310)], "doc_id long")
    marked = {x.doc_id: x.maybe for x in lines.maybe(docs, ["doc_id"], wanted).collect()}
    assert len(marked) == 310 and all(marked[i] for i in range(300, 310)) and sum(marked.values()) < 15
    own = lines.lines_of(lines.placed(docs), lines.rarity(docs), 80, 1).withColumn("shut", F.lit(False))
    assert lines.posted(own, 80).agg(F.max("token").alias("t"), F.min("token").alias("u")).where(f"t < {1 << 32} and u >= 0").count() == 1
    assert sorted(map(tuple, lines.report(docs).select("doc_id", "n_removed").collect())) == [(i, 3 * (i >= 300)) for i in range(310)]
    assert sorted(map(tuple, lines.report(twice).where("n_removed > 0").select("doc_id").collect())) == [(7,), *((i,) for i in range(300, 310))]


def test_ids_gathered_in_blocks(monkeypatch):
    """Ids of few texts are gathered at once, as their places take much memory; they are those of the tokenizer."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [f"Word {k}, and others (of {k * k}) é" + "\n- line" * (k % 3) for k in range(11)] + ["", "x  y", "one"]
    monkeypatch.setattr(packing, "GATHER", 3)
    t = packing.tokenizer(path)[0]
    assert packing.encode_ids(texts, path) == [np.asarray(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
