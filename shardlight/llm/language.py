"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) the vectors of its letters,
permuted (rotated) by place; a document's vector bundles (adds) those of its n-grams, a language's prototype the
normalised vectors of its learning documents. A document gets the language whose prototype, less the mean of all
prototypes, has the largest cosine with it.

Prototypes are learned from at most ``per_lang`` hash-chosen labelled documents of each language. Null text, and
text without letters, is ``und`` with score 0; so is everything where no document has a language. Ties go to the
language that sorts first; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 1024
#: Characters that are bundled at once.
CHUNK = 1_000_000
_STATE: dict = {}


def letters() -> np.ndarray:
    if "letters" not in _STATE:
        _STATE["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _STATE["letters"]


def letter_vector(cp: int, dim: int) -> np.ndarray:
    known = _STATE.setdefault(("vectors", dim), {})
    if cp not in known:
        known[cp] = (np.random.default_rng(cp).integers(0, 2, dim, np.int8) * 2 - 1).astype(np.int8)
    return known[cp]


def bundle(texts: list[str], dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Bundles of the letter trigrams of each text, and whether it has letters. Words are joined by one blank."""
    joined = "".join("\0" + t.replace("\0", " ") + " " for t in texts).lower()
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    head = cp == 0
    is_letter = letters()[cp]
    keep = is_letter | head
    keep[1:] |= is_letter[:-1]
    doc = (np.cumsum(head) - 1)[keep]
    code = np.where(is_letter, cp, 32)[keep]
    has = np.bincount((np.cumsum(head) - 1)[is_letter], minlength=len(texts)) > 0
    if len(code) < 3:
        return np.zeros((len(texts), dim), np.float32), has
    seen = np.zeros(0x110000, bool)
    seen[code] = True
    alphabet = np.flatnonzero(seen)
    dense = np.zeros(0x110000, np.int64)
    dense[alphabet] = np.arange(len(alphabet))
    k, c = len(alphabet), dense[code]
    grams = ((c[:-2] * k + c[1:-1]) * k + c[2:])[doc[:-2] == doc[2:]]
    owner = doc[:-2][doc[:-2] == doc[2:]]
    if k**3 <= 1 << 22:
        mark = np.zeros(k**3, bool)
        mark[grams] = True
        kinds = np.flatnonzero(mark)
        place = np.zeros(k**3, np.int64)
        place[kinds] = np.arange(len(kinds))
        column = place[grams]
    else:
        kinds, column = np.unique(grams, return_inverse=True)
    vectors = np.stack([letter_vector(int(x), dim) for x in alphabet])
    turned = [np.roll(vectors, 2, 1), np.roll(vectors, 1, 1), vectors]
    out = np.zeros((len(texts), dim), np.float32)
    for at in range(0, len(kinds), 16384):  # bounded memory for alphabets of many letters
        part = kinds[at : at + 16384]
        bound = (turned[0][part // (k * k)] * turned[1][part // k % k] * turned[2][part % k]).astype(np.float32)
        own = (column >= at) & (column < at + len(part)) if len(kinds) > 16384 else slice(None)
        counts = np.bincount(owner[own] * len(part) + column[own] - at, minlength=len(texts) * len(part))
        out += counts.reshape(len(texts), len(part)).astype(np.float32) @ bound
    return out, has


def bundles(texts: list[str | None], dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """bundle() in chunks of bounded size; a longer text is the sum of its parts, which share two characters."""
    out, has = np.zeros((len(texts), dim), np.float32), np.zeros(len(texts), bool)
    part, owner, size = [], [], 0

    def flush() -> None:
        nonlocal part, owner, size
        if part:
            v, h = bundle(part, dim)
            np.add.at(out, owner, v)
            np.logical_or.at(has, owner, h)
        part, owner, size = [], [], 0

    for i, text in enumerate(texts):
        text = text or ""
        for at in range(0, max(1, len(text)), CHUNK):
            piece = text[max(0, at - 2) : at + CHUNK]
            part.append(piece)
            owner.append(i)
            size += len(piece)
            if size >= CHUNK or len(part) >= 1024:
                flush()
    flush()
    return out, has


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-9)


def learn(docs: DataFrame, per_lang: int = 2000, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Prototypes from labelled rows (text and lang not null): per_lang of each language at most, chosen by hash."""
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = labelled.groupBy("lang").count()
    share = counts.select("lang", F.least(F.lit(1.0), per_lang / F.col("count")).alias("share"))
    sample = labelled.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            v, has = bundles(batch.column(0).to_pylist(), dim)
            v = unit(v)
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in set(langs[has]):
                total[lang] = total.get(lang, 0) + v[has & (langs == lang)].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.astype("<f4").tobytes() for v in total.values()], pa.binary())], names=["lang", "sum"])

    sums: dict[str, np.ndarray] = {}
    for r in sample.select("text", "lang").repartition(12).mapInArrow(add, "lang string, sum binary").collect():
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.frombuffer(r["sum"], "<f4")
    names = sorted(sums)
    return names, unit(np.stack([sums[n] for n in names])) if names else np.zeros((0, dim), np.float32)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray, dim: int = DIM) -> DataFrame:
    """One row per document: doc_id, held_out as docs have it, lang_pred, score (softmax of scaled cosines)."""
    mean = prototypes.mean(0) if len(names) > 1 else np.zeros(dim, np.float32)
    model = docs.sparkSession.sparkContext.broadcast((names, mean, unit(prototypes - mean)))

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, mean, profiles = model.value
        for batch in batches:
            v, has = bundles(batch.column(2).to_pylist(), dim)
            lang, score = np.full(len(v), "und", object), np.zeros(len(v))
            if names and has.any():
                cosine = unit(unit(v[has]) - mean) @ profiles.T
                p = np.exp(20.0 * (cosine - cosine.max(1, keepdims=True)).astype(float))
                best = cosine.argmax(1)
                lang[has] = np.array(names, object)[best]
                score[has] = (p / p.sum(1, keepdims=True))[np.arange(len(best)), best]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(say, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, per_lang: int = 2000) -> DataFrame:
    """Learn from documents whose crc32(doc_id) mod 3 is not 1 and predict all."""
    fold = docs.select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))
    names, prototypes = learn(fold.where(~F.col("held_out")), per_lang)
    return predict(fold, names, prototypes)
