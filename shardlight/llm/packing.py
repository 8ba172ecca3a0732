"""Best-fit packing: a configuration linear program over the length histogram.

The corpus enters the program only as counts of piece lengths, at most ``seq_len`` numbers. Multiplicative
weights solve the covering program min sum(x_c), sum(a_cl x_c) >= n_l; each step prices configurations with a
knapsack dynamic program. Its full configurations are rounded to whole sequences, and what is left over is placed
by best fit, still on counts; of plans that take more or less of the program the best is kept. Pieces then find their place by their rank among
pieces of their length: arithmetic on intervals of ranks, with no group of pieces in one task.

Null text is empty (one end id); an empty table gives an empty table; repeated rows are packed each.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import docs_of, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words, and parts of words, whose ids a worker keeps; later unknown ones are encoded each time.
CACHE = 700_000
#: Documents that are encoded together; what is made of their words is dropped after them.
SLICE = 4000
#: Texts whose ids are gathered at once; the places of ids take eight bytes each.
GATHER = 256
_WORKER: dict = {}


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _WORKER:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        special = [a.content for a in t.get_added_tokens_decoder().values()]
        blank = np.zeros(t.get_vocab_size(), bool)
        blank[[i for piece, i in t.get_vocab().items() if piece.startswith("\u0120")]] = True
        added = re.compile("|".join(map(re.escape, special)) or r"(?!)").search
        _WORKER[path] = (t, blank, {}, {}, added)
    return _WORKER[path]


def encode_words(t, blank: np.ndarray, words: list[str]) -> list[bytes]:
    """Ids of each word with a blank before it: one run over all, cut where a piece starts with the blank."""
    ids = np.asarray(t.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, "<u4")
    starts = np.flatnonzero(blank[ids])
    if len(starts) != len(words) or len(ids) and starts[0]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in t.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
    raw, cuts = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def encode_ids(texts: list[str], path: str) -> list[bytes]:
    """Little-endian uint32 ids of each text, without the end id.

    The vocabulary's pre-tokens start at a single space before a word, at a single line end and at marks after a
    letter or digit. So a text without adjacent white space and without special tokens is the concatenation of the ids of its space-led
    words, and those of the ids of their parts; other texts are encoded whole. Arrow names the words by number, so each
    different one is looked up once and the ids of many texts are gathered at once.
    """
    t, _, _, _, added = tokenizer(path)
    out: list[bytes | None] = [None] * len(texts)
    plain = []
    for i, text in enumerate(texts):
        if not text:
            out[i] = b""
        elif _SPACES(text) is None and added(text) is None:
            plain.append(i)
        else:
            out[i] = np.asarray(t.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()
    if not plain:
        return out
    lists = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
    coded = lists.values.dictionary_encode()
    words, index, offsets = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().copy(), lists.offsets.to_numpy()
    # No blank leads the first word of a text: it has ids of its own, after those of the others.
    heads, own = np.unique(index[offsets[:-1]], return_inverse=True)
    index[offsets[:-1]] = len(words) + own
    ids = word_ids(words, [words[k] for k in heads], path)
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat, begin = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
    for k in range(0, len(plain), GATHER):
        cuts = offsets[k : k + GATHER + 1]
        some = index[cuts[0] : cuts[-1]]
        n = size[some]
        stop = np.cumsum(n)
        raw = flat[np.repeat(begin[some] - (stop - n), n) + np.arange(stop[-1])].tobytes()
        ends = [0, *(4 * stop[cuts[1:] - cuts[0] - 1]).tolist()]
        for i, a, b in zip(plain[k:], ends, ends[1:]):
            out[i] = raw[a:b]
    return out


def word_ids(words: list[str], heads: list[str], path: str) -> list[bytes]:
    """Ids of each word with a blank before it, and then those of each head without one. A worker keeps the ids of
    words and of parts; those that it has no room for are looked up beside them, for this call only."""
    t, blank, led, bare, _ = tokenizer(path)
    out = list(map(led.get, words))
    missing = [k for k, ids in enumerate(out) if ids is None]
    parts = {k: (w,) if (w := words[k])[-1:].isalnum() and "\n" not in w else _parts(w) for k in missing}
    first = [_parts(w) for w in heads]
    stems = [w for w in {p[0] for p in parts.values()} if w not in led]
    rest = [w for w in {x for p in parts.values() for x in p[1:]}.union(*first) if w not in bare]
    led_ids, bare_ids = [], []
    for k in range(0, len(stems), 512):
        led_ids += encode_words(t, blank, stems[k : k + 512])
    for k in range(0, len(rest), 4096):
        bare_ids += [np.asarray(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(rest[k : k + 4096], add_special_tokens=False)]
    new_led, new_bare = dict(zip(stems, led_ids)), dict(zip(rest, bare_ids))
    of = lambda new, known, w: new[w] if w in new else known[w]
    for k, p in parts.items():
        out[k] = new_led[p[0]] if len(p) == 1 else of(new_led, led, p[0]) + b"".join([of(new_bare, bare, x) for x in p[1:]])
    out += [b"".join([of(new_bare, bare, x) for x in p]) for p in first]
    led.update((words[k], out[k]) for k in missing[: max(0, CACHE - len(led))])
    bare.update(itertools.islice(new_bare.items(), max(0, CACHE - len(bare))))
    return out


def _parts(word: str) -> tuple[str, ...]:
    """Cut a word where pre-tokens always end: at line ends, and before marks that follow a letter or digit."""
    if "\n" in word:
        out: list[str] = []
        for k, line in enumerate(word.split("\n")):
            if k:
                out.append("\n")
            if line or not k:
                out += _parts(line)
        return tuple(out)
    stem = word.rstrip(_MARKS)
    return (stem, word[len(stem) :]) if len(stem) < len(word) and stem and stem[-1].isalnum() else (word,)


_MARKS = ".,;:!?*#$%&|-()[]{}\"/\\+=<>@^_~`"
_SPACES = re.compile(r"\s\s").search


def pieces_of(docs: DataFrame, path: str, seq_len: int = 2048, end_id: int = 0) -> DataFrame:
    """Cut documents longer than seq_len, the first piece taking what is over; ids stay in the task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_ids(batch.column(1).to_pylist(), path)):
                ids += end
                n = len(ids) // 4
                at = 0
                stops = range(n % seq_len or seq_len, n + 1, seq_len)
                for k, stop in enumerate(stops):
                    rows.append((doc_id, k, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop])))
                    at = stop
            cols = list(zip(*rows)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return docs_of(docs).mapInArrow(cut, PIECES)


def priced(value: np.ndarray, lengths: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value for each capacity and the item taken last there (-1: one unit unused)."""
    best, last = np.zeros(cap + 1), np.full(cap + 1, -1)
    for c in range(int(lengths[0]), cap + 1):
        k = np.searchsorted(lengths, c, "right")
        total = best[c - lengths[:k]] + value[:k]
        j = int(total.argmax())
        best[c] = best[c - 1]
        if total[j] > best[c]:
            best[c], last[c] = total[j], j
    return best, last


def solve(lengths: np.ndarray, counts: np.ndarray, cap: int, rounds: int = 60, columns: int = 24, step: float = 0.5, eta: float = 4.0) -> dict[tuple, float]:
    """Multiplicative weights on the covering program; configuration -> how often. A configuration: (item, copies) pairs.

    An item's price is its length, times a weight that falls with the share of its pieces that is covered; a round
    prices once and takes the best configurations that hold each of the least covered items.
    """
    covered = np.zeros(len(lengths))
    x: dict[tuple, float] = {}
    for _ in range(rounds):
        if covered.min() >= 1:
            break
        value = lengths * np.exp(-eta * (covered - covered.mean())) * (covered < 1.5)
        _, last = priced(value, lengths, cap)
        for seed in np.argsort(covered, kind="stable")[:columns]:
            c, config = cap - int(lengths[seed]), {int(seed): 1}
            while c > 0:
                j = int(last[c])
                if j < 0:
                    c -= 1
                    continue
                if config.get(j, 0) >= counts[j]:
                    break
                config[j] = config.get(j, 0) + 1
                c -= int(lengths[j])
            take = step * min(counts[j] / a for j, a in config.items())
            for j, a in config.items():
                covered[j] += take * a / counts[j]
            key = tuple(sorted(config.items()))
            x[key] = x.get(key, 0.0) + take
    return x


def rounded(histogram: dict[int, int], cap: int, full: bool = True, dives: int = 4) -> list[tuple[int, list[tuple[int, int]]]]:
    """Whole sequences from the program: its configurations, most used first, as often as it says or the pieces allow;
    then the same on the pieces that are left. If full, only those without room count, and half of the pieces under an
    eighth of cap stay out, as what is not full needs them."""
    left = {n: k if 8 * n >= cap or not full else k // 2 for n, k in histogram.items()}
    groups: list[tuple[int, list[tuple[int, int]]]] = []
    for _ in range(dives):
        lengths = np.array(sorted(n for n, k in left.items() if k > 0), np.int64)
        if not len(lengths):
            break
        x = solve(lengths, np.array([left[int(n)] for n in lengths], float), cap)
        for config, v in sorted(x.items(), key=lambda kv: (-kv[1], kv[0])):
            items = [(int(lengths[j]), a) for j, a in config]
            take = min(int(np.ceil(v)), *(left[n] // a for n, a in items))
            if take > 0 and (not full or sum(n * a for n, a in items) == cap):
                for n, a in items:
                    left[n] -= take * a
                groups.append((take, items))
    # The fullest first: a plan that takes a part of them leaves the rest to best fit.
    return groups if full else sorted(groups, key=lambda g: sum(n * a for n, a in g[1]), reverse=True)


def fitted(left: dict[int, int], groups: list[tuple[int, list[tuple[int, int]]]], cap: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """groups and, by best fit of the longest first, sequences for what is left."""
    open_: dict[int, list[tuple[int, list]]] = {}
    spaces: list[int] = []

    def put(space: int, group: tuple[int, list]) -> None:
        if space not in open_:
            open_[space] = []
            bisect.insort(spaces, space)
        open_[space].append(group)

    for length in sorted((n for n, k in left.items() if k), reverse=True):
        k = left[length]
        while k:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):
                per = cap // length
                if k >= per:
                    put(cap - per * length, (k // per, [(length, per)]))
                if k % per:
                    put(cap - k % per * length, (1, [(length, k % per)]))
                break
            space = spaces[at]
            many, items = open_[space].pop()
            if not open_[space]:
                spaces.pop(at)
                del open_[space]
            take = min(k, many)
            if many > take:
                put(space, (many - take, items))
            put(space - length, (take, [*items, (length, 1)]))
            k -= take
    return groups + [g for s in sorted(open_) for g in open_[s]]


#: Shares of the program's sequences that a plan may take; the last is best fit alone.
SHARES = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0)


def plan(histogram: dict[int, int], cap: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal sequences: (how many, [(length, copies), ...]). Every piece of the histogram has a place.

    Of the plans that take more or less of the program, rounded to all its configurations or to full ones, the first of
    the fewest sequences, so that none is worse than best fit alone.
    """
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    whole = [(left.pop(cap), [(cap, 1)])] if left.get(cap) else []
    if not left:
        return whole
    best, fewest = None, 0
    bound = -(-sum(n * k for n, k in left.items()) // cap)
    for full in (True, False):
        program = rounded(left, cap, full)
        total = sum(many for many, _ in program)
        for share in SHARES:
            own, rest, room = [], dict(left), int(np.ceil(share * total))
            for many, items in program:
                take = min(many, room)
                if take:
                    own.append((take, items))
                    room -= take
                    for n, a in items:
                        rest[n] -= take * a
            tried = fitted(rest, own, cap)
            size = sum(many for many, _ in tried)
            if best is None or size < fewest:
                best, fewest = tried, size
            if fewest == bound:
                return whole + best
    return whole + best


def places(groups: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, ...]:
    """Intervals of ranks: key (length and first rank), first rank, copies, first sequence, offset; sorted by key."""
    rows, rank, sequence = [], {}, 0
    for many, items in groups:
        offset = 0
        for length, copies in items:
            first = rank.get(length, 0)
            rows.append(((length << 44) + first, first, copies, sequence, offset))
            rank[length] = first + many * copies
            offset += length * copies
        sequence += many
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows))) if rows else tuple(np.zeros(0, np.int64) for _ in range(5))


def ranked(pieces: DataFrame, histogram: dict[int, int], seq_len: int) -> DataFrame:
    """Number the pieces of each length from 0. Lengths are split into salts of a few hundred rows, so that a
    length that a third of all rows share is as even as the others; counts of salts give each salt its first rank."""
    total = sum(histogram.values())
    target = max(256, total >> 20)
    salts = ",".join(str(max(1, -(-histogram.get(n, 0) // target))) for n in range(1, seq_len + 1))
    salted = pieces.withColumn("salt", F.expr(f"pmod(xxhash64(doc_id, piece, ids_crc32, start), element_at(array({salts}), cast(length as int)))"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    return salted.withColumn("rank", F.row_number().over(own) - 1).join(first, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("first")).drop("salt", "first")


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece with its sequence_id and offset; sequences hold at most seq_len ids, gapless from 0."""
    spark = docs.sparkSession
    pieces = written(pieces_of(docs, tokenizer_path, seq_len, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = spark.sparkContext.broadcast(places(plan(histogram, seq_len)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, copies, sequence, offset = where.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            i = np.searchsorted(key, (length << 44) + rank, "right") - 1
            over = rank - first[i]
            got = {"sequence_id": sequence[i] + over // copies[i], "offset": offset[i] + over % copies[i] * length}
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(v, pa.int64()) for v in got.values())], names=["doc_id", "piece", "start", "length", "ids_crc32", *got])

    at = ranked(pieces, histogram, seq_len).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    return at.mapInArrow(place, PIECES + ", sequence_id long, offset long")
