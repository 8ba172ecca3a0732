"""Line dedup: an exact set-similarity join of lines.

A line is the set of its lower-cased words; a later line goes if an earlier one, in the order of (doc_id, line
number) over the whole table, has a Jaccard index of at least the threshold with it. Words are 64-bit hashes led
by their rarity, so that a sorted set begins with its rarest words. Two similar sets share a word of their prefixes;
the first word they share leaves both enough words for the overlap they need, which bounds places and lengths at
once; a parity sketch of 64 to 256 bits sifts what is left inside the join, and whole sets verify it. DataFrame
functions only.

Lines of equal sets are one class, named by its first place, so copies are never paired. Each group of a prefix word
meets its earliest class first; only classes that found no match there then meet the other earlier ones. Of two sets,
the smaller shares its first word within a shorter prefix, and only these words, the rarest, meet whole groups.

Every line with a word takes part (or, if ``least`` is given, with that many different words); lines without words
stay. Sets too small to match any but equal ones, under four words at 0.8, are in no pairs. Null text stays null; of
repeated rows the first one counts as earlier, so the others lose every line with a word; rows that share a doc_id
are ordered by line number and then by a hash of their text; documents without doc_id come first; an empty table
gives an empty table; very long lines and texts are treated whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_shuffles, written

#: Entries of the table of levels.
ENTRIES = 1 << 17
FILTER_BITS = 1 << 23
LOW = (1 << 56) - 1
#: Sets of more words than these have sketches of two and of four words.
WIDE, WIDER = 96, 224
SKETCH = ("a", "b", "c", "d")
BLANKS = "[ \\t\\x0B\\f\\r]+"


def words(line: Column) -> Column:
    """The words of a line, in lower case. Splitting at a single blank needs no pattern; few lines hold other ones."""
    low = F.lower(line)
    return F.array_remove(F.when(line.rlike("[\\t\\x0B\\f\\r]"), F.split(low, BLANKS)).otherwise(F.split(low, " ")), "")


def entry(number: Column) -> Column:
    return number.bitwiseAND(F.lit(ENTRIES - 1)).cast("int")


def rarity(docs: DataFrame) -> Column:
    """The leading bits of a word's number, by entry(): how many binary digits the count of all words of the entry has,
    in the place they take there.
    A rare word that shares an entry with a frequent one looks frequent, and words beside rare blanks are counted with
    them, which only costs candidates. Counts meet by entry, so a task sends at most as many as there are entries."""
    each = docs.select(F.explode(F.split(F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counted = each.groupBy(entry(F.xxhash64("w")).alias("h")).agg(F.length(F.bin(F.count(F.lit(1)))).alias("b"))
    table = ["0"] * ENTRIES
    for r in counted.groupBy("b").agg(F.collect_list("h").alias("hs")).collect():
        for h in r["hs"]:
            table[h] = str(r["b"] << 56)
    return F.split(F.lit(",".join(table)), ",").cast("array<bigint>")


def token_set(line: Column, levels: Column) -> Column:
    """The distinct words of a line as numbers, rarest first. Without possible nulls they are sorted as plain longs.
    Hashes are told apart by the bits that a number keeps of them."""
    level = lambda h: F.coalesce(F.get(levels, entry(h)), F.lit(0).cast("long"))
    number = lambda h: level(h).bitwiseOR(h)
    hashes = F.array_distinct(F.transform(words(line), lambda w: F.xxhash64(w).bitwiseAND(F.lit(LOW))))
    return F.sort_array(F.transform(hashes, number))


def once(c: Column) -> Column:
    """c as the output of a generator: a filter on it is not moved below, where c would be worked out again."""
    return F.explode(F.array(c))


def needed(n: Column, t: int) -> Column:
    """The least overlap of a set of n with one at least as similar as t hundredths: ceil(t * n / 100)."""
    return F.floor((n * t + 99) / 100)


def sketch(set_: Column, n: Column) -> list[Column]:
    """Parities of a set in 64 bits: of all elements, each of which flips one bit; of those with a certain bit set, for
    sets over WIDE; and of those with another bit, and with both, for sets over WIDER. Sums (XOR) of these are the
    words of a sketch of 64, 128 or 256 bits: two sets differ in at least as many elements as bits."""
    place = lambda h: h.bitwiseAND(F.lit(63)).cast("int")
    flip = lambda one, h: F.call_function("shiftleft", one, place(h))
    parity = lambda one: F.aggregate(set_, F.lit(0).cast("long"), lambda bits, h: bits.bitwiseXOR(flip(one(h), h)))
    bit = lambda k: lambda h: F.shiftright(h, k).bitwiseAND(F.lit(1))
    both = lambda h: F.shiftright(h, 6).bitwiseAND(F.shiftright(h, 7)).bitwiseAND(F.lit(1))
    none = F.lit(0).cast("long")
    over = lambda most, c: F.when(n > most, c).otherwise(none)
    return [c.alias(k) for k, c in zip(SKETCH, (parity(lambda h: F.lit(1).cast("long")), over(WIDE, parity(bit(6))), over(WIDER, parity(bit(7))), over(WIDER, parity(both))))]


def apart(x: str, y: str) -> Column:
    """The Hamming distance of two sketches, at the smaller of their sizes."""
    bits = lambda *of: F.bit_count(_xor([F.col(f"{c}_{s}") for c in of for s in (x, y)]))
    less = F.least(f"n_{x}", f"n_{y}")
    wider = bits("d") + bits("b", "d") + bits("c", "d") + bits(*SKETCH)
    return F.when(less > WIDER, wider).when(less > WIDE, bits("b") + bits("a", "b")).otherwise(bits("a"))


def _xor(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out.bitwiseXOR(c)
    return out


def doc_of() -> Column:
    """The document's place in the order; no doc_id comes first."""
    return F.coalesce("doc_id", F.lit(-(1 << 63)))


def tag_of(docs: DataFrame) -> Column:
    """What tells documents of one doc_id apart: a hash of the text, or 0 if no doc_id repeats, which is less to send."""
    again = docs.groupBy(doc_of().alias("doc")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return F.lit(0) if again.isEmpty() else F.hash("text")


def placed(docs: DataFrame, tag: Column | None = None) -> DataFrame:
    """doc, tag, text: the document's place in the order and what tag_of() says."""
    return docs.select(doc_of().alias("doc"), (F.hash("text") if tag is None else tag).alias("tag"), "text")


def maybe(rows: DataFrame, key: list[str], wanted: DataFrame) -> DataFrame:
    """rows and whether their key may be in wanted: false only if it is not there. A bitmap of fixed size, joined by
    its words, says so without a shuffle of rows."""
    spot = F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))
    bitmap = wanted.select(spot.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    met = rows.withColumn("p", spot).withColumn("w", F.shiftright("p", 6)).join(F.broadcast(bitmap), "w", "left")
    return met.withColumn("maybe", F.expr("coalesce(shiftright(bits, cast(p & 63 as int)) & 1, 0) = 1")).drop("p", "w", "bits")


def spot_of() -> Column:
    return F.shiftleft(F.col("line").cast("long"), 32).bitwiseOR(F.col("tag").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def split_lines(docs: DataFrame) -> DataFrame:
    """doc, spot, s of each line of placed(): spot is the line number and then the tag."""
    each = docs.select("doc", "tag", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    return each.select("doc", spot_of().alias("spot"), "s")


def lines_of(docs: DataFrame, levels: Column, t: int, least: int) -> DataFrame:
    """doc, spot, cls, n, sketch words and prefix of the lines that take part."""
    each = split_lines(docs).select("doc", "spot", once(token_set(F.col("s"), levels)).alias("set"))
    n = F.size("set")
    # So few words that one word more or less is below the threshold: only equal sets match, and these are one class.
    alone = n * (100 - t) < t
    prefix = F.slice("set", F.lit(1), F.when(alone, 0).otherwise(n - needed(n, t) + 1).cast("int"))
    return each.where(n >= least).select("doc", "spot", F.xxhash64("set").alias("cls"), n.alias("n"), *sketch(F.col("set"), n), prefix.alias("prefix"))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, spot, set (of word hashes, in no order) of each place of wanted. One bitmap, of which a document has a word
    and a line a bit, drops documents that have no such place before their lines are read, and other lines before they
    are sent."""
    word, bit = F.pmod(F.xxhash64("doc"), F.lit(FILTER_BITS >> 6)), F.xxhash64("doc", "spot").bitwiseAND(F.lit(63)).cast("int")
    bitmap = wanted.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("w").agg(F.bit_or("b").alias("bits"))
    some = docs.withColumn("w", word).join(F.broadcast(bitmap), "w")
    own = some.select("doc", "tag", "bits", F.posexplode(F.split("text", "\n")).alias("line", "s")).select("doc", spot_of().alias("spot"), "s", "bits")
    there = own.where(F.call_function("shiftright", "bits", bit).bitwiseAND(F.lit(1)) == 1).drop("bits").join(wanted, ["doc", "spot"], "left_semi")
    return there.dropDuplicates(["doc", "spot"]).select("doc", "spot", F.array_distinct(F.transform(words(F.col("s")), lambda w: F.xxhash64(w))).alias("set"))


def similar(pairs: DataFrame, docs: DataFrame, t: int) -> DataFrame:
    """doc, spot: the x of pairs (doc_x, spot_x, doc_y, spot_y) whose sets, read again, are similar."""
    ends = [pairs.select(F.col(f"doc_{c}").alias("doc"), F.col(f"spot_{c}").alias("spot")) for c in "xy"]
    sets = written(sets_of(docs, ends[0].unionByName(ends[1]).distinct()), "line-sets")
    own = lambda c: sets.select(*(F.col(k).alias(f"{k}_{c}") for k in ("doc", "spot", "set")))
    both = F.size(F.array_intersect("set_x", "set_y"))
    joined = pairs.join(own("y"), ["doc_y", "spot_y"]).join(own("x"), ["doc_x", "spot_x"])
    alike = joined.where(100 * both >= t * (F.size("set_x") + F.size("set_y") - both))
    found = written(alike.select(F.col("doc_x").alias("doc"), F.col("spot_x").alias("spot")).distinct(), "line-found")
    discard(sets)
    return found


#: What a posting says of its class; shut: the class needs no more partners.
POSTED = ("doc", "spot", "n", "at", "shut", *SKETCH)
PAIR = ("doc_x", "spot_x", "doc_y", "spot_y")


def indexed(n: Column, at: Column, t: int) -> Column:
    """Whether a shared word at this place can be the first that a set of n shares with a similar one of its size or
    more: the overlap is then ceil(2 * t * n / (100 + t)) or more, so these words are fewer than the prefix's."""
    return at <= n - F.floor((n.cast("long") * (2 * t) + (99 + t)) / (100 + t))


def earlier(x: str, y: str) -> Column:
    return (F.col(f"doc_{x}") < F.col(f"doc_{y}")) | ((F.col(f"doc_{x}") == F.col(f"doc_{y}")) & (F.col(f"spot_{x}") < F.col(f"spot_{y}")))


def possible(t: int, x: str, y: str) -> Column:
    """Whether classes x and y can be similar when the shared word is the first they share."""
    total = (F.col(f"n_{x}") + F.col(f"n_{y}")).cast("long")
    overlap = F.least(F.col(f"n_{x}") - F.col(f"at_{x}"), F.col(f"n_{y}") - F.col(f"at_{y}"))
    return (overlap.cast("long") * (100 + t) >= t * total) & (apart(x, y).cast("long") * (100 + t) <= (100 - t) * total)


def posted(own: DataFrame, t: int, only_indexed: bool = False) -> DataFrame:
    """A row for each word of the prefix of each class, dealt by word. On its way n, at and shut are one number, and a
    word is 32 bits of its hash: others that share them only add pairs to test."""
    each = own.select("doc", "spot", "n", *SKETCH, "shut", F.posexplode("prefix").alias("at", "word"))
    if only_indexed:
        each = each.where(indexed(F.col("n"), F.col("at"), t))
    said = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("at").cast("long"), 1)).bitwiseOR(F.col("shut").cast("long"))
    dealt = each.select(F.col("word").bitwiseAND(F.lit(0xFFFFFFFF)).alias("token"), "doc", "spot", said.alias("said"), *SKETCH).repartition("token")
    at = F.shiftright(F.col("said").bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int")
    return dealt.select("token", "doc", "spot", F.shiftright("said", 32).cast("int").alias("n"), at.alias("at"), (F.col("said").bitwiseAND(F.lit(1)) == 1).alias("shut"), *SKETCH)


def sifted(open_: DataFrame, t: int) -> DataFrame:
    """PAIR of classes that may be similar, of which the later one, x, is not shut. Of two, the smaller has the first
    word they share among its indexed ones, so only these meet all postings of the word. Both sides read one shuffle."""
    every = posted(open_, t)
    p, i = (every.select("token", *(F.col(c).alias(f"{c}_{s}") for c in POSTED)) for s in "pi")
    # The generator keeps the filter on this side of the shuffle, which would not be the same for both else.
    i = i.select("*", once(indexed(F.col("n_i"), F.col("at_i"), t)).alias("meets")).where("meets").drop("meets")
    larger = (F.col("n_i") < F.col("n_p")) | ((F.col("n_i") == F.col("n_p")) & earlier("i", "p"))
    wanted = F.when(earlier("i", "p"), ~F.col("shut_p")).otherwise(earlier("p", "i") & ~F.col("shut_i"))
    met = p.join(i.hint("merge"), "token").where(larger & possible(t, "p", "i") & wanted)
    x_is_p = earlier("i", "p")
    return met.select(*(F.when(x_is_p, F.col(f"{c}_p")).otherwise(F.col(f"{c}_i")).alias(f"{c}_x") for c in ("doc", "spot")), *(F.when(x_is_p, F.col(f"{c}_i")).otherwise(F.col(f"{c}_p")).alias(f"{c}_y") for c in ("doc", "spot"))).distinct()


def later_matches(docs: DataFrame, t: int = 80, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(doc, tag, lines: the numbers of the lines to remove; doc, tag of repeated rows). docs: doc, tag, text."""
    spark = docs.sparkSession
    levels = rarity(docs)
    free_shuffles(spark)
    lines = written(lines_of(docs, levels, t, least), "lines")
    slim = lines.select("doc", "spot", "cls")
    firsts = slim.groupBy("cls").agg(F.min(F.struct("doc", "spot")).alias("first"), F.count(F.lit(1)).alias("n_lines"))
    repeats = written(firsts.where("n_lines > 1").select("cls", "first"), "line-repeats")
    del firsts
    place = F.struct("doc", "spot")
    low = F.col("spot").bitwiseAND(F.lit(0xFFFFFFFF))
    tag = F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int").alias("tag")
    again = slim.join(repeats.hint("merge"), "cls").select("doc", "spot", (place > F.col("first")).alias("later"))
    again = written(again, "line-again")
    copies = again.where("later").select("doc", "spot")
    often = again.groupBy("doc", "spot").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc", tag).distinct()
    often = written(often, "line-often")
    # Each class goes on as its first line; the others are gone already. Joins here are by sorting at any size.
    met = maybe(lines.where(F.size("prefix") > 0), ["cls"], repeats)
    own = met.where("maybe").drop("maybe").join(repeats.hint("merge"), "cls", "left").where(F.col("first").isNull() | (F.col("first") == place))
    kinds = ("doc", "spot", "n", *SKETCH, "prefix")
    classes = written(met.where("not maybe").select(*kinds).unionByName(own.select(*kinds)), "classes")
    discard(lines, repeats)
    del slim, met, own
    free_shuffles(spark)

    led = posted(classes.withColumn("shut", F.lit(False)), t, only_indexed=True)
    led = led.withColumn("lead", F.min(F.struct(*POSTED)).over(Window.partitionBy("token")))
    led = led.select(*(F.col(c).alias(f"{c}_x") for c in POSTED), *(F.col(f"lead.{c}").alias(f"{c}_y") for c in POSTED))
    tested = written(led.where(earlier("y", "x") & possible(t, "x", "y")).select(*PAIR).distinct(), "line-pairs")
    del led
    free_shuffles(spark)
    found = similar(tested, docs, t)
    discard(tested)
    shut = found.select("doc", "spot", F.lit(True).alias("hit")).hint("merge")
    met = maybe(classes, ["doc", "spot"], found)
    some = met.where("maybe").drop("maybe").join(shut, ["doc", "spot"], "left").withColumn("shut", F.coalesce("hit", F.lit(False))).drop("hit")
    open_ = met.where("not maybe").drop("maybe").withColumn("shut", F.lit(False)).unionByName(some)
    tested = written(sifted(open_, t), "line-pairs")
    discard(classes)
    del met, some, open_
    free_shuffles(spark)
    more = similar(tested, docs, t)
    discard(tested)
    # Of a class, all lines but the first go, and the first too if an earlier class is similar.
    gone = copies.unionByName(found).unionByName(more).select("doc", tag, F.shiftright("spot", 32).cast("int").alias("line"))
    gone = written(gone.groupBy("doc", "tag").agg(F.collect_set("line").alias("lines")), "line-gone")
    discard(again, found, more)
    free_shuffles(spark)
    return gone, often


def deduped(docs: DataFrame, t: int = 80, least: int = 1) -> DataFrame:
    """docs with text less its later matches, and the columns n_lines and n_removed."""
    tag = tag_of(docs)
    gone, often = later_matches(placed(docs, tag), t, least)
    packed = docs.select("text", F.struct(*(c for c in docs.columns if c != "text")).alias("row"), doc_of().alias("doc"), tag.alias("tag"), F.lit(False).alias("again"))
    if not often.isEmpty():
        alike = Window.partitionBy("doc", "tag").orderBy(F.lit(0))
        numbered = packed.join(often, ["doc", "tag"], "left_semi").withColumn("again", F.row_number().over(alike) > 1)
        packed = packed.join(often, ["doc", "tag"], "left_anti").unionByName(numbered)
    # Only documents that may lose lines are sent to what they lose.
    met = maybe(packed, ["doc"], gone.select("doc"))
    some = met.where("maybe").join(gone.hint("merge"), ["doc", "tag"], "left")
    joined = met.where("not maybe").withColumn("lines", F.lit(None).cast("array<int>")).unionByName(some)
    parts = F.split("text", "\n")
    goes = lambda s, i: F.when(F.col("again"), F.size(F.array_distinct(words(s))) >= least).otherwise(F.coalesce(F.array_contains("lines", i), F.lit(False)))
    stays = F.filter(parts, lambda s, i: ~goes(s, i))
    touched = F.col("again") | F.col("lines").isNotNull()
    text = F.when(touched & F.col("text").isNotNull(), F.concat_ws("\n", stays)).otherwise(F.col("text"))
    n_lines = F.coalesce(F.when(F.col("text").isNotNull(), F.size(parts)), F.lit(0))
    removed = F.when(F.col("again"), F.size(parts) - F.size(stays)).otherwise(F.size("lines"))
    return joined.select("row", text.alias("text"), n_lines.cast("long").alias("n_lines"), F.greatest(F.coalesce(removed, F.lit(0)), F.lit(0)).cast("long").alias("n_removed"))


def report(docs: DataFrame, t: int = 80, least: int = 1) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of every row."""
    return deduped(docs, t, least).select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def kept(docs: DataFrame, t: int = 80, least: int = 1) -> DataFrame:
    """The documents with what is left of them, in their own columns; those that lost all their text go."""
    out = deduped(docs, t, least).where((F.col("n_removed") <= 0) | (F.regexp_replace("text", "\\s+", "") != ""))
    replace = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(replace.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT rid, doc_id, i AS line, list_distinct(list_filter(regexp_split_to_array(lower(parts[i]), '[ \\t\\x0B\\f\\r]+'), lambda w: w <> '')) AS ws
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM d)),
k AS (SELECT *, len(ws) AS n, row_number() OVER (ORDER BY doc_id NULLS FIRST, line) AS pl FROM l WHERE len(ws) >= 1),
w AS (SELECT first, n, unnest(ws) AS word FROM (SELECT list_sort(ws) AS ws, n, min(pl) AS first FROM k GROUP BY 1, 2)),
f AS (SELECT word, count(*) AS df FROM w GROUP BY word),
p AS (SELECT first, n, word, row_number() OVER (PARTITION BY first ORDER BY df, word) AS r FROM w JOIN f USING (word)),
q AS (SELECT DISTINCT x.first AS x, y.first AS y FROM p x JOIN p y ON x.word = y.word AND y.first < x.first
  AND x.r <= x.n - ceil(x.n * 0.8) + 1 AND y.r <= y.n - ceil(y.n * 0.8) + 1 AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
s AS (SELECT q.x, q.y, count(*) AS o FROM q JOIN w a ON a.first = q.x JOIN w b ON b.first = q.y AND a.word = b.word GROUP BY 1, 2),
m AS (SELECT DISTINCT x FROM s JOIN (SELECT DISTINCT first, n FROM w) a ON a.first = s.x JOIN (SELECT DISTINCT first, n FROM w) b ON b.first = s.y WHERE 100 * o >= 80 * (a.n + b.n - o)),
g AS (SELECT k.rid, k.line FROM k JOIN (SELECT list_sort(ws) AS ws, min(pl) AS first FROM k GROUP BY 1) e ON list_sort(k.ws) = e.ws WHERE k.pl > e.first OR e.first IN (SELECT x FROM m)),
r AS (SELECT rid, list(line) AS gone FROM g GROUP BY rid)
SELECT doc_id, coalesce(len(parts), 0)::bigint AS n_lines, coalesce(len(gone), 0)::bigint AS n_removed,
  sha256(coalesce(array_to_string(list_filter(parts, lambda v, i: NOT list_contains(coalesce(gone, []), i)), chr(10)), '')) AS kept_sha256
FROM d LEFT JOIN r USING (rid)
"""
