"""Line dedup by an exact set-similarity join.

A line is the set of its words. Sets are ordered by rarity (rarest first), and two sets of Jaccard
similarity 0.8 or more share a word among their first n - ceil(0.8 n) + 1. Candidates meet on these
prefix words, pass the length and the positional filter, and are verified on the whole sets. A line
goes if an earlier line (by document, then line number) has a similarity of 0.8 or more.

Equal sets fold into one before the join, so copies of a line meet nobody. Rarity comes from word
counts over the whole corpus, held in a sketch of fixed size (2^21 one-byte logarithmic counts)
which a scalar subquery hands to every task; its collisions can only change the order, which is any
total order as far as the result goes. Words are 64-bit hashes, 56 bits of them under their rarity
in the prefixes.

Whole sets never travel with the candidates. A parity of each set (64 bits, 128 for larger sets)
bounds the difference of two sets from below and rules out most false candidates inside the join
itself; the words of the sets that still matter are read from the texts again. Sets are numbered in
the order of their first lines, which tells the later of two. A set needs one earlier match, so every set
first meets the earliest sets under some words of its prefix, its pilots. For the sets that found no
match there the prefix join is a semi join: it names the sets that may still be in a pair, and makes
no pairs. Those few sets get a parity of 512 bits and meet in rounds: in each an open set meets a
share of the earlier sets, GROWTH times that of the round before, and leaves when a pair proves
similar. A set with c partners is expected to leave before it has met more than a few, whatever c
is, so large groups of near copies cost a few rows a round for each member.

A set is named by two 64-bit hashes of its words.

Native: DataFrame functions only.

Defined results: lines are cut at line feeds; lines without words (and null texts, which have one
such line) never go; rows that agree in id and text are one document and each get its result; rows
that share only the id are documents of their own, in the order of a hash of their text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, persist_table

SKETCH_BITS, ROW_BITS = 21, 11
#: Sketch code of a bucket that has counted one word.
ONCE = 4
#: Words at either end of a prefix by which a set looks for earlier sets before the full join.
PILOTS = 3
#: Shares of the prefix words that are joined one after the other.
PASSES = 2
#: What the filters of a pair read of a set.
SHAPE = ["n", "whole", "odd"]
#: Sets of more words have a parity of 128 bits, smaller ones of 64.
SMALL = 64
#: Longs of the parity by which the sets that are left by the prefix join meet, and the factor
#: by which the share of earlier sets grows from one of their rounds to the next.
WIDE, GROWTH = 8, 16
#: Similarity as a fraction.
NUM, DEN = 4, 5


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def words(line: Column) -> Column:
    """Words of a line, with empty strings among them where white space meets."""
    for space in "\t\n\v\f\r":
        line = F.replace(line, F.lit(space), F.lit(" "))
    return F.split(line, " ")


def distinct_words(line: Column) -> Column:
    """Hashes of the distinct words of a line (null: none)."""
    hashes = F.transform(words(line), lambda w: F.xxhash64(w))
    return F.array_remove(F.array_distinct(hashes), F.xxhash64(F.lit("")))


def keyed_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, line_no, line) of all lines."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), F.split(text, "\n").alias("lines"))
    return rows.select("id", "key", F.posexplode("lines").alias("line_no", "line"))


def rarity_sketch(docs: DataFrame, text_col: str, bits: int = SKETCH_BITS) -> DataFrame:
    """One row, one array of 2^bits bytes: 4 log2 of the words counted in each bucket."""
    hashed = docs.select(F.explode(words(F.col(text_col).cast("string"))).alias("w")).select(F.xxhash64("w").alias("h"))
    counted = hashed.groupBy(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)).alias("b")).count()
    every = docs.sparkSession.range(1 << bits).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("count"))
    full = every.union(counted).groupBy("b").agg(F.sum("count").alias("n"))
    code = F.least(F.lit(93), F.floor(4 * F.log2(F.col("n") + 1))).cast("tinyint")
    part = F.sort_array(F.collect_list(F.struct(F.col("b").alias("k"), code.alias("s"))))["s"]
    rows = full.groupBy(F.shiftright("b", ROW_BITS).alias("hi")).agg(part.alias("part"))
    return rows.agg(F.flatten(F.sort_array(F.collect_list(F.struct("hi", "part")))["part"]).alias("sketch"))


def prefix(n: Column) -> Column:
    """n - ceil(n * NUM / DEN) + 1."""
    return n - F.floor((n * NUM + DEN - 1) / DEN).cast("int") + 1


def marked_lines(lines: DataFrame, sketch: Column) -> DataFrame:
    """(id, key, line_no, k, kk, n, whole, odd, prefix): every line with the two hashes that name its
    set, its size, its parity, that of the odd half of its words (0 in small sets) and its rarest
    words; k is null for a line without words."""

    def ranked(pair: Column) -> Column:
        table = pair["sketch"]
        code = lambda h: F.get(table, h.bitwiseAND(F.lit((1 << SKETCH_BITS) - 1)).cast("int")).cast("long")
        return F.transform(pair["set"], lambda h: F.shiftleft(code(h), 56).bitwiseOR(F.shiftrightunsigned(h, 8)))

    bit = lambda one, h: F.call_function("shiftleft", one, h.bitwiseAND(F.lit(63)).cast("int"))
    parity = lambda one: F.aggregate("set", F.lit(0).cast("long"), lambda held, h: held.bitwiseXOR(bit(one(h), h)))
    whole, odd = parity(lambda h: F.lit(1).cast("long")), parity(lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(1).cast("long")))
    odd = F.when(F.size("set") > SMALL, odd).otherwise(F.lit(0).cast("long"))
    # the subquery stands in a projection of its own, as none may stand in a lambda's arguments;
    # the optimiser moves it up to its one use, and the explode keeps it from joining the projection
    # below, so no row carries the sketch
    sets = lines.select("id", "key", "line_no", F.explode(F.array(distinct_words(F.col("line")))).alias("set")).withColumn("sketch", sketch)
    sets = sets.select("id", "key", "line_no", F.size("set").alias("n"), whole.alias("whole"), odd.alias("odd"), F.sort_array(let(F.struct("set", "sketch"), ranked)).alias("tokens"))
    named = [F.when(F.col("n") > 0, F.xxhash64("tokens")).alias("k"), F.when(F.col("n") > 0, F.xxhash64(F.lit("second"), "tokens", "whole", "odd")).alias("kk")]
    return sets.select("id", "key", "line_no", *named, "n", "whole", "odd", F.slice("tokens", 1, prefix(F.col("n"))).alias("prefix"))


def most_apart(both: Column) -> Column:
    """Largest symmetric difference of similar sets that hold ``both`` words together."""
    return both - 2 * F.ceil(both * NUM / (NUM + DEN)).cast("int")


def may_match(a, b) -> Column:
    """Length filter and parity filter of two set rows."""
    n, n2 = a["n"], b["n"]
    return (F.least(n, n2) * DEN >= F.greatest(n, n2) * NUM) & (apart(a, b) <= most_apart(n + n2))


def apart(a, b) -> Column:
    """Lower bound of the symmetric difference."""
    whole, odd = a["whole"].bitwiseXOR(b["whole"]), a["odd"].bitwiseXOR(b["odd"])
    halves = F.bit_count(whole.bitwiseXOR(odd)) + F.bit_count(odd)
    return F.when((a["n"] > SMALL) & (b["n"] > SMALL), halves).otherwise(F.bit_count(whole))


def pilots(sets: DataFrame) -> DataFrame:
    """(later, earlier): for a set the likeliest of the earliest sets that share one of the PILOTS
    rarest, or of the PILOTS most frequent, repeated words of its prefix. Near copies mostly meet the
    first of their group here, a few rows for each member."""
    repeated = F.filter("prefix", lambda t: F.shiftright(t, 56) > ONCE)
    own = sets.select("sid", *SHAPE, repeated.alias("all"))
    ends = own.select("sid", *SHAPE, F.explode(F.array_union(F.slice("all", 1, PILOTS), F.slice("all", -PILOTS, PILOTS))).alias("end"))
    heads = ends.groupBy("end").agg(F.min("sid").alias("earlier"), *[F.min_by(c, "sid").alias(f"{c}2") for c in SHAPE])
    one, two = {c: F.col(c) for c in SHAPE}, {c: F.col(f"{c}2") for c in SHAPE}
    met = ends.join(heads, "end").filter((F.col("sid") != F.col("earlier")) & may_match(one, two))
    return met.groupBy(F.col("sid").alias("later")).agg(F.min_by("earlier", apart(one, two)).alias("earlier"))


def within_reach(a, b) -> Column:
    """Positional filter: enough words are left from the prefix word that two posts share on."""
    return (1 + F.least(a["n"] - 1 - a["pos"], b["n"] - 1 - b["pos"])) * (NUM + DEN) >= (a["n"] + b["n"]) * NUM


def involved(sets: DataFrame, late: DataFrame, share: int = 0, passes: int = 1) -> DataFrame:
    """(sid): sets that share a prefix word with another and pass the length, positional and parity filters
    with it, where the later one is not known to be late; of the words those of one of ``passes`` shares.

    Both sides of the join are one exchange of the prefix words, so the condition is worded over both."""
    known = sets.join(late.select(F.col("later").alias("sid"), F.lit(True).alias("late")), "sid", "left").withColumn("open", F.col("late").isNull())
    posts = known.select("sid", *SHAPE, "open", F.posexplode("prefix").alias("pos", "token"))
    posts = posts.filter((F.shiftright("token", 56) > ONCE) & (F.pmod("token", F.lit(passes)) == share))  # a word of the corpus's only occurrence meets nobody
    a, b = posts.alias("a"), posts.alias("b")
    one, two = ({c: F.col(f"{x}.{c}") for c in posts.columns} for x in "ab")
    open_ = F.when(two["sid"] < one["sid"], one["open"]).otherwise(two["open"])
    met = a.join(b, (one["token"] == two["token"]) & (one["sid"] != two["sid"]) & open_ & may_match(one, two) & within_reach(one, two), "left_semi")
    return met.select("sid").distinct()


def wide_parity(words: Column) -> list[Column]:
    """WIDE longs, the parity of a set in 64 WIDE bits."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    part = lambda k: F.filter(words, lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(WIDE - 1)) == k)
    return [F.aggregate(part(k), F.lit(0).cast("long"), lambda held, h: held.bitwiseXOR(bit(h))).alias(f"p{k}") for k in range(WIDE)]


def met_in_round(posts: DataFrame, late: DataFrame, low: float, high: float) -> DataFrame:
    """(later, earlier): open sets with the earlier sets of one share that pass all filters."""
    wide = [f"p{k}" for k in range(WIDE)]
    a = posts.join(late.select(F.col("later").alias("sid")), "sid", "left_anti").filter("open").alias("a")
    b = posts.filter((F.col("part") >= low) & (F.col("part") < high)).alias("b")
    one, two = ({c: F.col(f"{x}.{c}") for c in posts.columns} for x in "ab")
    differ = reduce(lambda x, y: x + y, [F.bit_count(one[c].bitwiseXOR(two[c])) for c in wide])
    near = (F.least(one["n"], two["n"]) * DEN >= F.greatest(one["n"], two["n"]) * NUM) & (differ <= most_apart(one["n"] + two["n"]))
    met = a.join(b, (one["token"] == two["token"]) & (two["sid"] < one["sid"]) & near & within_reach(one, two))
    return met.select(one["sid"].alias("later"), two["sid"].alias("earlier")).distinct()


def words_of(keys: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sid, set): the words of the sets named, from the line that had each first."""
    wanted = keys.join(sets.select("sid", "first"), "sid").groupBy("first.id", "first.key").agg(F.collect_list(F.struct(F.col("first.line_no").alias("line_no"), "sid")).alias("wanted"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("own"), F.xxhash64(text).alias("key"), text.alias("text"))
    held = texts.join(wanted, texts["own"].eqNullSafe(wanted["id"]) & (texts["key"] == wanted["key"]))
    cut = held.select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
    # rows that repeat in the table name a set more than once
    return cut.select("w.sid", F.get("lines", F.col("w.line_no")).alias("line")).dropDuplicates(["sid"]).select("sid", distinct_words(F.col("line")).alias("set"))


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(later): sets with a similar set among the pairs."""
    early = held.select(F.col("sid").alias("earlier"), F.col("set").alias("a"))
    late = held.select(F.col("sid").alias("later"), F.col("set").alias("b"))
    whole = pairs.select("earlier", "later").join(early, "earlier").join(late, "later")
    fine = whole.filter(F.size(F.array_intersect("a", "b")) * (NUM + DEN) >= (F.size("a") + F.size("b")) * NUM)
    return fine.select("later").distinct()


def shares(n: int) -> list[tuple[float, float]]:
    """Parts of [0, 1) that grow by GROWTH from about 1 / n on."""
    ends, end = [], 1.0
    while True:
        ends.append(end)
        if end * n <= GROWTH:
            return list(zip([0.0, *ends[:0:-1]], ends[::-1], strict=True))
        end /= GROWTH


def late_sets(sets: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(later): sets with an earlier similar set. Sets whose pilot proves similar are settled; the
    others go through the prefix join against all, and what that leaves meets in rounds."""
    spark = sets.sparkSession
    led = persist_table(pilots(sets), "pilots")
    keys = led.select(F.col("earlier").alias("sid")).union(led.select(F.col("later").alias("sid"))).distinct()
    held = persist_table(words_of(keys, sets, docs, id_col, text_col), "words")
    late = persist_table(verified(led, held), "late")
    drop_tables(spark, held, led)
    # share by share, so that the prefix words lie on disk in parts
    parts = [persist_table(involved(sets, late, k, PASSES), "involved") for k in range(PASSES)]
    left = reduce(DataFrame.union, parts).distinct()
    held = persist_table(words_of(left, sets, docs, id_col, text_col), "words")
    opened = late.select(F.col("later").alias("sid"), F.lit(False).alias("open"))
    prefixes = held.select("sid", F.size("set").alias("n"), *wide_parity(F.col("set"))).join(sets.select("sid", "prefix"), "sid").join(opened, "sid", "left")
    part = F.pmod(F.xxhash64("sid"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    few = prefixes.select("sid", "n", *[f"p{k}" for k in range(WIDE)], F.coalesce("open", F.lit(True)).alias("open"), part.alias("part"), F.posexplode("prefix").alias("pos", "token"))
    posts = persist_table(few.filter(F.shiftright("token", 56) > ONCE), "posts")
    for low, high in shares(held.count()):
        late = late.union(persist_table(verified(met_in_round(posts, late, low, high), held), "late"))
    drop_tables(spark, *parts, held, posts)
    return late


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, n_lines, removed): per document the sorted numbers (from 0) of the lines that go."""
    spark = docs.sparkSession
    at = F.struct("id", "key", "line_no")
    marked = persist_table(marked_lines(keyed_lines(docs, id_col, text_col), rarity_sketch(docs, text_col).scalar()), "marked")
    of_set = [F.first(c).alias(c) for c in (*SHAPE, "prefix")]
    folded = marked.filter("k is not null").groupBy("k", "kk").agg(F.min(at).alias("first"), *of_set)
    folded = persist_table(folded, "folded")
    lines = persist_table(marked.select("id", "key", "line_no", "k", "kk"), "lines")
    drop_tables(spark, marked)
    # numbered in the order of their first lines
    ranged = folded.repartitionByRange("first").sortWithinPartitions("first")
    sets = persist_table(ranged.withColumn("sid", F.monotonically_increasing_id()), "sets")
    drop_tables(spark, folded)
    late = late_sets(sets, docs, id_col, text_col).select(F.col("later").alias("sid"), F.lit(True).alias("late"))
    verdict = sets.select("k", "kk", "sid", "first").join(late, "sid", "left").drop("sid")
    judged = lines.join(verdict, ["k", "kk"], "left")
    goes = F.col("late").isNotNull() | (F.col("first").isNotNull() & (F.col("first") < at))
    per_line = judged.select("id", "key", "line_no", F.when(goes, F.col("line_no")).alias("gone"))
    return per_line.groupBy("id", "key").agg((F.max("line_no") + 1).cast("long").alias("n_lines"), F.sort_array(F.collect_set("gone")).alias("removed"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of ``op7``: one row per document."""
    found = removed_lines(docs, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without their repeated lines, columns unchanged; a text that loses all lines is empty."""
    found = removed_lines(docs, id_col, text_col).select(F.col("id").alias("_line_id"), F.col("key").alias("_line_key"), "removed").filter(F.size("removed") > 0)
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    joined = docs.withColumn("_key", key).join(found.withColumnRenamed("removed", "_removed"), F.col(id_col).eqNullSafe(F.col("_line_id")) & (F.col("_key") == F.col("_line_key")), "left")
    marks = F.map_from_arrays("_removed", F.transform("_removed", lambda _: F.lit(True)))
    numbered = F.transform(F.split(F.col(text_col), "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    kept = F.array_join(F.transform(F.filter(numbered, lambda s: ~F.map_contains_key(marks, s["i"])), lambda s: s["x"]), "\n")
    return joined.withColumn(text_col, F.when(F.col("_removed").isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)
