"""Benchmark decontamination: token windows of the documents against a hash set of test n-grams.

Native: DataFrame functions only. A document's n-grams leave one by one and probe the hash set
of normalised benchmark n-grams. The set is broadcast only after its rows and bytes have been counted;
a larger one is joined by shuffle. The n-gram text itself is the join key, so each
hit is verified by equality of the words.

Defined results: null or wordless texts have no words and no hits; a benchmark item without words
or without an id takes no part; repeated item rows count once; rows that repeat a document id are
handled one by one; extra columns of either table are ignored by ``decontaminate`` and kept by
``remove_hits``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import persist_table

NGRAM = 10
#: n-grams, and their bytes with the items that hold them, up to which the set is broadcast.
BROADCAST_NGRAMS = 500_000
BROADCAST_BYTES = 1 << 25
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, once A-Z are lower-cased: ASCII but a-z and 0-9.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z only; plain ``lower`` does that where a text has no other than ASCII characters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BETWEEN), ""), F.array().cast("array<string>"))


def benchmark_grams(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = NGRAM) -> DataFrame:
    """(n, gram, item_ids): the windows of all items, each once with the sorted ids that hold it."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("words"))
    items = items.filter(F.col("item_id").isNotNull() & (F.size("words") > 0))
    size = F.least(F.size("words"), F.lit(n))
    grams = items.select(
        "item_id",
        size.alias("n"),
        F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - size), lambda i: F.array_join(F.slice("words", i + 1, size), " "))).alias("gram"),
    )
    return grams.groupBy("n", "gram").agg(F.collect_set("item_id").alias("item_ids"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, broadcast_ngrams: int = BROADCAST_NGRAMS
) -> DataFrame:
    """Per document row: id, text, words, hit word positions (sorted) and the ids of the items found."""
    grams = persist_table(benchmark_grams(benchmark, n=n), "grams")
    held = F.octet_length("gram") + F.aggregate("item_ids", F.lit(0), lambda a, x: a + F.octet_length(x) + 16) + 64
    sizes = grams.groupBy("n").agg(F.count("*").alias("rows"), F.sum(held).alias("bytes")).collect()  # n rows at most
    small = sum(r["rows"] for r in sizes) <= broadcast_ngrams and sum(r["bytes"] for r in sizes) <= BROADCAST_BYTES
    return _with_hits(_keyed(docs, id_col, text_col), grams, sorted(r["n"] for r in sizes), small)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A document is keyed by id and text hash, so repeated ids cannot mix their hits."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("key"))


def _with_hits(keyed: DataFrame, grams: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    counted = keyed.select("id", "key", F.size(words_of(F.col("text"))).alias("n_words"))
    if not sizes:
        return counted.select("id", "key", "n_words", F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"))
    # places are laid out first and a window is joined as its row leaves, so a document's windows are never held together
    split = keyed.select("id", "key", words_of(F.col("text")).alias("words"), F.explode(F.array(*[F.lit(k) for k in sizes])).alias("n"))
    starts = F.when(F.size("words") >= F.col("n"), F.sequence(F.lit(0), F.size("words") - F.col("n"))).otherwise(F.array().cast("array<int>"))
    placed = split.select("id", "key", "words", "n", F.explode(starts).alias("pos"))
    exploded = placed.select("id", "key", "pos", "n", F.array_join(F.slice("words", F.col("pos") + 1, F.col("n")), " ").alias("gram"))
    grams = F.broadcast(grams) if small else grams
    found = exploded.join(grams, ["n", "gram"]).select("id", "key", "item_ids", F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1).alias("at"))
    per_doc = found.groupBy("id", "key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("at")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items"),
    )
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    joined = counted.alias("d").join(per_doc.alias("h"), F.col("d.id").eqNullSafe(F.col("h.id")) & (F.col("d.key") == F.col("h.key")), "left")
    return joined.select("d.id", "d.key", "n_words", none("hits", "array<int>"), none("items", "array<string>"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM) -> DataFrame:
    """The digest of ``op5``: one row per document row."""
    found = decontaminate(docs, benchmark, id_col, text_col, n)
    return found.select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM) -> DataFrame:
    """The documents without any hit, all columns kept."""
    found = decontaminate(docs, benchmark, id_col, text_col, n).filter(F.size("hits") > 0).select(F.col("id").alias("_hit_id"), F.col("key").alias("_hit_key")).distinct()
    keyed = docs.withColumn("_key", F.xxhash64(F.col(text_col)))
    return keyed.join(found, F.col(id_col).eqNullSafe(F.col("_hit_id")) & (F.col("_key") == F.col("_hit_key")), "left_anti").drop("_key")


def remove_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM) -> DataFrame:
    """Documents with the hit words cut out of the text; what stands between kept words stays.

    The text is split at word borders into words and separators; a hit word and the separator after
    it go. Documents without hits are unchanged.
    """
    found = decontaminate(docs, benchmark, id_col, text_col, n).filter(F.size("hits") > 0)
    found = found.select(F.col("id").alias("_hit_id"), F.col("key").alias("_hit_key"), F.col("hits").alias("_hits")).dropDuplicates(["_hit_id", "_hit_key"])
    keyed = docs.withColumn("_key", F.xxhash64(F.col(text_col)))
    joined = keyed.join(found, F.col(id_col).eqNullSafe(F.col("_hit_id")) & (F.col("_key") == F.col("_hit_key")), "left")
    other = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    parts = F.split(F.regexp_replace(F.col(text_col), f"^{other}+", ""), f"(?<={other})(?!{other})")
    head = F.regexp_extract(F.col(text_col), f"^{other}*", 0)
    marks = F.map_from_arrays(F.col("_hits"), F.transform("_hits", lambda _: F.lit(True)))
    kept = F.filter(F.transform(parts, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: ~F.map_contains_key(marks, s["i"]))
    cut = F.concat(head, F.array_join(F.transform(kept, lambda s: s["w"]), ""))
    return joined.withColumn(text_col, F.when(F.col("_hits").isNull(), F.col(text_col)).otherwise(cut)).select(*docs.columns)
