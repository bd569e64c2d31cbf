"""Retrieval quality over (query_id, rank, relevant) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def target_key(item: Column) -> Column:
    """Paths count by their last part, case aside."""
    return F.lower(F.regexp_extract(item, r"([^/\\]*)$", 1))


def once(rows: DataFrame, value: str, best) -> DataFrame:
    named = rows if dict(rows.dtypes)["item"] != "string" else rows.withColumn("item", target_key(F.col("item")))
    return named.groupBy("query_id", "item").agg(best(value).alias(value))


def per_query(runs: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, hit, precision, recall, reciprocal_rank, ndcg) at k; queries without relevant rows score 0.
    ``runs``(query_id, item, rank), ``qrels``(query_id, item, gain). Items that are strings are paths and
    compare by their lower-case last part; an item counts once, at its first rank."""
    runs, qrels = once(runs, "rank", F.min), once(qrels, "gain", F.max)
    gains = qrels.groupBy("query_id").agg(F.count("*").alias("n_relevant"), F.array_sort(F.collect_list(-F.col("gain"))).alias("ideal"))
    marked = runs.filter(F.col("rank") <= k).join(qrels, ["query_id", "item"], "left").withColumn("rel", F.coalesce("gain", F.lit(0)) > 0)
    sums = marked.groupBy("query_id").agg(F.count_if("rel").alias("found"), F.min(F.when(F.col("rel"), F.col("rank"))).alias("first"), F.sum(dcg_term(F.coalesce("gain", F.lit(0)), F.col("rank"))).alias("dcg"))
    both = gains.join(sums, "query_id", "left")
    ideal = F.aggregate(F.transform(F.slice("ideal", 1, k), lambda g, i: dcg_term(-g, i + 1)), F.lit(0.0), lambda a, x: a + x)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select("query_id", F.coalesce((F.col("found") > 0).cast("int"), F.lit(0)).alias("hit"), zero(F.col("found") / k).alias("precision"), zero(F.col("found") / F.col("n_relevant")).alias("recall"), zero(1.0 / F.col("first")).alias("reciprocal_rank"), zero(F.col("dcg") / ideal).alias("ndcg"))


def dcg_term(gain: Column, rank: Column) -> Column:
    """(2^gain - 1) / log2(rank + 1); for gains of 0 and 1 that is the binary form."""
    return (F.pow(F.lit(2.0), gain) - 1) / F.log2(rank + 1)


def means(scores: DataFrame) -> DataFrame:
    return scores.agg(*[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("hit", "precision", "recall", "reciprocal_rank", "ndcg")])


PERCENTILES = (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))


def ordered_counts(rows: DataFrame, value: str) -> DataFrame:
    """(value, below, upto): the distinct values with how many rows lie below each and up to it. Values
    are pre-aggregated and ranged over partitions; only a count of each partition is summed up."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange("value").withColumn("part", F.spark_partition_id())
    own = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    before = ranged.groupBy("part").agg(F.sum("n").alias("total"))
    starts = before.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("start"))  # a row a partition
    placed = ranged.withColumn("upto", own).join(F.broadcast(starts), "part")
    return placed.select("value", (F.col("start") + F.col("upto") - F.col("n")).alias("below"), (F.col("start") + F.col("upto")).alias("upto"))


def _at(counts: DataFrame, wanted: list[tuple[str, Column]]) -> DataFrame:
    """One row: the values at 0-based places of the whole order."""
    return counts.agg(*[F.min(F.when((F.col("below") <= place) & (place < F.col("upto")), F.col("value"))).alias(name) for name, place in wanted])


def latency(rows: DataFrame, value: str) -> DataFrame:
    """P50, P95 and P99 with linear interpolation, exact, without all values in one task."""
    counts = ordered_counts(rows, value)
    total = counts.agg(F.max("upto").alias("total"))
    placed = counts.join(F.broadcast(total))  # one row
    spot = {n: (F.col("total") - 1) * F.lit(p) for n, p in PERCENTILES}
    wanted = [(f"{n}_{side}", f(spot[n])) for n, _ in PERCENTILES for side, f in (("lo", F.floor), ("hi", F.ceil))]
    found = _at(placed, wanted).join(F.broadcast(total))
    between = lambda n: F.col(f"{n}_lo") + (spot[n] - F.floor(spot[n])) * (F.col(f"{n}_hi") - F.col(f"{n}_lo"))
    return found.select(*[between(n).alias(n) for n, _ in PERCENTILES])


def index_percentiles(rows: DataFrame, value: str) -> DataFrame:
    """The other definition of P50, P95 and P99: the element at floor(n * p) of the sorted values."""
    counts = ordered_counts(rows, value)
    placed = counts.join(F.broadcast(counts.agg(F.max("upto").alias("total"))))  # one row
    return _at(placed, [(n, F.floor(F.col("total") * F.lit(p))) for n, p in PERCENTILES])


def report(scores: DataFrame, folder: str) -> None:
    """Per-query results as JSON lines."""
    scores.write.mode("overwrite").json(folder)
