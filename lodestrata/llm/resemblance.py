"""SimHash near-duplicates at a word-shingle similarity, verified: the operator for pipelines.

``simhash`` links fingerprints of one length within a fixed number of bits. A bound on the Jaccard
similarity of shingle sets needs more: at similarity s (two sets of one size) a SimHash bit differs
with probability p = acos(2 s / (1 + s)) / pi, 0.15 at 0.8. So

1. a document is the set of its distinct shingles, and equal sets fold into one node; its sketch is
   a SimHash of ``WORDS`` words of 64 bits;
2. ``tables`` runs of ``width`` bits of the sketch are the prefixes of as many tries, so many that a
   pair at s agrees in one of them with probability ``RECALL``. Runs are disjoint in the sketch; where
   more are needed than it has, they go on in drawn orders of its bits, and the number of tables
   allows for what such runs share (``Tries.found``). The nodes under a prefix are a bucket, and the
   trie below it joins itself: node pairs descend together, carry the differing bits and are cut off
   beyond the error budget (``DEVIATIONS`` standard deviations over the mean at s). Of the pairs that
   are left those go whose whole sketches or sizes rule out s;
3. every bucket first gives a spanning forest of its pairs, the most alike first, and each of these
   is verified on the whole sets. Where all are similar, the bucket is in its final components.
   For the other buckets all pairs of different components are verified, each pair in one table.
   So the components are those of all candidate pairs, and a large group of near copies gives a few
   pairs for each member, not all pairs;
4. a bucket of more than ``BUCKET_ROWS`` nodes is dealt over salts. In the second step the nodes outside
   its largest component visit every salt, which makes up for what salts could not see; a dealt
   bucket goes there even where all its forests are similar, as its salts have not met.

``width`` grows with the logarithm of the number of nodes (``LEAST_WIDTH`` bits at least), so buckets
keep their size; ``tables`` follows from it and grows as the 0.24th power of the number of nodes: 31 up
to 2^18 nodes, 104 at 2^24, 467 at 2^32. Tables are joined ``ROUND`` at a time, so no more copies of the
sketches than that are on disk at once at any size.

Defined results: wordless and null texts are the empty set and equal; texts of up to ``shingle``
words are one shingle; rows that repeat an id get one component; null ids are never a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, persist_table, text_slices
from .simhash import components, trie_pairs

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
WORDS, RECALL, DEVIATIONS, LEAST_WIDTH, BUCKET_ROWS = 12, 0.99, 2.75, 12, 8_192
#: Tables that are joined at once.
ROUND = 48
_ODD = np.random.default_rng(20_240_601).integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)
NODE = "fp long, n int, sketch binary"


def shingle_set(data: memoryview | bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of a text's word shingles."""
    words = (bytes(data) if data is not None else b"").lower().split()
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words))] if words else [], np.uint64)
    columns = [words[k:] for k in range(shingle)]
    return np.unique(np.fromiter(map(digest, map(b" ".join, zip(*columns, strict=False))), np.uint64, len(words) - shingle + 1))


def set_digest(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes(), seed=SEED)


def set_sketch(found: np.ndarray) -> bytes:
    """Bit b is 1 where over half of the set's members have it set in their hash."""
    votes = np.zeros(WORDS * 64, np.int64)
    for at in range(0, len(found), 240):  # so few that votes fit a byte
        h = found[at : at + 240, None] * _ODD
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        votes += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(found)).tobytes()


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp, n, sketch): digest, size and SimHash of every row's set."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, made = [], [], []
            for x in text_slices(batch.column(1)):
                found = shingle_set(x, shingle)
                fps.append(set_digest(found))
                sizes.append(len(found))
                made.append(set_sketch(found))
            columns = [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "fp", "n", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(make, f"id {kind}, {NODE}")


def shingle_sets(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(fp, items) of every distinct set."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in text_slices(batch.column(0)):
                found = shingle_set(x, shingle)
                fp = np.array([set_digest(found)], np.uint64).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(fp), lists], ["fp", "items"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(make, "fp long, items array<long>")
    return rows.groupBy("fp").agg(F.first("items").alias("items"))


class Tries:
    """Tables, their prefixes and the bounds of a search over ``nodes`` sets."""

    def __init__(self, nodes: int, similarity: float):
        self.similarity = similarity
        self.differ = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
        self.width = max(LEAST_WIDTH, math.ceil(math.log2(max(2, nodes))) - 6)
        self.runs = WORDS * 64 // self.width
        agree = (1 - self.differ) ** self.width
        self.tables = math.ceil(math.log(1 - RECALL) / math.log(1 - agree)) if agree < 1 else 1
        if self.tables > self.runs:
            while self.found(self.tables) < RECALL:
                self.tables += 1
        bound = lambda bits: math.floor(bits * self.differ + DEVIATIONS * math.sqrt(bits * self.differ * (1 - self.differ)))
        self.budget, self.most = bound(64 - self.width), bound(WORDS * 64)

    def found(self, tables: int) -> float:
        """The probability that a pair at the similarity agrees in one of ``tables`` runs. Disjoint runs are
        independent. Runs of several orders share bits, but they are independent for a given number d of
        differing bits, of which a run misses all with the probability of a draw without replacement."""
        bits, w = WORDS * 64, self.width
        if tables <= self.runs:
            return 1 - (1 - (1 - self.differ) ** w) ** tables
        d = np.arange(bits - w + 1)
        log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, bits + 1)))])
        chance = np.exp(log[bits] - log[d] - log[bits - d] + d * math.log(self.differ) + (bits - d) * math.log1p(-self.differ))
        misses = np.exp(log[bits - d] - log[bits - d - w] - log[bits] + log[bits - w])
        return float((chance * (1 - (1 - misses) ** tables)).sum())

    def places(self, table: int) -> np.ndarray:
        """The 64 bits of a table, those of its prefix first."""
        order, run = divmod(table, self.runs)
        at = (run * self.width + np.arange(64)) % (WORDS * 64)
        return np.random.default_rng(order).permutation(WORDS * 64)[at] if order else at

    def keys(self, bits: np.ndarray, table: int) -> np.ndarray:
        """The table's 64 bits of every sketch."""
        return np.frombuffer(np.packbits(bits[:, self.places(table)], axis=1).tobytes(), ">u8").astype(np.uint64)

    def fits(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.minimum(n, m) + 1e-9 >= np.maximum(n, m) * self.similarity


def unpacked(sketch: pa.Array) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(sketch.to_pylist()), np.uint8).reshape(-1, WORDS * 8), axis=1)


def dealt(nodes: DataFrame, tries: Tries, tables: range, whole: bool) -> DataFrame:
    """(place, bucket) of every node in each of the tables, with the node's other columns if ``whole``."""
    extra = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema) if whole else ""
    names = nodes.columns if whole else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = unpacked(batch.column(batch.schema.get_field_index("sketch")))
            for t in tables:
                bucket = (tries.keys(bits, t) >> np.uint64(64 - tries.width)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(bucket), *(batch.columns if whole else [])], ["place", "bucket", *names])

    return nodes.mapInArrow(run, "place int, bucket long" + (", " + extra if whole else ""))


def spanning_edges(n: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indices of the edges of a lightest spanning forest (every component takes its lightest edge, until none is left)."""
    order = np.argsort(weight, kind="stable")
    i, j, root, taken = i[order], j[order], np.arange(n), []
    index = np.arange(len(i))
    while True:
        a, b = root[i[index]], root[j[index]]
        index = index[a != b]
        if not len(index):
            return order[np.concatenate(taken)] if taken else order[:0]
        a, b = root[i[index]], root[j[index]]
        best = np.full(n, len(i))
        np.minimum.at(best, a, index)
        np.minimum.at(best, b, index)
        chosen = np.unique(best[best < len(i)])
        taken.append(chosen)
        x, y = root[i[chosen]], root[j[chosen]]
        while len(x):
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := root[root], root):
                root = up
            x, y = root[i[chosen]], root[j[chosen]]
            x, y = x[x != y], y[x != y]


def bucket_pairs(rows: DataFrame, tries: Tries, forest: bool) -> DataFrame:
    """(x, y, place, bucket) from rows (place, bucket, salt, home, fp, n, sketch, component): forest edges
    of every bucket, or all pairs of different components that no earlier table gives. A node that
    visits other salts than its ``home`` meets the nodes at home there, and other visitors in the
    home of the one with the smaller digest."""
    keys = ["place", "bucket", "salt"]

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        column = lambda n: table[n].combine_chunks()
        place, bucket, salt, home, fp, size, component = (column(n).to_numpy() for n in ("place", "bucket", "salt", "home", "fp", "n", "component"))
        sketch = column("sketch")
        if isinstance(sketch, pa.ChunkedArray):
            sketch = sketch.combine_chunks()
        bits = unpacked(sketch)
        words = np.frombuffer(b"".join(sketch.to_pylist()), np.uint64).reshape(len(bits), WORDS)

        for t in np.unique(place).tolist():
            mine = np.flatnonzero(place == t)
            key = tries.keys(bits[mine], t)
            for s in np.unique(salt[mine]).tolist():
                part = np.flatnonzero(salt[mine] == s)
                order = part[np.argsort(key[part], kind="stable")]
                at = mine[order]
                left, right, apart = [], [], []
                for i, j in trie_pairs(key[order], tries.width, tries.budget):
                    i, j = at[i], at[j]
                    keep = tries.fits(size[i], size[j]) & (component[i] != component[j])
                    i, j = i[keep], j[keep]
                    d = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64)
                    keep = d <= tries.most
                    left.append(i[keep])
                    right.append(j[keep])
                    apart.append(d[keep])
                if not left:
                    continue
                i, j, d = np.concatenate(left), np.concatenate(right), np.concatenate(apart)
                if forest:
                    keep = spanning_edges(len(place), i, j, d)
                else:
                    lesser = np.where(fp[i] < fp[j], home[i], home[j])
                    visiting = (home[i] != s) | (home[j] != s)
                    stays = np.where(visiting & ((home[i] == s) | (home[j] == s)), True, lesser == s)
                    stays &= ~_earlier(tries, bits, i, j, t)
                    keep = np.flatnonzero(stays)
                i, j = i[keep], j[keep]
                x, y = np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j])
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x, y, place[i], bucket[i])], ["x", "y", "place", "bucket"])


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows_ = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows_ += batch.num_rows
            if rows_ < 4 * BUCKET_ROWS:
                continue
            table = pa.Table.from_batches(held)
            own = [table[n].to_numpy() for n in keys]
            whole = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in own]))
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if cut:  # whole buckets go; the last may go on in the next batch
                yield from found(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                rows_ -= cut
        if held:
            yield from found(pa.Table.from_batches(held))

    names = ["place", "bucket", "salt", "home", "fp", "n", "sketch", "component"]
    return rows.select(*names).repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(run, "x long, y long, place int, bucket long")


def _earlier(tries: Tries, bits: np.ndarray, i: np.ndarray, j: np.ndarray, table: int) -> np.ndarray:
    """Whether a table before ``table`` gives a pair too."""
    found = np.zeros(len(i), bool)
    nodes, where = np.unique(np.r_[i, j], return_inverse=True)
    some, (a, b) = bits[nodes], np.split(where, 2)
    for t in range(table):
        key = tries.keys(some, t)
        other = key[a] ^ key[b]
        found |= (other >> np.uint64(64 - tries.width) == 0) & (np.bitwise_count(other) <= tries.budget)
    return found


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets have a Jaccard similarity of at least ``similarity``."""
    a, b = sets.toDF("a", "items_a"), sets.toDF("b", "items_b")
    both = pairs.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("items_a", "items_b"))
    total = F.size("items_a") + F.size("items_b")
    # common / (total - common) >= similarity, without the rounding of a quotient at the border
    return both.filter(common * (1 + similarity) + 1e-9 >= total * similarity).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component_id) of every row of ``docs``; component_id is the component's smallest id."""
    spark = docs.sparkSession
    prints = persist_table(sketches(docs, id_col, text_col, shingle), "sketches")
    known = prints.filter("id is not null")
    nodes = persist_table(known.groupBy("fp").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("id").alias("id")), "nodes")
    tries = Tries(nodes.count(), similarity)
    rounds = [range(t, min(t + ROUND, tries.tables)) for t in range(0, tries.tables, ROUND)]
    home = F.pmod(F.xxhash64("fp"), F.coalesce("salts", F.lit(1))).cast("int")

    def judged(pairs: DataFrame) -> DataFrame:
        """Those that are similar; the sets are made anew from the texts of their documents."""
        ends = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
        ids = nodes.join(ends, "fp", "left_semi").select(F.col("id").alias(id_col)).distinct()
        sets = persist_table(shingle_sets(docs.join(ids, id_col, "left_semi"), text_col, shingle), "sets")
        good = persist_table(verified(pairs, sets, similarity), "links")
        drop_tables(spark, sets)
        return good

    salts, first = [], []
    for tables in rounds:
        many = dealt(nodes.select("sketch"), tries, tables, whole=False).groupBy("place", "bucket").count().filter(F.col("count") > BUCKET_ROWS)
        salts.append(persist_table(many.select("place", "bucket", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("salts")), "salts"))
        rows = dealt(nodes.select("fp", "n", "sketch"), tries, tables, whole=True).withColumn("component", F.col("fp"))
        rows = rows.join(salts[-1], ["place", "bucket"], "left").withColumn("home", home).withColumn("salt", F.col("home"))
        first.append(persist_table(bucket_pairs(rows, tries, forest=True), "pairs"))
    first = reduce(DataFrame.unionByName, first)
    pairs = first.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    # an id on rows with different sets ties these together, as it is one document
    repeated = known.groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi")
    ties = known.join(repeated, "id").select(F.col("fp").alias("a"), F.col("lo").alias("b")).filter("a <> b").distinct()
    edges = judged(pairs)
    failed = first.join(edges.toDF("x", "y"), ["x", "y"], "left_anti").select("place", "bucket").distinct()
    # forests of a dealt bucket say nothing of pairs between its salts
    failed = persist_table(reduce(DataFrame.unionByName, [s.select("place", "bucket") for s in salts], failed).distinct(), "failed")
    found = persist_table(components(edges.union(ties)), "components")
    if not failed.isEmpty():
        more = []
        for tables, own in zip(rounds, salts, strict=True):
            again = dealt(nodes.select("fp", "n", "sketch"), tries, tables, whole=True).join(failed, ["place", "bucket"]).join(found.toDF("fp", "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
            again = again.join(own, ["place", "bucket"], "left").withColumn("home", home)
            # only buckets with salts are looked at for their largest component
            sizes = again.filter("salts is not null").groupBy("place", "bucket", "component").count()
            main = sizes.groupBy("place", "bucket").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
            again = again.join(main, ["place", "bucket"], "left")
            stays = F.col("salts").isNull() | (F.col("component") == F.col("main"))
            every = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
            again = again.withColumn("salt", F.explode(F.when(stays, F.array("home")).otherwise(every)))
            more.append(persist_table(bucket_pairs(again, tries, forest=False), "pairs"))
        rest = reduce(DataFrame.unionByName, more).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
        found = components(edges.union(judged(persist_table(rest, "pairs"))).union(ties))
    classes = prints.select("id", "fp").join(found.toDF("fp", "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = classes.groupBy("component").agg(F.min("id").alias("component_id"))
    return classes.join(least, "component").select("id", F.coalesce("component_id", "id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group stays: that with the smallest id. Rows that repeat an id stay as they are."""
    found = near_duplicates(docs, id_col, text_col, shingle, similarity).filter("id <> component_id").select(F.col("id").alias(id_col)).distinct()
    return docs.join(found, id_col, "left_anti").select(*docs.columns)
