"""Approximate nearest neighbours over shifted space-filling curves.

Nearness is the largest inner product. Equal vectors fold into one (with its ``k + 1`` smallest ids,
as no query can need more), and vectors are dealt into strata by length and norm (a factor of 2
each): within a stratum the nearest directions have the largest products. A query looks into every
stratum of its length.

Each of ``curves`` orderings projects the directions on ``dims`` random orthogonal axes, shifts and
quantises the projections and takes the Hilbert index as key. Spark range-partitions the rows by
(stratum, ordering, key); partition counts turn places in a partition into places in the whole
order, and the order is cut into blocks of ``BLOCK_ROWS`` vectors. A query travels to the blocks that
its window, the ``reach`` vectors on either side of its place, touches; so a window crosses partition
and block borders, and a task holds one block whatever the size of the table, the number of queries
in it or the number of equal vectors. Work and traffic grow in proportion to the table:
``2 * curves * reach`` pairs a query and stratum.

Within a cell the order goes by the ordering's first projection, so that vectors of one cell (a tight cluster)
stand in another order in each of the orderings. Windows are screened on directions rounded to 16 bits, which is
all that travels with the keys; the best of all windows merge and are ranked by the exact inner product of the
original vectors.

**Recall is measured.** ``TRIED`` of the queries, those with the smallest hashes, are compared with all vectors. While
their windows have less than ``GOAL`` of their nearest, ``reach`` grows fourfold and the number of candidates twofold,
for all queries, in the same orderings; at the latest when a window is the whole table it ends.

Only the borders of the cells are fitted, on a sample of about ``SAMPLE_ROWS`` vectors (those with the
smallest hashes; a stratum with hardly any in it takes the borders of the normal distribution);
every vector is indexed.

Defined results: vectors that are null, zero or hold null or non-finite components take no part;
vectors of another length than the query's are not its candidates, nor are rows with its id; of
repeated ids the best score counts; ties go to the smaller id; null ids take no part; a query
without candidates has no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import persist_table

CURVES, DIMS, BITS, REACH, K = 40, 10, 2, 448, 20
#: Candidates kept beyond the k + 1 best, as the screen's scores are rounded.
SPARE = 8
#: Queries whose recall is measured, and the recall that they must have: 0.9 and more than three standard errors of such a sample.
TRIED, GOAL = 100, 0.93
SAMPLE_ROWS, LEAST_SAMPLE, BLOCK_ROWS, QUERY_ROWS, SEED = 20_000, 200, 4_096, 4_096, 20_240_601
PLACED = "g int, c int, key long, asks boolean, rid long, code binary, scale float, weight double"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points, one row each, ``bits`` per dimension (bits * dims <= 63)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # undo the rotations and reflections from the coarsest cell down
        side = 1 << level
        for d in range(dims):
            high = (x[d] & side) != 0
            x[0] = np.where(high, x[0] ^ (side - 1), x[0])
            swap = np.where(high, 0, (x[0] ^ x[d]) & (side - 1))
            x[0] ^= swap
            x[d] ^= swap
    for d in range(1, dims):  # Gray code
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[dims - 1] & (1 << level), turn ^ ((1 << level) - 1), turn)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[d] >> level & 1)
    return key


class Orderings:
    """Axes, shifts and cell borders of all curves for directions of one length."""

    def __init__(self, width: int, sample: np.ndarray, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, seed: int = SEED):
        rng = np.random.default_rng([seed, width])
        self.bits, dims = bits, min(dims, width)
        self.axes, self.borders = [], []
        for _ in range(curves):
            axes = np.linalg.qr(rng.normal(size=(width, dims)))[0]
            shares = (np.arange(1, 1 << bits)[:, None] + rng.uniform(-0.25, 0.25, dims)) / (1 << bits)
            if len(sample):
                y = np.sort(sample @ axes, axis=0)
                borders = np.stack([np.quantile(y[:, d], shares[:, d]) for d in range(dims)], 1)
            else:
                borders = _normal_quantile(shares) / math.sqrt(width)
            self.axes.append(axes)
            self.borders.append(borders)

    def keys(self, ways: np.ndarray, curve: int) -> np.ndarray:
        y = ways @ self.axes[curve]
        cells = np.stack([np.searchsorted(self.borders[curve][:, d], y[:, d]) for d in range(y.shape[1])], 1)
        return hilbert_keys(cells, self.bits)

    def places(self, ways: np.ndarray, curve: int) -> np.ndarray:
        """Keys, and within a key the first projection, which lies in -1 to 1."""
        free = min(40, 63 - self.bits * self.axes[curve].shape[1])
        fine = np.clip((ways @ self.axes[curve][:, 0] + 1) / 2, 0, 1) * ((1 << free) - 1)
        return self.keys(ways, curve) << free | fine.astype(np.int64)


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    from statistics import NormalDist

    return np.vectorize(NormalDist().inv_cdf)(p)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, v as doubles."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(id_col).isNotNull() & (F.size(v) > 0) & fine).select(F.col(id_col).alias("id"), v.alias("v"))


def log_norm(v: Column) -> Column:
    """Binary logarithm of the norm; no square over- or underflows."""
    most = F.array_max(F.transform(v, F.abs))
    return F.log2(most) + F.log2(F.aggregate(F.transform(v, lambda x: (x / most) * (x / most)), F.lit(0.0), lambda s, x: s + x)) / 2


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def directions(vectors: np.ndarray) -> np.ndarray:
    if not len(vectors):
        return vectors
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def folded(rows: DataFrame, is_query, k: int) -> tuple[DataFrame, DataFrame]:
    """(reps, queries). reps: each distinct vector as (rid, h1, h2, v, ids, asked, width, weight,
    stratum), ids its k + 1 smallest; queries: (id, h1, h2)."""
    keyed = rows.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2"))
    queries = keyed.filter(is_query(F.col("id"))).select("id", "h1", "h2").distinct()
    few = keyed.withColumn("r", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("id"))).filter(F.col("r") <= k + 1)
    one = few.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_set("id")).alias("ids"))
    asked = queries.select("h1", "h2").distinct().withColumn("asked", F.lit(True))
    found = one.join(asked, ["h1", "h2"], "left").withColumn("asked", F.col("asked").isNotNull())
    found = found.select(F.monotonically_increasing_id().alias("rid"), "*", F.size("v").alias("width"), log_norm(F.col("v")).alias("weight"))
    return found.withColumn("stratum", F.floor(F.col("weight") + 0.5).cast("int")), queries


def placed(reps: DataFrame, groups: dict[tuple[int, int], int], orderings: dict[tuple[int, int], Orderings]) -> DataFrame:
    """Rows of ``PLACED``: every vector once an ordering of its own stratum, and every vector that
    asks once an ordering of each stratum of its length. ``g`` numbers the strata."""
    names = [x.split()[0] for x in PLACED.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1_024):
                batch = whole.slice(at, 1_024)
                widths, strata = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                asked, rid, weight = batch.column(4).to_numpy(zero_copy_only=False), batch.column(0).to_numpy(), batch.column(5).to_numpy()
                for width in np.unique(widths).tolist():
                    mine = np.flatnonzero(widths == width)
                    ways = directions(np.array(batch.column(1).take(pa.array(mine)).to_pylist(), np.float64))
                    scale = np.abs(ways).max(axis=1) / 32767
                    code = np.rint(ways / scale[:, None]).astype(np.int16)
                    for (w, stratum), g in groups.items():
                        if w != width:
                            continue
                        own, asks = np.flatnonzero(strata[mine] == stratum), np.flatnonzero(asked[mine])
                        used = np.r_[own, asks]
                        if not len(used):
                            continue
                        which = mine[used]
                        codes = pa.array([x.tobytes() for x in code[used]], pa.binary())
                        fixed = pa.array(rid[which]), codes, pa.array(scale[used].astype(np.float32)), pa.array(weight[which])
                        flag = pa.array(np.arange(len(used)) >= len(own))
                        ordering = orderings[w, stratum]
                        for c in range(len(ordering.axes)):
                            key = ordering.places(ways[used], c)
                            columns = [pa.array(np.full(len(used), x, np.int32)) for x in (g, c)] + [pa.array(key), flag, *fixed]
                            yield pa.RecordBatch.from_arrays(columns, names)

    return reps.select("rid", "v", "width", "stratum", "asked", "weight").mapInArrow(place, PLACED)


def in_order(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` with ``pos``, the number of vectors before a row in the order of (g, c, key, rid)."""
    order = ["g", "c", "key", "asks", "rid"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            vector = ~batch.column(3).to_numpy(zero_copy_only=False)
            before = seen + np.cumsum(vector) - vector
            seen += int(vector.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(before.astype(np.int64))], [*batch.schema.names, "part", "pos"])

    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = persist_table(ranged.mapInArrow(number, PLACED + ", part int, pos long"), "ordered")
    # one row for each partition, summed up on the driver
    counts = {r.part: r.n for r in numbered.groupBy("part").agg(F.count_if(~F.col("asks")).alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    starts = rows.sparkSession.createDataFrame(starts, "part int, start long")
    return numbered.join(F.broadcast(starts), "part").withColumn("pos", F.col("pos") + F.col("start")).drop("part", "start")


def screened(ordered: DataFrame, salts: dict[int, int], reach: int, keep: int) -> DataFrame:
    """(q, b, rough): the best of every query's windows, by rounded scores."""
    dealt = F.element_at(F.create_map(*[F.lit(x) for pair in salts.items() for x in pair]), F.col("g"))
    block = lambda pos: F.floor(pos / BLOCK_ROWS)
    vectors = ordered.filter(~F.col("asks")).select("*", block(F.col("pos")).alias("block"), F.explode(F.sequence(F.lit(0), dealt - 1)).alias("salt"))
    touched = F.sequence(F.greatest(F.lit(0).cast("long"), block(F.col("pos") - reach)), block(F.col("pos") + reach - 1))
    queries = ordered.filter("asks").select("*", F.explode(touched).alias("block"), F.pmod(F.xxhash64("rid"), dealt).cast("int").alias("salt"))
    keys = ["block", "salt", "asks"]
    met = vectors.unionByName(queries).repartition("block", "salt").sortWithinPartitions(*keys, "pos")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for batch in batches:
            columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            block_, salt, asks = columns["block"].to_numpy(), columns["salt"].to_numpy(), columns["asks"].to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (block_[1:] != block_[:-1]) | (salt[1:] != salt[:-1]) | (asks[1:] != asks[:-1])])
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows], strict=True):
                if (block_[a], salt[a]) != last:
                    last, held = (block_[a], salt[a]), []
                part = _Rows(columns, a, b)
                if not asks[a]:
                    held.append(part)  # at most BLOCK_ROWS vectors, which stand before the queries
                else:
                    for found in _best(held, part, reach, keep):
                        yield found

    return met.select("block", "salt", "asks", "pos", "g", "c", "rid", "code", "scale", "weight").mapInArrow(meet, "q long, b long, rough double")


class _Rows:
    """A slice of placed rows, as arrays."""

    def __init__(self, columns: dict[str, pa.Array], a: int, b: int):
        cut = lambda n: columns[n].slice(a, b - a)
        self.codes = cut("code").to_pylist()
        self.order = cut("g").to_numpy().astype(np.int64) << 16 | cut("c").to_numpy()
        self.pos, self.rid, self.scale, self.weight = (cut(n).to_numpy() for n in ("pos", "rid", "scale", "weight"))


def _best(held: list[_Rows], asked: _Rows, reach: int, keep: int) -> Iterator[pa.RecordBatch]:
    for order in np.unique(asked.order).tolist():
        base = [(np.flatnonzero(h.order == order), h) for h in held]
        codes = [h.codes[k] for at, h in base for k in at.tolist()]
        if not codes:
            continue
        gather = lambda n: np.concatenate([getattr(h, n)[at] for at, h in base])  # noqa: B023,E731
        pos, rid, weight = gather("pos"), gather("rid"), gather("weight")
        matrix = np.frombuffer(b"".join(codes), np.int16).reshape(len(codes), -1).astype(np.float32) * gather("scale")[:, None]
        # the norms of a stratum lie within a factor of 2, so they scale without overflow
        norms = np.exp2(weight - weight.max())
        mine = np.flatnonzero(asked.order == order)
        for at in range(0, len(mine), 256):
            some = mine[at : at + 256]
            queries = np.frombuffer(b"".join(asked.codes[k] for k in some.tolist()), np.int16).reshape(len(some), -1).astype(np.float32) * asked.scale[some, None]
            rough = (queries @ matrix.T) * norms
            here = asked.pos[some, None]
            rough[(pos < here - reach) | (pos >= here + reach)] = -np.inf
            if len(codes) > keep:
                best = np.argpartition(-rough, keep - 1, axis=1)[:, :keep]
            else:
                best = np.broadcast_to(np.arange(len(codes)), rough.shape)
            score = np.take_along_axis(rough, best, 1)
            row, column = np.nonzero(score > -np.inf)
            # over all strata: rough scores of one query compare on its own scale
            value = score[row, column].astype(np.float64) * np.exp2(np.clip(weight.max(), -1000, 1000))
            yield pa.RecordBatch.from_arrays([pa.array(asked.rid[some][row]), pa.array(rid[best[row, column]]), pa.array(value)], ["q", "b", "rough"])


def candidate_pairs(reps: DataFrame, k: int = K, curves: int = CURVES, dims: int = DIMS, reach: int = REACH) -> DataFrame:
    """(q, b): for every vector that asks the k + 1 + SPARE likeliest of its windows, as rids."""
    spark = reps.sparkSession
    sizes = reps.groupBy("width", "stratum").agg(F.count("*").alias("n"), F.count_if("asked").alias("asked")).collect()
    sizes.sort(key=lambda r: (r.width, r.stratum))
    total, asked = sum(r.n for r in sizes), {}
    for r in sizes:
        asked[r.width] = asked.get(r.width, 0) + r.asked
    groups = {(r.width, r.stratum): g for g, r in enumerate(sizes)}
    share = min(1.0, SAMPLE_ROWS / max(1, total))
    chosen = F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    samples: dict[tuple[int, int], list] = {}
    for r in reps.filter(chosen).select("width", "stratum", "v").limit(2 * SAMPLE_ROWS).collect():
        samples.setdefault((r.width, r.stratum), []).append(r.v)
    few = lambda at: [] if len(samples.get(at, ())) < LEAST_SAMPLE else directions(np.array(samples[at]))
    orderings = {at: Orderings(at[0], few(at), curves, dims) for at in groups}
    # a small stratum that many queries enter has its vectors in several copies, each for a share of them
    salts = {groups[r.width, r.stratum]: max(1, math.ceil(asked[r.width] / max(1, r.n / BLOCK_ROWS) / QUERY_ROWS)) for r in sizes}
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * curves / 1_000_000))
    ordered = in_order(placed(reps, groups, orderings), parts)
    keep, truth = k + 1 + SPARE, nearest_of_some(reps, k + 1)
    while True:
        found = screened(ordered, salts, reach, keep).repartition("q").groupBy("q", "b").agg(F.max("rough").alias("rough"))
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("rough"), "b"))).filter(F.col("r") <= keep).select("q", "b")
        found = persist_table(found, "pairs")
        if (reach >= total and keep >= total) or recall(found, reps, truth) >= GOAL:
            return found
        reach, keep = min(4 * reach, max(reach, total)), min(2 * keep, max(keep, total))


def nearest_of_some(reps: DataFrame, k: int) -> dict[int, tuple[int, float]]:
    """By the rid of ``TRIED`` vectors that ask: how many of the ``k`` nearest there are, and the last one's product,
    from all vectors."""
    some = reps.filter("asked").orderBy(F.xxhash64("h1"), "rid").limit(TRIED).select("rid", "width", "v").collect()
    by: dict[int, list] = {}
    for r in some:
        by.setdefault(r.width, []).append((r.rid, r.v))
    asked = {w: (np.array([x[0] for x in rows]), np.array([x[1] for x in rows], np.float64)) for w, rows in by.items()}

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(0).to_numpy()
            for width in [w for w in np.unique(widths).tolist() if w in asked]:
                rids, queries = asked[width]
                mine = batch.column(1).take(pa.array(np.flatnonzero(widths == width)))
                score = queries @ np.asarray(mine.flatten(), np.float64).reshape(len(mine), -1).T
                score = -np.sort(-score, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rids, score.shape[1])), pa.array(score.ravel())], ["q", "score"])

    each = reps.select("width", "v").mapInArrow(best, "q long, score double")
    first = each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("r") <= k)
    return {r.q: (r.n, r.least) for r in first.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least")).collect()}


def recall(found: DataFrame, reps: DataFrame, truth: dict[int, tuple[int, float]]) -> float:
    """Share of the nearest of the queries of ``truth`` that ``found`` (q, b) holds."""
    if not truth:
        return 1.0
    some = found.filter(F.col("q").isin(list(truth)))
    asked = reps.filter(F.col("rid").isin(list(truth))).select(F.col("rid").alias("q"), F.col("v").alias("qv"))  # TRIED rows
    near = reps.join(F.broadcast(some.join(F.broadcast(asked), "q")), F.col("rid") == F.col("b")).select("q", inner(F.col("qv"), F.col("v")).alias("score")).collect()
    close = lambda n: n - 1e-12 * (1 + abs(n))
    have = {q: 0 for q in truth}
    for r in near:
        have[r.q] += r.score >= close(truth[r.q][1])
    return sum(min(n, truth[q][0]) for q, n in have.items()) / sum(n for n, _ in truth.values())


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, curves: int = CURVES, dims: int = DIMS, reach: int = REACH) -> DataFrame:
    """(query_id, rank, id, score); ``is_query`` is a predicate on the id column, ids are of any type."""
    rows = usable(vectors, id_col, vector_col)
    kind = rows.schema["id"].dataType.simpleString()
    found, queries = folded(rows, is_query, k)
    reps = persist_table(found, "vectors")
    if reps.isEmpty():
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score double")
    pairs = candidate_pairs(reps, k, curves, dims, reach)
    asked = reps.filter("asked").select(F.col("rid").alias("q"), "h1", "h2", F.col("v").alias("qv"))
    others = reps.select(F.col("rid").alias("b"), "v", "ids")
    scored = pairs.join(others, "b").join(asked, "q").select("h1", "h2", "ids", inner(F.col("qv"), F.col("v")).alias("score"))
    lists = scored.select("h1", "h2", "score", F.explode("ids").alias("id"))
    met = queries.withColumnRenamed("id", "query_id").join(_first(lists, k + 1), ["h1", "h2"])
    each = met.select("query_id", F.explode("best").alias("n")).filter(F.col("n.id") != F.col("query_id"))
    each = each.groupBy("query_id", "n.id").agg(F.max("n.score").alias("score"))  # a repeated query id has several vectors
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _first(lists: DataFrame, most: int) -> DataFrame:
    """(h1, h2, best): the ``most`` best ids of each vector that asks; an id counts once, by its best score."""
    once = lists.groupBy("h1", "h2", "id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= most)
    return ranked.groupBy("h1", "h2").agg(F.collect_list(F.struct("score", "id")).alias("best"))


def neighbour_report(vectors: DataFrame) -> DataFrame:
    """The digest of ``op4``."""
    return nearest(vectors, lambda key: key % 20 == 0).withColumnRenamed("id", "vec_id")
