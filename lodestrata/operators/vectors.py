"""Joins of vectors without all pairs: balls round pivots, triangle-inequality bounds, exact verification.

**Balls.** A bounded sample of the vectors are pivots; each vector is at home with its nearest one. If x is at
home with p and y with q, and they are within r of each other, then d(x, q) <= d(x, p) + 2 r, as y is no
farther from q than from p. So x visits only the balls that satisfy this, and of two homes the one with the
smaller number visits. A ball with more than ``BALL`` vectors gets pivots of its own, level by level; one that
is still larger (vectors that are all alike) is dealt into blocks of about ``GRID * BALL``, to each of which its
visitors go. A ball with more than ``VISITS`` visitors is copied, and each copy takes its share of them.

**Vectors without structure.** Balls that rule out little would send every vector to nearly all of them. How many
one visits is measured on a bounded sample; where blocks of all vectors take fewer visits than balls, there are
no balls, and every vector goes to each block (``_gridded``). The number of blocks is the table's size over ``GRID * BALL``.

**Tasks.** The rows of a block come sorted, those at home first: a task holds the homes of one block and an
Arrow batch of visitors, and compares them by one matrix product. Which pivots are drawn, and how balls
are cut, decides how much is compared and never what is found. Products within ``CLOSE`` of the
threshold are summed again from left to right, as the SQL functions do, so borders are theirs.

**Inner products.** d is the Euclidean distance, and a product of at least t means d^2 <= |x|^2 + |y|^2 - 2 t, so
r comes from the greatest norms. Unit vectors give the usual angle bound; with one very long vector the bounds
are weak, and the result the same.

Rows with a null id, and vectors that are null, or hold null or non-finite components, take no part; all must have one dimension.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.views import checkpoints

#: Vectors of a ball, pivots of a level and of a ball below it, levels, and visitors that one task compares.
BALL, PIVOTS, SUB_PIVOTS, LEVELS, VISITS = 2048, 1024, 32, 3, 200_000
CLOSE = 1e-9
#: Balls in one block of a large ball, visits up to which balls are always used, and vectors whose visits are counted.
GRID, FEW_VISITS, TRIED = 8, 16, 2048
#: Rows of a matrix product.
ROWS = 512
#: Numbers of the references that go to every task as they are (a block of 64 dimensions, 8 MB).
FEW_NUMBERS = 1 << 20
#: Products that are held at once.
MOST = 1 << 22


def usable(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose vector takes part, as doubles."""
    v = F.col(name).cast("array<double>")
    fine = F.col(name).isNotNull() & (F.size(name) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(fine).withColumn(name, v)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _apart(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of two matrices."""
    squares = (x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * (x @ p.T)
    return np.sqrt(np.maximum(squares, 0))


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices, each summed from left to right."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k] * y[:, k]
    return total


# ---------------------------------------------------------------- balls


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` vectors, those with the smallest hashes: the same ones in every run."""
    found = rows.select("v").orderBy(F.xxhash64("v")).limit(most).collect()
    return np.unique(np.array([r["v"] for r in found], np.float64), axis=0) if found else np.empty((0, 0))


def _dealt(rows: DataFrame, pivots: dict[int, np.ndarray], reach: float, one_sided: bool) -> DataFrame:
    """Rows (ball, home, id, tag, v) of the balls in ``pivots``, dealt to the balls below them: ``ball`` becomes
    ball * PIVOTS + the pivot's number. Rows at home elsewhere keep away from balls they cannot reach."""
    names = rows.columns
    at = {n: names.index(n) for n in ("ball", "home", "v")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            balls, homes = np.asarray(batch.column(at["ball"])), batch.column(at["home"]).to_numpy(zero_copy_only=False)
            for ball in np.unique(balls).tolist():
                own = np.flatnonzero(balls == ball)
                if ball not in pivots:
                    # a ball of its own: it goes down as it is
                    yield _taken(batch, own, np.full(len(own), ball * PIVOTS), homes[own])
                    continue
                for k in range(0, len(own), ROWS):
                    some = own[k : k + ROWS]
                    apart = _apart(_matrix(batch.column(at["v"]).take(pa.array(some))), pivots[ball])
                    nearest = apart.argmin(1)
                    close = apart <= apart.min(1)[:, None] + reach + CLOSE
                    home = homes[some]
                    if not one_sided:  # of two homes the one with the smaller number visits
                        close &= ~home[:, None] | (np.arange(apart.shape[1]) >= nearest[:, None])
                    else:
                        close &= ~home[:, None]
                    close[np.flatnonzero(home), nearest[home]] = True
                    i, q = np.nonzero(close)
                    yield _taken(batch, some[i], ball * PIVOTS + q, home[i] & (q == nearest[i]))

    def _taken(batch: pa.RecordBatch, rows_: np.ndarray, ball: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        part = batch.take(pa.array(rows_))
        columns = [pa.array(ball.astype(np.int64)) if n == "ball" else pa.array(home) if n == "home" else part.column(k) for k, n in enumerate(names)]
        return pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, rows.schema)


def _gridded(visits: float, n: int) -> bool:
    """Whether blocks of all ``n`` vectors take fewer visits than the balls, of which each vector visits ``visits``."""
    return visits > max(FEW_VISITS, -(-n // (GRID * BALL)))


def _levels(rows: DataFrame, reach: float, one_sided: bool) -> tuple[DataFrame, dict[int, int]]:
    """Rows dealt to balls, and the number of homes of the balls that are larger than ``BALL``."""
    checkpoints(rows.sparkSession)
    n = rows.filter("home").count()
    if n <= BALL:
        return rows, {}
    pivots = {0: _sample(rows.filter("home"), min(PIVOTS, 2 * -(-n // BALL) + int(n**0.5) // 8))}
    apart = _apart(_sample(rows, TRIED), pivots[0])
    if _gridded(float((apart <= apart.min(1)[:, None] + reach).sum(1).mean()) / (1 if one_sided else 2), n):
        return rows, {0: n}
    for level in range(LEVELS):
        rows = _dealt(rows, pivots, reach, one_sided).checkpoint()
        sizes = {r["ball"]: r["n"] for r in rows.filter("home").groupBy("ball").agg(F.count("*").alias("n")).filter(F.col("n") > BALL).collect()}  # balls over the bound only
        if not sizes or level == LEVELS - 1:
            return rows, sizes
        drawn = Window.partitionBy("ball").orderBy(F.xxhash64("v"))
        some = rows.filter(F.col("home") & F.col("ball").isin(list(sizes))).withColumn("_r", F.row_number().over(drawn)).filter(F.col("_r") <= SUB_PIVOTS)
        pivots = {}
        for r in some.select("ball", "v").collect():  # SUB_PIVOTS rows for each of these balls
            pivots.setdefault(r["ball"], []).append(r["v"])
        pivots = {b: np.unique(np.array(vs, np.float64), axis=0) for b, vs in pivots.items()}
        pivots = {b: vs for b, vs in pivots.items() if len(vs) > 1}
        if not pivots:
            return rows, sizes
    return rows, sizes


def _copies(rows: DataFrame) -> dict[int, int]:
    """Copies of the balls with more than ``VISITS`` visitors."""
    many = rows.filter(~F.col("home")).groupBy("ball").agg(F.count("*").alias("n")).filter(F.col("n") > VISITS)
    return {r["ball"]: -(-r["n"] // VISITS) for r in many.collect()}  # these balls only


def _blocks(rows: DataFrame, large: dict[int, int], one_sided: bool) -> DataFrame:
    """``rows`` with ``block`` and ``copy``: homes of a large ball are dealt over blocks, and others of it go to all
    of them. Where homes meet each other, they visit half of the other blocks, too. Homes are in every copy of a
    ball, visitors in one."""
    many = F.lit(1)
    for ball, n in large.items():
        many = F.when(F.col("ball") == ball, -(-n // (GRID * BALL))).otherwise(many)
    own = F.pmod(F.xxhash64("id", "v"), many.cast("long")).cast("int")
    rows = rows.withColumns({"_many": many, "_own": own})
    later = F.sequence(F.lit(0), F.col("_many") - 1)
    # round the circle of blocks, so that each meets every other once and all have as many visitors
    ahead = lambda b: 2 * F.pmod(b - F.col("_own"), F.col("_many"))
    spread = F.when(F.col("home"), F.array("_own") if one_sided else F.filter(later, lambda b: (ahead(b) < F.col("_many")) | ((ahead(b) == F.col("_many")) & (F.col("_own") < b)))).otherwise(later)
    each = rows.withColumn("block", F.explode(F.when(F.col("_many") == 1, F.array(F.lit(0))).otherwise(spread)))
    each = each.withColumn("home", F.col("home") & (F.col("block") == F.col("_own"))).drop("_many", "_own")
    copies = F.lit(1)
    for ball, n in _copies(rows).items():
        copies = F.when(F.col("ball") == ball, n).otherwise(copies)
    one = F.pmod(F.xxhash64("v", "id"), copies.cast("long")).cast("int")
    return each.withColumn("copy", F.explode(F.when(F.col("home"), F.sequence(F.lit(0), copies - 1)).otherwise(F.array(one))))


def _met(rows: DataFrame, schema: str, compare, one_sided: bool) -> DataFrame:
    """``compare(homes, visitors, same)`` for the homes of every block and batches of its visitors; with ``same``
    they are the homes themselves (in the first copy). Homes and visitors are (ids, tags, matrix)."""
    names = ["ball", "block", "home", "id", "tag", "v", "copy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, homes = None, [], None

        def closed():
            nonlocal homes
            if homes is None:
                homes = _side(pa.Table.from_batches(held).combine_chunks().to_batches()[0]) if held else None
                homes = homes and (*homes, _Forest(len(homes[0])))
                if homes is not None and not one_sided and block[2] == 0:
                    for k in range(0, len(homes[0]), ROWS):
                        yield from compare(homes, tuple(x[k : k + ROWS] for x in homes[:3]), k)

        for batch in batches:
            if not batch.num_rows:
                continue
            balls, blocks, at_home = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            copy = np.asarray(batch.column(6))
            cuts = np.flatnonzero(np.r_[True, (balls[1:] != balls[:-1]) | (blocks[1:] != blocks[:-1]) | (copy[1:] != copy[:-1]) | (at_home[1:] != at_home[:-1])])
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
                if (balls[a], blocks[a], copy[a]) != block:
                    yield from closed()
                    block, held, homes = (balls[a], blocks[a], copy[a]), [], None
                if at_home[a]:
                    held.append(batch.slice(a, b - a))
                    continue
                yield from closed()
                if homes is not None:
                    for k in range(a, b, ROWS):
                        yield from compare(homes, _side(batch.slice(k, min(ROWS, b - k))), None)
        yield from closed()

    dealt = rows.select(*names).repartition("ball", "block", "copy").sortWithinPartitions("ball", "block", "copy", F.desc("home"))
    return dealt.mapInArrow(run, schema)


def _side(batch: pa.RecordBatch) -> tuple:
    return batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(zero_copy_only=False), _matrix(batch.column(5))


def _rows(vectors: DataFrame, home: bool, tag: Column | None = None) -> DataFrame:
    fine = usable(vectors, "v").filter("id is not null")
    return fine.select(F.lit(0).cast("long").alias("ball"), F.lit(home).alias("home"), "id", (F.lit(0).cast("long") if tag is None else tag).alias("tag"), "v")


def _radius(vectors: DataFrame, threshold: float, other: DataFrame | None = None) -> float:
    square = lambda rows: usable(rows, "v").agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0
    one = square(vectors)
    return max(0.0, one + (one if other is None else square(other)) - 2 * threshold) ** 0.5


class _Forest:
    """Which homes of a block are linked by the pairs that were let through."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def new(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of the pairs of homes that link what was not linked; they are then."""
        parent, kept = {}, []

        def root(x: int) -> int:
            while x in parent:
                x = parent[x]
            return x

        for k in np.flatnonzero(self.of[a] != self.of[b]).tolist():
            x, y = root(int(self.of[a[k]])), root(int(self.of[b[k]]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append(k)
        if parent:
            to = np.arange(len(self.of))
            for x in parent:
                to[x] = root(x)
            self.of = to[self.of]
        return np.array(kept, np.int64)


def similar_links(vectors: DataFrame, threshold: float) -> DataFrame:
    """Of ``similar_pairs`` as many as link the same rows: of a block's pairs only those that join what no earlier one
    of the block has joined (a visitor's first pair, and pairs between two groups of homes). A block gives no more
    pairs than it has rows, however many are similar; connected components are those of all pairs."""
    return similar_pairs(vectors, threshold, links=True)


def similar_pairs(vectors: DataFrame, threshold: float, others: DataFrame | None = None, links: bool = False) -> DataFrame:
    """(a, b) of ``vectors`` (id, v) with an inner product of at least ``threshold``: pairs with a < b of rows
    whose ids differ; with ``others`` pairs of a row of ``vectors`` and one of ``others``. For ``links`` see
    ``similar_links``."""
    one_sided = others is not None
    rows = _rows(vectors, not one_sided)
    if one_sided:
        rows = rows.unionByName(_rows(others, True))
    kind = vectors.schema["id"].dataType.simpleString()
    second = others.schema["id"].dataType.simpleString() if one_sided else kind

    def compare(homes: tuple, visitors: tuple, same: int | None) -> Iterator[pa.RecordBatch]:
        dots = visitors[2] @ homes[2].T
        i, j = np.divmod(np.flatnonzero(dots >= threshold - CLOSE), dots.shape[1])
        if same is not None:  # homes with homes: each pair once
            keep = i + same < j
            i, j = i[keep], j[keep]
        near = np.flatnonzero(np.abs(dots[i, j] - threshold) <= CLOSE)
        out = near[products(visitors[2][i[near]], homes[2][j[near]]) < threshold]
        i, j = np.delete(i, out), np.delete(j, out)
        if links and len(i):
            if same is not None:
                keep = homes[3].new(i + same, j)
            else:
                first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                keep = np.union1d(first, homes[3].new(j[first[np.searchsorted(first, np.arange(len(i)), "right") - 1]], j))
            i, j = i[keep], j[keep]
        a, b = visitors[0][i], homes[0][j]
        if not one_sided:
            a, b = np.where(a < b, a, b), np.where(a < b, b, a)
            a, b = a[a != b], b[a != b]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    placed, large = _levels(rows, 2 * _radius(vectors, threshold, others), one_sided)
    return _met(_blocks(placed, large, one_sided), f"a {kind}, b {second}", compare, one_sided)


def compared_pairs(vectors: DataFrame, threshold: float) -> int:
    """How many pairs ``similar_pairs`` compares."""
    placed, large = _levels(_rows(vectors, True), 2 * _radius(vectors, threshold), False)
    n = _blocks(placed, large, False).groupBy("ball", "block", "copy").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("g"))
    return n.agg(F.sum(F.expr("h * g + if(copy = 0, h * (h - 1) div 2, 0)"))).first()[0] or 0


# ---------------------------------------------------------------- the two best groups of each vector


def best_two(vectors: DataFrame, references: DataFrame, near: int = 4) -> DataFrame:
    """(id, tag, sim) of ``vectors`` (id, v): the two tags of ``references`` (tag, v) whose best reference has the
    largest inner product, ties to the smaller tag. References are at home in balls. First each vector visits its
    ``near`` nearest balls; the second best tag there bounds what another ball must be able to reach (the
    product is at most (|x|^2 + |y|^2 - (d - R)^2) / 2 in a ball of radius R), and only such balls are visited
    then. Where that rules out little, each vector goes to all blocks of references at once. Equal references
    count with their two smallest tags, as no vector can need more."""
    kind, tag_kind = vectors.schema["id"].dataType.simpleString(), references.schema["tag"].dataType.simpleString()
    refs = usable(references, "v").select(F.lit(0).cast("long").alias("id"), "tag", "v").distinct()
    refs = refs.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("tag"))).filter("_r <= 2").drop("_r")
    own = usable(vectors, "v").select("id", F.lit(None).cast(tag_kind).alias("tag"), "v")
    long = refs.select(F.size("v")).first()
    most = max(BALL, min(GRID * BALL, FEW_NUMBERS // long[0])) if long else BALL
    few = refs.limit(most + 1).collect()
    if 0 < len(few) <= most:  # so few that they go to every task as they are, and no vector is shuffled
        found = pa.array([r["tag"] for r in few], to_arrow_type(references.schema["tag"].dataType)).to_numpy(zero_copy_only=False), np.array([r["v"] for r in few], np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, ROWS):
                    part = batch.slice(k, ROWS)
                    yield from _two(found[0], found[1], part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1)))

        return two_best(own.select("id", "v").mapInArrow(run, f"id {kind}, tag {tag_kind}, sim double"))
    checkpoints(refs.sparkSession)
    refs = refs.checkpoint()
    n = refs.count()
    pivots = _sample(refs, min(PIVOTS, max(1, 2 * -(-n // BALL) + int(n**0.5) // 4))) if n else np.empty((0, 0))
    if not len(pivots):
        return own.limit(0).select("id", "tag", F.lit(0.0).alias("sim"))
    homes = _nearest(refs, pivots).checkpoint()
    sizes = {r["ball"]: r for r in homes.groupBy("ball").agg(F.max("apart").alias("radius"), F.count("*").alias("n"), F.max("square").alias("square")).collect()}  # a row for each pivot
    radius = np.array([sizes[b]["radius"] if b in sizes else -np.inf for b in range(len(pivots))])
    square = np.array([sizes[b]["square"] if b in sizes else 0.0 for b in range(len(pivots))])
    large = {b: r["n"] for b, r in sizes.items() if r["n"] > BALL}
    dealt = homes.select("ball", F.lit(True).alias("home"), F.lit(None).cast(kind).alias("id"), "tag", "v")

    def compare(found: tuple, visitors: tuple, same: int | None) -> Iterator[pa.RecordBatch]:
        yield from _two(found[1], found[2], visitors[0], visitors[2])

    def met(at_home: DataFrame, visits: DataFrame, sizes: dict[int, int]) -> DataFrame:
        rows = at_home.unionByName(visits.select("ball", F.lit(False).alias("home"), "id", "tag", "v"))
        return two_best(_met(_blocks(rows, sizes, True), f"id {kind}, tag {tag_kind}, sim double", compare, True))

    first = met(dealt, _visiting(own, pivots, radius, square, near), large).checkpoint()
    bound = first.groupBy("id").agg(F.when(F.count("*") > 1, F.min("sim")).alias("least"))
    rest = own.join(bound, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    some = rest.select("v", "least").orderBy(F.xxhash64("v")).limit(TRIED).collect()
    x, least = np.array([r["v"] for r in some], np.float64).reshape(len(some), -1), np.array([r["least"] for r in some])
    if len(some) and _gridded(float(_within(x, least, pivots, radius, square).sum(1).mean()), n):
        return met(dealt.withColumn("ball", F.lit(0).cast("long")), own.withColumn("ball", F.lit(0).cast("long")), {0: n})
    second = met(dealt, _visiting(rest, pivots, radius, square, near, later=True), large)
    return two_best(first.unionByName(second))


def _two(names: np.ndarray, known: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, tag, sim) of the two best tags of each row of ``x``, ties to the smaller tag."""
    if not len(x):
        return
    if len(x) > 1 and len(x) * len(known) > MOST:
        for part in (slice(0, len(x) // 2), slice(len(x) // 2, None)):
            yield from _two(names, known, ids[part], x[part])
        return
    tags, place = np.unique(names, return_inverse=True)
    order = np.argsort(place, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(place[order]) > 0])
    dots = x @ known[order].T
    best = np.maximum.reduceat(dots, starts, axis=1)
    least = best.min(1) if best.shape[1] < 2 else -np.partition(-best, 1, axis=1)[:, 1]
    # summed again from left to right, as a matrix product rounds in an order of its own
    i, j = np.nonzero(dots >= least[:, None] - CLOSE)
    exact, tag = products(x[i], known[order][j]), place[order][j]
    by = np.lexsort((-exact, tag, i))
    first = by[np.flatnonzero(np.r_[True, (np.diff(i[by]) > 0) | (np.diff(tag[by]) != 0)])]
    first = first[np.lexsort((tag[first], -exact[first], i[first]))]
    of = i[first]
    first = first[np.r_[True, True, of[2:] != of[:-2]][: len(of)]]
    yield pa.RecordBatch.from_arrays([pa.array(ids[i[first]]), pa.array(tags[tag[first]]), pa.array(exact[first])], ["id", "tag", "sim"])


def two_best(sims: DataFrame) -> DataFrame:
    """The two rows of each id with the largest ``sim`` of different tags, ties to the smaller tag."""
    each = sims.groupBy("id", "tag").agg(F.max("sim").alias("sim"))
    return each.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "tag"))).filter("_r <= 2").drop("_r")


def _nearest(refs: DataFrame, pivots: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                x = _matrix(part.column(2))
                apart = _apart(x, pivots)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(apart.argmin(1)), pa.array(apart.min(1)), pa.array((x * x).sum(1))], ["id", "tag", "v", "ball", "apart", "square"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in refs.schema)
    return refs.select("id", "tag", "v").mapInArrow(run, f"{fields}, ball long, apart double, square double")


def _within(x: np.ndarray, least: np.ndarray, pivots: np.ndarray, radius: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Whether each ball can hold a product of at least ``least`` with each row of ``x``."""
    over = np.maximum(_apart(x, pivots) - radius, 0)
    return (radius >= 0) & (((x * x).sum(1)[:, None] + square - over * over) / 2 >= least[:, None] - CLOSE)


def _visiting(rows: DataFrame, pivots: np.ndarray, radius: np.ndarray, square: np.ndarray, near: int, later: bool = False) -> DataFrame:
    """``rows`` for every ball that they visit: the ``near`` nearest ones, or ``later`` the others that can hold a
    product of at least ``least``."""
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "least")
    names = [c for c in ("id", "tag", "v") if c in rows.columns]
    full = np.flatnonzero(radius >= 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                x = _matrix(part.column(2))
                apart = _apart(x, pivots[full])
                place = np.argsort(np.argsort(apart, axis=1, kind="stable"), axis=1)
                if later:
                    least = np.asarray(part.column(3))
                    visits = (place >= near) & _within(x, least, pivots[full], radius[full], square[full])
                else:
                    visits = place < near
                i, q = np.nonzero(visits)
                taken = part.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*taken.columns[:3], pa.array(full[q].astype(np.int64))], [*names, "ball"])

    columns = [*names, "least"] if later else names
    return rows.select(*columns).mapInArrow(run, f"{kind}, ball long")
