"""Exact and near duplicates of files."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_groups(files: DataFrame, key: str = "content_hash") -> DataFrame:
    return files.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("copy_count"), F.min("file_id").alias("first_id"), F.sum("size_bytes").alias("bytes")).filter("copy_count > 1")


def group_members(files: DataFrame, key: str = "content_hash") -> DataFrame:
    """(key, file_id, path, place): the copies of every group of two and more, a row each, in order of id.
    A group may be any share of the files, so its members are rows and not one list."""
    many = exact_groups(files, key).select(key, "first_id")
    place = F.row_number().over(Window.partitionBy(key).orderBy("file_id"))
    return files.select(key, "file_id", "path").join(many, key).select(key, "file_id", "path", place.alias("place"), (F.col("file_id") == F.col("first_id")).alias("is_first"))


def duplicate_of(files: DataFrame, key: str = "content_hash") -> DataFrame:
    """(file_id, duplicate_of_id): null for the first of its content."""
    first = files.groupBy(key).agg(F.min("file_id").alias("first_id"))
    return files.join(first, key).select("file_id", F.when(F.col("first_id") != F.col("file_id"), F.col("first_id")).alias("duplicate_of_id"))


def sign_hash(vector: Column, bits: int = 64) -> Column:
    """Bits of the signs of the first components, as a long."""
    one = lambda i: F.when(F.element_at(vector, i + 1) > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    out = one(0)
    for i in range(1, bits):
        out = out.bitwiseOR(one(i))
    return out


#: Blocks that a hash is cut into where its distance is larger than that.
BLOCKS = 4


def _budgets(distance: int, blocks: int) -> list[int]:
    """Errors allowed in each block: with them one more in every block would be more than ``distance``."""
    return [(distance + 1) // blocks - 1 + (k < (distance + 1) % blocks) for k in range(blocks)]


def _masks(width: int, most: int) -> list[int]:
    """All masks of up to ``most`` of ``width`` bits."""
    return [sum(1 << b for b in some) for n in range(most + 1) for some in combinations(range(width), n)]


def hamming_candidates(hashes: DataFrame, distance: int, bits: int = 64) -> DataFrame:
    """(a, b, distance) of pairs of distinct hashes (a < b, the signed longs) that multi-index hashing meets, each
    once. Hashes are cut into blocks with an error budget each, such that a pair within ``distance`` keeps to the
    budget of one block at least. Both sides change their block within half of it and meet at the same value:
    of the bits in which two blocks differ, the one side changes the lowest, the other those that are left."""
    blocks = min(BLOCKS, distance + 1, bits)
    budgets, cuts = _budgets(distance, blocks), [round(k * bits / blocks) for k in range(blocks + 1)]
    block = lambda h, k: F.shiftrightunsigned(F.shiftleft(h, 64 - cuts[k + 1]), 64 - cuts[k + 1] + cuts[k])
    one = hashes.select("hash").filter("hash is not null").distinct()

    def side(name: str, share) -> DataFrame:
        change = lambda k: lambda m: F.struct(F.lit(k).alias("k"), block(F.col("hash"), k).bitwiseXOR(m).alias("v"), m.alias("m"))
        changed = [F.transform(F.array(*[F.lit(m).cast("long") for m in _masks(cuts[k + 1] - cuts[k], share(budgets[k]))]), change(k)) for k in range(blocks)]
        return one.select(F.col("hash").alias(name), F.explode(F.concat(*changed)).alias("e")).select(name, "e.k", "e.v", F.col("e.m").alias(f"m_{name}"))

    a, b = side("a", lambda e: (e + 1) // 2), side("b", lambda e: e // 2)
    x = F.col("a").bitwiseXOR(F.col("b"))
    lowest = F.col("m_b").bitwiseAND(-F.col("m_b"))
    first = reduce(lambda c, k: F.when(F.col("k") == k, (budgets[k] + 1) // 2).otherwise(c), range(blocks), F.lit(0))
    once = (F.col("m_b") == 0) | ((F.bit_count("m_a") == first) & (F.col("m_a") < lowest))
    # and of the blocks within budget only in the first
    earlier = reduce(lambda c, k: c | ((F.col("k") > k) & (F.bit_count(block(x, k)) <= budgets[k])), range(blocks), F.lit(False))
    met = a.join(b, ["k", "v"]).filter((F.col("a") < F.col("b")) & once & ~earlier)
    return met.select("a", "b", F.bit_count(x).cast("int").alias("distance"))


def hamming_pairs(hashes: DataFrame, distance: int, bits: int = 64, ordered: bool = False) -> DataFrame:
    """(id_a, id_b, distance) of pairs of ``hashes`` (id, hash) within ``distance`` bits, id_a < id_b; ``ordered`` by
    distance, then ids. Equal hashes fold before they are compared. Null hashes are like no other."""
    close = hamming_candidates(hashes, distance, bits).filter(F.col("distance") <= distance)
    rows = hashes.filter("hash is not null")
    a, b = rows.select(F.col("id").alias("id_a"), F.col("hash").alias("a")), rows.select(F.col("id").alias("id_b"), F.col("hash").alias("b"))
    apart = close.join(a, "a").join(b, "b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "distance")
    same = a.join(b, F.col("a") == F.col("b")).filter("id_a < id_b").select("id_a", "id_b", F.lit(0).alias("distance"))
    found = apart.filter("id_a < id_b").unionByName(same)
    return found.orderBy("distance", "id_a", "id_b") if ordered else found
