"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are made in Arrow batches from whole texts. Equal fingerprints fold into one node
(represented by the smallest id), and only distinct fingerprints enter the join. By the pigeonhole
rule two fingerprints that differ in at most ``budget`` bits agree in one of ``budget + 1`` blocks,
so every fingerprint goes to one bucket per block; inside a bucket the trie of the remaining bits
joins itself: node pairs descend together, carry the differing bits so far and are cut off when
these exceed the budget. A bucket that holds more than ``bucket_rows`` fingerprints is dealt out
again by blocks of its remaining bits, so buckets of N distinct fingerprints grow as N / 2^42; the trie
prunes inside them, and equal fingerprints never meet there. Each task links what it
found into trees, and a distributed star contraction joins the trees.

Defined results: null, empty and wordless texts have fingerprint zero and link like any other; a
null id is its own smallest id in its group only if no other id is there (nulls count as largest);
rows that repeat an id are one node of the graph per fingerprint and get one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persist_table, text_slices

SHINGLE, SEED, BITS, BUDGET = 3, 42, 64, 2
BUCKET_ROWS = 20_000


def fingerprint(data: memoryview | bytes | None, shingle: int = SHINGLE, lower: bool = True) -> int:
    """Bit b is 1 where over half of the shingles' XXH64 have it set."""
    raw = bytes(data) if data is not None else b""
    words = (raw.lower() if lower else raw).split()
    if not words:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    if len(words) <= shingle:
        return digest(b" ".join(words))
    columns = [words[k:] for k in range(shingle)]
    hashes = np.fromiter(map(digest, map(b" ".join, zip(*columns, strict=False))), np.uint64, len(words) - shingle + 1)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, BITS)
        votes += bits.sum(axis=0, dtype=np.int64)
    ones = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(ones.view("<u8")[0])


def add_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint as signed long) of every row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x, shingle) for x in text_slices(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(make, f"id {kind}, fp long")


def trie_pairs(keys: np.ndarray, fixed: int, budget: int, leaf: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of the sorted distinct 64-bit ``keys`` that agree in their ``fixed`` top
    bits and differ in at most ``budget`` bits. Node pairs are ranges of ``keys``, depth first in
    blocks, so that memory stays bounded."""
    n = len(keys)
    if n < 2:
        return
    stack = [(0, np.array([[0, n, 0, n, 0]], np.int64))]
    ends = lambda lo, hi, depth: lo + _ones_start(keys, lo, hi, depth)
    while stack:
        depth, nodes = stack.pop()
        if len(nodes) > 1 << 16:
            stack += [(depth, nodes[: len(nodes) // 2]), (depth, nodes[len(nodes) // 2 :])]
            continue
        same = nodes[:, 0] == nodes[:, 2]
        size_a, size_b = nodes[:, 1] - nodes[:, 0], nodes[:, 3] - nodes[:, 2]
        small = ((size_a <= leaf) & (size_b <= leaf) & (depth >= fixed)) | (depth == BITS)
        if small.any():
            yield from _leaf_pairs(keys, nodes[small], budget)
        nodes, same = nodes[~small], same[~small]
        if not len(nodes):
            continue
        a0, a1, b0, b1, err = nodes.T
        am = ends(a0, a1, depth)
        bm = np.where(same, am, ends(b0, b1, depth))
        zero = np.stack([a0, am, b0, bm, err], 1)[(am > a0) & (bm > b0) & ~(same & (am - a0 < 2))]
        one = np.stack([am, a1, bm, b1, err], 1)[(a1 > am) & (b1 > bm) & ~(same & (a1 - am < 2))]
        found = [zero, one]
        if depth >= fixed:
            left = np.stack([a0, am, bm, b1, err + 1], 1)[(am > a0) & (b1 > bm) & (err < budget)]
            right = np.stack([am, a1, b0, bm, err + 1], 1)[(a1 > am) & (bm > b0) & (err < budget) & ~same]
            found += [left, right]
        nodes = np.concatenate(found)
        if len(nodes):
            stack.append((depth + 1, nodes))


def _ones_start(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Within each range [lo, hi) of keys with one prefix of ``depth`` bits: how many have bit 0 next."""
    bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
    below = bit | (bit - np.uint64(1))
    first = (keys[lo] & ~below) | bit
    return np.clip(np.searchsorted(keys, first), lo, hi) - lo


def _leaf_pairs(keys: np.ndarray, nodes: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    a0, a1, b0, b1 = nodes.T[:4]
    size = (a1 - a0) * (b1 - b0)
    for part in np.array_split(np.arange(len(nodes)), max(1, int(size.sum()) >> 20)):
        which = np.repeat(part, size[part])
        k = np.arange(len(which)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        wide = (b1 - b0)[which]
        i, j = a0[which] + k // wide, b0[which] + k % wide
        keep = i < j
        i, j = i[keep], j[keep]
        near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
        if near.any():
            yield i[near], j[near]


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Root of each of n nodes after all pairs are linked (minimum hooking with pointer jumping)."""
    parent = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = parent[i], parent[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    return parent


def _blocks(width: int, parts: int) -> list[tuple[int, int]]:
    """(shift, bits) of ``parts`` blocks of a word of ``width`` bits, from the top."""
    cuts = [round(k * width / parts) for k in range(parts + 1)]
    return [(width - b, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def rotated(fp: np.ndarray, block: np.ndarray, parts: int) -> np.ndarray:
    """Fingerprints with their block's bits on top, so that the bucket is a prefix of the trie."""
    out = np.array(fp, np.uint64)
    for k, (shift, bits) in enumerate(_blocks(BITS, parts)):
        up = BITS - shift - bits
        if up:
            at = block == k
            out[at] = (out[at] << np.uint64(up)) | (out[at] >> np.uint64(BITS - up))
    return out


def links(fps: DataFrame, budget: int = BUDGET, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): trees over the distinct fingerprints ``fps(fp, node)`` within ``budget`` bits."""
    parts = budget + 1
    blocks = F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(F.shiftleft("fp", BITS - s - w), BITS - w).alias("value")) for k, (s, w) in enumerate(_blocks(BITS, parts))])
    dealt = fps.select("fp", "node", F.explode(blocks).alias("b")).select("fp", "node", "b.block", "b.value")
    # Beyond bucket_rows, a bucket is dealt out again by the blocks of all 64 bits of a second cut:
    # bits outside the first block differ by at most the budget too, so one of parts pieces agrees.
    full = dealt.groupBy("block", "value").count().filter(F.col("count") > bucket_rows).select("block", "value", F.lit(True).alias("full"))
    dealt = dealt.join(full, ["block", "value"], "left")
    again = []
    for k, (s, w) in enumerate(_blocks(BITS, parts)):
        rest = [b for b in range(BITS - 1, -1, -1) if not s <= b < s + w]
        cuts = [round(x * len(rest) / parts) for x in range(parts + 1)]
        masks = [sum(1 << b for b in rest[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        again.append(F.array(*[F.struct(F.lit(x).alias("sub"), F.col("fp").bitwiseAND(F.lit(m)).alias("deep")) for x, m in enumerate(signed)]))
    one = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("deep")))
    subs = F.when(F.col("full").isNull(), one)
    for k in range(parts):
        subs = subs.when(F.col("block") == k, again[k])
    dealt = dealt.select("fp", "node", "block", "value", F.explode(subs).alias("s")).select("fp", "node", "block", "value", "s.sub", "s.deep")
    kind = fps.schema["node"].dataType.simpleString()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        rows = 0
        for batch in batches:
            held.append(batch.to_pandas())
            rows += batch.num_rows
            if rows >= 4 * bucket_rows:  # whole buckets go; the last may go on in the next batch
                all_ = pd.concat(held)
                last = all_.iloc[-1]
                open_ = (all_["block"] == last["block"]) & (all_["value"] == last["value"]) & (all_["sub"] == last["sub"]) & (all_["deep"] == last["deep"])
                yield _joined(all_[~open_], parts, budget)
                held, rows = [all_[open_]], int(open_.sum())
        if held:
            yield _joined(pd.concat(held), parts, budget)

    keys = ["block", "value", "sub", "deep"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(join, f"a {kind}, b {kind}")


def _joined(rows: pd.DataFrame, parts: int, budget: int) -> pa.RecordBatch:
    a, b = [], []
    for (block, sub), part in rows.groupby(["block", "sub"], sort=False):
        width = _blocks(BITS, parts)[block][1]
        groups = [part] if sub < 0 else [g for _, g in part.groupby(["value", "deep"], sort=False)]
        for group in groups:
            key = rotated(group["fp"].to_numpy().view(np.uint64), np.full(len(group), block), parts)
            order = np.argsort(key)
            node = group["node"].to_numpy()[order]
            root = _forest(len(node), trie_pairs(key[order], width, budget))
            linked = root != np.arange(len(node))
            a.append(node[linked])
            b.append(node[root[linked]])
    none = rows["node"].to_numpy()[:0]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else none) for x in (a, b)], ["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): smallest node that each node of ``edges(a, b)`` reaches.

    Large-star and small-star steps in turn; each round is written to the shared folder, which cuts
    the lineage. Only two numbers a round come to the driver.
    """
    edges = persist_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("m", "a").alias("m"))
        large = both.join(low, both["a"] == low["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(parent, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = persist_table(small.filter("a <> b").distinct(), "edges")
        sums = [x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first() for x in (edges, new)]
        edges = new
        if tuple(sums[0]) == tuple(sums[1]):
            break
    else:
        raise RuntimeError("components: no end after the given rounds")
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, fp, component_id) of every row of ``docs``."""
    prints = persist_table(add_fingerprints(docs, id_col, text_col, shingle), "prints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("node"))
    # An id that stands on rows with different fingerprints ties these together, as it is one document.
    repeated = prints.groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi and id is not null").select("id")
    known = persist_table(nodes.filter("node is not null"), "nodes")
    edges = links(known, budget, bucket_rows)
    ties = prints.join(repeated, "id").join(known, "fp").select(F.col("node").alias("a"), F.col("id").alias("b"))
    found = components(edges.union(ties))
    classes = known.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes, "fp", "left").select("id", "fp", F.coalesce("component_id", "id").alias("component_id"))


def near_duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of ``op8``."""
    found = near_duplicates(docs, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One document of each group stays: that with the smallest id. Rows that repeat an id stay as they are."""
    found = near_duplicates(docs, id_col, text_col, shingle, budget).filter("id <> component_id").select(F.col("id").alias(id_col)).distinct()
    return docs.join(found, id_col, "left_anti").select(*docs.columns)
