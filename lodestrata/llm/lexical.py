"""Ranked lexical search by variable block-max WAND, shard by shard.

**Forward rows.** One pass over the whole texts counts, for each document, its terms and how often it holds
the terms that are searched for; the rows (id, length, numbers of terms, occurrences) go to the shared
folder. The collection's size, its terms and the document frequencies are aggregates of these rows. All
documents are in it; terms that no item holds can add to no score and are counted in the length only.

**Shards.** A task reads its forward rows in runs of at most ``SHARD_DOCS`` documents and
``SHARD_POSTINGS`` postings, so its memory does not grow with the table. Of a run it makes posting lists,
and dynamic programming cuts each list into blocks of at most ``WIDEST`` postings such that the error of
the bounds (the sum, over postings, of what the block's maximum is above their own impact) plus a price for
each block is least. It runs over all lists of the shard at once, a position in each list at a time.

**Search.** Between two neighbouring block borders of an item's lists the sum of the block maxima bounds
every document's score. These ranges are the pivots: they are tried from the greatest bound downwards until
the bound is below the item's k-th best score. Of a range's documents only those are scored whose own
lists' block maxima reach that score, and blocks without such ranges are never opened. A document is left
out only if its bound is strictly below the score of k others, so the result is exact, ties by id included.
The k best of an item are carried from shard to shard of a task, so the threshold rises over its whole run.

**Bounds.** Items are a stated query set. Their terms are counted first and go to the tasks in blocks of at
most ``BLOCK_TERMS`` (item, term) pairs (an item's terms stay together), each with a pass of its own over the
texts. A task returns at most k rows an item; these meet under salts first, so no task reads a row from
every other one. Scratch rows are written, not cached, so lost executors cost the tasks they ran.

Defined results: null and empty texts have no terms and are in no result; rows that share a doc_id are
documents of their own; a null doc_id counts as smaller than any other; items that share an id (null
included) are one item with the terms of all; items without terms, and items whose terms no document
holds, give no row; a term that every document holds may weigh 0 and then adds nothing; equal scores go by
doc_id; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import persist_table, text_slices

SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 1 << 22
#: Postings of a block at most, and the price of a block in postings of the list's mean impact.
WIDEST, BLOCK_PRICE = 64, 6.0
BLOCK_TERMS = 200_000
#: Bytes of a text that are split into words at once.
SLICE = 1 << 20
SALTS = 64
FIRST_DOCS = 128
NO_ID = -(1 << 63)
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A-Z to a-z; ASCII signs that are neither letters nor digits to a space; all other bytes stay.
_TO_WORDS = bytes(ord(chr(b).lower()) if b >= 128 or chr(b).isalnum() and b < 128 else 32 for b in range(128)) + bytes(range(128, 256))


def terms_of(text: Column) -> Column:
    """The terms of a text with repeats, as a Column."""
    return F.regexp_extract_all(F.translate(text, CAPITALS, SMALL), F.lit(f"({TERM})"), F.lit(1))


def term_counts(text: bytes | memoryview) -> tuple[int, Counter]:
    """Terms of a whole text in UTF-8, with and without repeats; long ones in slices that end at a border."""
    whole = bytes(text).translate(_TO_WORDS)
    if len(whole) <= SLICE:
        words = whole.split()
        return len(words), Counter(words)
    n, counts, at = 0, Counter(), 0
    while at < len(whole):
        end = whole.find(b" ", at + SLICE)
        words = whole[at : len(whole) if end < 0 else end].split()
        n += len(words)
        counts.update(words)
        at = len(whole) if end < 0 else end
    return n, counts


FORWARD = "doc_id long, n long, terms array<int>, tfs array<int>"


def forward_rows(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(FORWARD) of the documents with terms: all terms counted, those in ``terms`` by their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, numbers, times, ends = [], [], [], [], [0]
            for doc_id, text in zip(batch.column(0).to_pylist(), text_slices(batch.column(1)), strict=True):
                if text is None:
                    continue
                n, counts = term_counts(text)
                if not n:
                    continue
                ids.append(NO_ID if doc_id is None else doc_id)
                lengths.append(n)
                for word in counts.keys() & terms.keys() if len(counts) > len(terms) else counts:
                    number = terms.get(word)
                    if number is not None:
                        numbers.append(number)
                        times.append(counts[word])
                ends.append(len(numbers))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.asarray(x, np.int32))) for x in (numbers, times)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FORWARD)


# ---------------------------------------------------------------- one shard


def block_starts(impacts: np.ndarray, offsets: np.ndarray, widest: int = WIDEST, price: float = BLOCK_PRICE) -> np.ndarray:
    """Where the blocks of lists begin (places in ``impacts``; list t is ``offsets[t]:offsets[t + 1]``), so
    that the error of the blocks' maxima plus ``price`` mean impacts for each block is least for every list.

    best[j] = min over l of best[j - l] + l * max(impacts of the last l) + price, for all lists in step: a
    row for each list that has a j-th posting, a column for each l."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    first, size = offsets[order], sizes[order]
    taken = np.zeros(len(impacts), np.uint8)
    if not len(order):
        return np.empty(0, np.int64)
    total = np.add.reduceat(impacts, np.sort(first)).astype(np.float64)[np.argsort(np.argsort(first))]
    fee = price * total / size
    widths = np.arange(1, widest + 1, dtype=np.float64)
    before = np.full((len(order), widest), np.inf)  # best[j - 1], best[j - 2], ...
    before[:, 0] = 0
    highest = np.zeros((len(order), widest))
    alive = len(order)
    for j in range(int(size[0])):
        while size[alive - 1] <= j:
            alive -= 1
        now = impacts[first[:alive] + j].astype(np.float64)[:, None]
        high, past = highest[:alive], before[:alive]
        high[:, 1:] = np.maximum(high[:, :-1], now)
        high[:, :1] = now
        cost = past + high * widths
        least = cost.argmin(axis=1)
        taken[first[:alive] + j] = least + 1
        past[:, 1:] = past[:, :-1]
        past[:, 0] = cost[np.arange(alive), least] + fee[:alive]
    starts = np.zeros(len(impacts), bool)
    at = first + size
    while len(at):
        at = at - taken[at - 1]
        starts[at] = True
        more = at > first
        at, first = at[more], first[more]
    return np.flatnonzero(starts)


class Shard:
    """Posting lists of a run of documents, in blocks with their greatest impact."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, docs: np.ndarray, tfs: np.ndarray, n_terms: int, n_docs: int, n_words: int, widest: int = WIDEST, price: float = BLOCK_PRICE):
        self.ids, self.m = ids, 50 + 50 * lengths * n_docs // n_words
        order = np.argsort(terms, kind="stable")  # documents stay in order within a list
        self.docs, self.tfs = docs[order], tfs[order].astype(np.int64)
        self.offsets = np.r_[0, np.cumsum(np.bincount(terms, minlength=n_terms))]
        impacts = self.impact(np.arange(len(self.docs)))
        self.starts = block_starts(impacts, self.offsets, widest, price)
        self.ends = np.r_[self.starts[1:], len(self.docs)] if len(self.starts) else self.starts
        self.high = np.maximum.reduceat(impacts, self.starts) if len(self.starts) else self.starts
        self.block_offsets = np.searchsorted(self.starts, self.offsets)
        self.opened = self.blocks = self.scored = 0  # what searches have done, for tests and reports

    def impact(self, places: np.ndarray) -> np.ndarray:
        tf = self.tfs[places]
        return 1_000_000_000 * tf // (1000 * tf + 20 * self.m[self.docs[places]])

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of those given and the shard's, best first, ties by id."""
        counts = self.block_offsets[terms + 1] - self.block_offsets[terms]
        blocks = _runs(self.block_offsets[terms], counts)
        weight = np.repeat(weights, counts)
        bound = weight * self.high[blocks]
        blocks, weight, bound = (x[bound > 0] for x in (blocks, weight, bound))
        self.blocks += len(blocks)
        ever = np.zeros(len(blocks), bool)
        if not len(blocks):
            return scores, ids
        low, top = self.docs[self.starts[blocks]].astype(np.int64), self.docs[self.ends[blocks] - 1].astype(np.int64)
        size = len(self.ids)
        step = np.bincount(low, bound, size + 1) - np.bincount(top + 1, bound, size + 1)  # exact below 2^53
        borders = np.flatnonzero(step)
        limit = np.cumsum(step[borders])
        width = np.diff(np.r_[borders, size])
        pivots = np.argsort(-limit, kind="stable")
        pivots = pivots[limit[pivots] > 0]
        at, want = 0, FIRST_DOCS
        done = np.cumsum(width[pivots])
        while at < len(pivots):
            threshold = scores[k - 1] if len(scores) >= k else 1
            if limit[pivots[at]] < threshold:
                break
            stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + want, "right")))
            some = pivots[at:stop]
            some = some[limit[some] >= threshold]
            at, want = stop, want * 2
            inside = np.zeros(size + 1, bool)
            inside[_runs(borders[some], width[some])] = True
            before = np.r_[0, np.cumsum(inside)]
            opened = np.flatnonzero(before[top + 1] > before[low])
            ever[opened] = True
            n = self.ends[blocks[opened]] - self.starts[blocks[opened]]
            places = _runs(self.starts[blocks[opened]], n)
            own = np.repeat(opened, n)
            docs = self.docs[places]
            met = inside[docs]
            places, own, docs = places[met], own[met], docs[met]
            # a document's own lists must be able to reach the threshold
            reach = np.bincount(docs, bound[own], size) >= threshold
            met = reach[docs]
            places, own, docs = places[met], own[met], docs[met]
            exact = np.bincount(docs, weight[own] * self.impact(places), size).astype(np.int64)
            found = np.flatnonzero(exact >= threshold)
            self.scored += int(reach.sum())
            scores, ids = _top(np.r_[scores, exact[found]], np.r_[ids, self.ids[found]], k)
        self.opened += int(ever.sum())
        return scores, ids


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _shards(batches: Iterator[pa.RecordBatch], n_docs: int, n_postings: int) -> Iterator[tuple]:
    """Runs of forward rows within the bounds (a row always fits), as arrays."""
    held, docs, postings = [], 0, 0
    for batch in batches:
        sizes = np.diff(np.asarray(batch.column(2).offsets))
        at = 0
        while at < batch.num_rows:
            fit = int(np.searchsorted(np.cumsum(sizes[at:]), n_postings - postings, "right"))
            take = min(n_docs - docs, fit, batch.num_rows - at)
            if not take and not held:
                take = 1
            if take:
                held.append(batch.slice(at, take))
                docs, postings, at = docs + take, postings + int(sizes[at : at + take].sum()), at + take
            if at < batch.num_rows or docs >= n_docs or postings >= n_postings:
                yield _arrays(held)
                held, docs, postings = [], 0, 0
    if held:
        yield _arrays(held)


def _arrays(held: list[pa.RecordBatch]) -> tuple:
    rows = pa.Table.from_batches(held).combine_chunks()
    flat = lambda k: np.asarray(pa.compute.list_flatten(rows.column(k).combine_chunks()))
    sizes = np.asarray(pa.compute.list_value_length(rows.column(2).combine_chunks()))
    return np.asarray(rows.column(0)), np.asarray(rows.column(1)), flat(2), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), flat(3)


# ---------------------------------------------------------------- search


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    pairs = persist_table(items.select("item_id", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).distinct(), "lexical_items")
    n_blocks = -(-pairs.count() // block_terms)
    found = None
    for block in range(n_blocks):
        one = pairs.filter(F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(n_blocks)) == block)
        ranked = _search_block(docs, one, k)
        found = ranked if found is None else found.unionByName(ranked)
    kind = items.schema["item_id"].dataType.simpleString()
    return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if found is None else found


def _search_block(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    by_item: dict = {}
    numbers: dict[bytes, int] = {}
    for row in pairs.collect():  # at most a block's (item, term) pairs
        by_item.setdefault(row["item_id"], []).append(numbers.setdefault(row["term"].encode(), len(numbers)))
    kind = pairs.schema["item_id"].dataType.simpleString()
    forward = persist_table(forward_rows(docs, numbers), "lexical_forward")
    n_docs, n_words = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(numbers), np.int64)
    for number, n in forward.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).collect():  # a row for each term of the block
        df[number] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    wanted = [(item, np.array(sorted(t for t in ts if df[t]), np.int64)) for item, ts in by_item.items()]
    wanted = [(item, ts, weights[ts]) for item, ts in wanted if len(ts)]
    n_terms = len(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(wanted)
        for ids, lengths, terms, rows, tfs in _shards(batches, SHARD_DOCS, SHARD_POSTINGS):
            shard = Shard(ids, lengths, terms, rows, tfs, n_terms, n_docs, n_words)
            best = [shard.best(ts, ws, k, *b) for (_, ts, ws), b in zip(wanted, best, strict=True)]
        for number, (scores, ids) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(ids), pa.int32()), pa.array(ids), pa.array(scores)], ["item", "doc_id", "score"])

    hits = forward.mapInArrow(run, "item int, doc_id long, score long")
    order = [F.desc("score"), "doc_id"]
    few = hits.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*order))).filter(F.col("_r") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame([(n, item) for n, (item, *_) in enumerate(wanted)], f"item int, item_id {kind}")  # of the block
    doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", doc_id.alias("doc_id"), "score")


def search_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the 50 best documents of each item."""
    return search(docs, items)
