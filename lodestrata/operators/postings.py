"""A text index that can be changed and is searched without reading all of it.

**Segments.** An upsert tokenises its own rows only and writes them as one segment: its documents with their
terms (``docs``), and the postings in blocks (``blocks``). A segment's documents are dealt into cells of
about ``CELL`` documents of like length, and fewer if they are long, and a block is a term's postings in one cell,
with their number, the largest term frequency and the smallest length. Blocks of a file's cells are sorted by term,
so a search reads the row groups and pages of its terms. Documents travel to their cells once and as they are, and a
cell's blocks are made and stay where it is, so no posting and no block is a row in a shuffle. Texts are shuffled
only where a batch repeats their ids.

**Changes.** A document that is replaced or deleted is marked dead: its row of the old segment, with its
terms, goes to the list of the dead. Numbers of documents and of words are kept in the commit, and the
document frequencies of a search are those of the blocks less the dead ones', so statistics are those of
the living. A commit is atomic (``sources.tables.CommitLog``), carries batch ids, and leaves the other
segments' files as they are. ``merge`` writes the smallest segments, and those with many dead documents, as one
from their ``docs``, without tokenising again.

**Search.** BM25's part of a term grows with its frequency and falls with the length, so the block heads
bound the score of every document of a cell. The cells with the largest bounds are scored first; of the
others only those are read whose bound reaches the k-th best score of these (block-maximum WAND with the
cell as its document). Results are those of ``retrieval.bm25`` over the living documents: a document may be
left out only if k others have at least its bound and a higher score, so ties are decided by id as there.

Defined results: ids are keys, rows with a null id are not indexed; of rows of one batch that share an id the
last by ``order`` counts (without: the largest text); null texts have no terms and count as documents of
length 0, as in ``bm25``; searches for no term find nothing; an empty index finds nothing.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.tables import CommitLog, Conflict, _batches, _seen
from ..sources.views import checkpoints
from .retrieval import K1, B, top

#: Documents of a cell, cells that are scored first, cells that are named in a plan, segments after a merge.
CELL, FIRST_CELLS, NAMED_CELLS, SEGMENTS = 1024, 8, 2000, 8
#: Words of a cell's documents, and ids that are broadcast (counted first; joined by shuffle beyond).
CELL_WORDS, FEW_IDS = 1 << 20, 500_000
#: Of a segment's documents, from which share of dead ones on it is merged.
DEAD = 0.2


def _few(ids: DataFrame, n: int) -> DataFrame:
    return F.broadcast(ids) if n <= FEW_IDS else ids


def _last_of(rows: DataFrame) -> DataFrame:
    """Of the rows (id, _t, _o) that share an id the last. Only rows of repeated ids are shuffled, unless these are many."""
    last = Window.partitionBy("id").orderBy(F.desc("_o"), F.desc("_t"))
    kept = lambda some: some.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")
    checkpoints(rows.sparkSession)
    repeated = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id").checkpoint()
    n = repeated.count()
    if n > FEW_IDS:
        return kept(rows)
    if not n:
        return rows
    repeated = F.broadcast(repeated)
    return rows.join(repeated, "id", "left_anti").unionByName(kept(rows.join(repeated, "id", "left_semi")))


def _counted(words: DataFrame) -> DataFrame:
    """(id, dl, terms, tfs) of (id, t): a document's distinct tokens, sorted, and how often it has each."""
    kind = words.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pc.list_value_length(batch.column(1))
            dl = length.to_numpy(zero_copy_only=False)
            coded = batch.column(1).flatten().dictionary_encode()
            names = coded.dictionary
            rank = np.empty(len(names), np.int64)
            by = np.asarray(pc.sort_indices(names)).astype(np.int64)
            rank[by] = np.arange(len(names))
            # a number for each token and document, in the order of documents and then of tokens
            key = np.repeat(np.arange(len(dl)), dl) * max(len(names), 1) + rank[np.asarray(coded.indices)]
            key, tf = np.unique(key, return_counts=True)
            doc, term = np.divmod(key, max(len(names), 1))
            ends = pa.array(np.searchsorted(doc, np.arange(len(dl) + 1)).astype(np.int32))
            terms = pa.ListArray.from_arrays(ends, names.take(pa.array(by[term])).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), length.cast(pa.int32()), terms, pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))], ["id", "dl", "terms", "tfs"])

    return words.mapInArrow(run, f"id {kind}, dl int, terms array<string>, tfs array<int>")


def _inverted(docs: DataFrame, cell: Column) -> DataFrame:
    """Blocks of (id, dl, terms, tfs), sorted by term in each task: a cell's documents come to one task, sorted by id.
    Terms hold no blanks (``tokens``) and travel as one text, which is smaller than their array."""
    kind = docs.schema["id"].dataType.simpleString()
    dealt = docs.filter("dl > 0").select(cell.alias("cell"), "id", "dl", F.array_join("terms", " ").alias("terms"), "tfs").repartition("cell").sortWithinPartitions("cell", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.asarray(batch.column(0))
            cuts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]).tolist()
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                if held and cells[a] != cell:
                    yield from _cell_blocks(held)
                    held = []
                cell = cells[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from _cell_blocks(held)

    blocks = dealt.mapInArrow(run, f"term string, cell int, n int, max_tf int, min_dl int, ids array<{kind}>, tfs array<int>, dls array<int>")
    return blocks.sortWithinPartitions("term", "cell")


def _cell_blocks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of one cell, in any order of their terms."""
    cell, ids, dl, terms, tfs = pa.Table.from_batches(held).combine_chunks().to_batches()[0].columns
    terms = pc.split_pattern(terms, " ")
    words = terms.flatten().dictionary_encode()
    codes = np.asarray(words.indices)
    # stable, so that a term's postings stay in the order of their ids
    order = np.argsort(codes, kind="stable")
    of = np.repeat(np.arange(len(ids)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))[order]
    starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
    tf, length = np.asarray(tfs.flatten())[order], np.asarray(dl)[of]
    ends = pa.array(np.r_[starts, len(of)].astype(np.int32))
    columns = {
        "term": words.dictionary.take(pa.array(codes[order][starts])).cast(pa.string()),
        "cell": pa.array(np.full(len(starts), cell[0].as_py(), np.int32)),
        "n": pa.array(np.diff(np.r_[starts, len(of)]).astype(np.int32)),
        "max_tf": pa.array(np.maximum.reduceat(tf, starts)),
        "min_dl": pa.array(np.minimum.reduceat(length, starts)),
        "ids": pa.ListArray.from_arrays(ends, ids.take(pa.array(of))),
        "tfs": pa.ListArray.from_arrays(ends, pa.array(tf)),
        "dls": pa.ListArray.from_arrays(ends, pa.array(length)),
    }
    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


class TextIndex:
    def __init__(self, spark: SparkSession, folder: str, cell: int = CELL, lease: float = 60.0):
        self.spark, self.cell, self.log = spark, cell, CommitLog(spark, folder, lease)
        self.folder = self.log.folder

    def state(self) -> dict:
        """The current commit: segments (name, docs, words, dead), lists of the dead, numbers of living documents and words."""
        last = self.log.latest()
        return last[1] if last else {"segments": [], "dead": [], "docs": 0, "words": 0, "batches": {}}

    def _read(self, kind: str, names: list[str]) -> DataFrame | None:
        found = [self.spark.read.parquet(f"{self.folder}/data/{n}/{kind}").withColumn("seg", F.lit(n)) for n in names]
        return reduce(DataFrame.unionByName, found) if found else None

    # ------------------------------------------------------------ changes

    def upsert(self, rows: DataFrame, id_col: str, text_col: str, order: str | None = None, batch: tuple[str, int] | None = None) -> int:
        """Index ``rows``; documents with their ids are replaced. Returns the commit's number."""
        last = self.log.latest()
        if last and _seen(last[1], batch):
            return last[0]
        one = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"), (F.col(order) if order else F.lit(0)).alias("_o")).filter("id is not null")
        forward = _counted(_last_of(one).select("id", tokens(F.col("_t")).alias("t")))
        return self._change(forward, None, batch)

    def delete(self, ids: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Remove the documents whose id is in the one column of ``ids``."""
        return self._change(None, ids.toDF("id").filter("id is not null").distinct(), batch)

    def _change(self, forward: DataFrame | None, ids: DataFrame | None, batch: tuple[str, int] | None, tries: int = 5) -> int:
        for _ in range(tries):
            last = self.log.latest()
            number, state = (last[0], last[1]) if last else (-1, self.state())
            if _seen(state, batch):
                return number
            made = []
            segments, dead = [dict(s) for s in state["segments"]], list(state["dead"])
            n, words = state["docs"], state["words"]
            new = None
            if forward is not None:
                new = self._segment(forward)
                made.append(new["name"])
                n, words = n + new["docs"], words + new["words"]
            touched = self._read("docs", [new["name"]]).select("id") if new is not None else ids
            old = self._read("docs", [s["name"] for s in segments])
            if old is not None:
                # who is dead is found from the ids alone
                gone = self._dead(dead)
                hit = old.select("seg", "id", "dl").join(touched, "id", "left_semi")
                hit = hit if gone is None else hit.join(_few(gone.select("seg", "id"), self._gone(segments)), ["seg", "id"], "left_anti")
                checkpoints(self.spark)
                hit = hit.checkpoint()
                by = {r["seg"]: r for r in hit.groupBy("seg").agg(F.count("*").alias("n"), F.sum("dl").alias("words")).collect()}  # a row for each segment
                for s in segments:
                    if s["name"] in by:
                        s["dead"] += by[s["name"]]["n"]
                        n, words = n - by[s["name"]]["n"], words - by[s["name"]]["words"]
                if by:
                    name = uuid.uuid4().hex
                    ids_ = _few(hit.select("seg", "id"), sum(r["n"] for r in by.values()))
                    old.join(ids_, ["seg", "id"], "left_semi").write.parquet(f"{self.folder}/data/{name}/docs")
                    made.append(name)
                    dead.append(name)
            if new is not None and new["docs"]:
                segments.append(new)
            try:
                self.log.commit(number + 1, {"segments": segments, "dead": dead, "docs": n, "words": words, "batches": _batches(state, batch)})
                return number + 1
            except Conflict:
                for name in made:
                    self.log.discard(f"data/{name}")
        raise Conflict(f"{self.folder}: no commit in {tries} tries")

    def _dead(self, dead: list[str]) -> DataFrame | None:
        """(id, dl, terms, tfs, seg) of the dead documents; seg is the segment that they were in."""
        return self.spark.read.parquet(*[f"{self.folder}/data/{n}/docs" for n in dead]) if dead else None

    def _alive(self, segments: list[dict], dead: list[str]) -> DataFrame | None:
        docs = self._read("docs", [s["name"] for s in segments])
        gone = self._dead(dead)
        return docs if docs is None or gone is None else docs.join(_few(gone.select("seg", "id"), self._gone(segments)), ["seg", "id"], "left_anti")

    @staticmethod
    def _gone(segments: list[dict]) -> int:
        return sum(s["dead"] for s in segments)

    def _segment(self, forward: DataFrame) -> dict:
        """Write (id, dl, terms, tfs) as a segment: documents first, then the blocks made of them."""
        name = uuid.uuid4().hex
        place = f"{self.folder}/data/{name}"
        forward.write.parquet(f"{place}/docs")
        docs = self.spark.read.parquet(f"{place}/docs")
        # cells of documents of like length: classes by powers of two, each dealt by a hash of the id
        kind = F.floor(F.log2(F.col("dl") + 1.0)).cast("int")
        sizes = {r["kind"]: r for r in docs.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("dl").alias("words")).collect()}  # 32 classes at most
        first, cells = 0, F.lit(0)
        for k in sorted(sizes):
            many = max(-(-sizes[k]["n"] // self.cell), -(-sizes[k]["words"] // CELL_WORDS))
            cells = F.when(kind == k, first + F.pmod(F.xxhash64("id"), F.lit(many))).otherwise(cells)
            first += many
        blocks = _inverted(docs, cells.cast("int"))
        blocks.write.option("parquet.block.size", 8 << 20).option("parquet.page.size", 64 << 10).parquet(f"{place}/blocks")
        return {"name": name, "docs": sum(r["n"] for r in sizes.values()), "words": int(sum(r["words"] for r in sizes.values())), "dead": 0, "cells": first}

    def merge(self, most: int = SEGMENTS, tries: int = 5) -> int | None:
        """Bring the number of segments down to ``most`` by writing the smallest as one, and write those anew of
        whose documents ``DEAD`` or more are dead. None, if there is nothing to do."""
        for _ in range(tries):
            last = self.log.latest()
            if last is None:
                return None
            number, state = last
            by_size = sorted(state["segments"], key=lambda s: s["docs"] - s["dead"])
            chosen = {s["name"] for s in by_size[: len(by_size) - most + 1]} if len(by_size) > most else set()
            chosen |= {s["name"] for s in by_size if s["dead"] >= DEAD * s["docs"] and s["dead"]}
            if not chosen:
                return None
            old = [s for s in state["segments"] if s["name"] in chosen]
            kept = [s for s in state["segments"] if s["name"] not in chosen]
            new = self._segment(self._alive(old, state["dead"]).select("id", "dl", "terms", "tfs"))
            made, dead = [new["name"]], []
            rest = self._dead(state["dead"])
            if rest is not None and any(s["dead"] for s in kept):
                name = uuid.uuid4().hex
                rest.filter(F.col("seg").isin([s["name"] for s in kept])).write.parquet(f"{self.folder}/data/{name}/docs")
                dead, made = [name], [*made, name]
            try:
                self.log.commit(number + 1, state | {"segments": kept + ([new] if new["docs"] else []), "dead": dead})
                return number + 1
            except Conflict:
                for name in made:
                    self.log.discard(f"data/{name}")
        raise Conflict(f"{self.folder}: no commit in {tries} tries")

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the newest ``keep`` commits, and the data that only these had."""
        known = self.log.entries()
        names = lambda e: {s["name"] for s in e["segments"]} | set(e["dead"])
        old = sorted(known)[: -keep or None]
        used = {x for n, e in known.items() if n not in old for x in names(e)}
        for number in old:
            self.log.remove(number, [f"data/{x}" for x in names(known[number]) - used])

    # ------------------------------------------------------------ search

    def search(self, terms: list[str] = (), prefixes: list[str] = (), k: int | None = None, require_all: bool = True, keep: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
        """(id, score): the k best (none: all) of the documents with the terms, BM25 over all living documents;
        with ``keep`` (one column of ids) only of these. Prefix terms match every token that starts with them."""
        state = self.state()
        names = [s["name"] for s in state["segments"]]
        asked = [*terms, *[p + "*" for p in prefixes]]
        if not names or not asked or not state["docs"]:
            return self._none()
        wanted = reduce(lambda x, y: x | y, [F.col("term") == t for t in terms] + [F.col("term").startswith(p) for p in prefixes])
        named = [F.when(F.col("term") == t, F.lit(t)) for t in terms] + [F.when(F.col("term").startswith(p), F.lit(p + "*")) for p in prefixes]
        asked_of = F.explode(F.array_compact(F.array(*named))).alias("q")
        blocks = self._read("blocks", names).filter(wanted)
        df = self._frequencies(blocks, asked_of, asked, bool(prefixes), state)
        if any(not df.get(q) for q in asked) and require_all or not any(df.values()):
            return self._none()
        n, avgdl = state["docs"], state["words"] / state["docs"]
        idf = {q: math.log(1 + (n - df[q] + 0.5) / (df[q] + 0.5)) for q in asked if df.get(q)}
        weight = reduce(lambda c, q: F.when(F.col("q") == q, idf[q]).otherwise(c), idf, F.lit(0.0))
        part = lambda tf, dl: weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
        place = reduce(lambda c, q: F.when(F.col("q") == q, asked.index(q)).otherwise(c), asked, F.lit(0))
        gone = self._dead(state["dead"])
        allowed = None if keep is None else keep.toDF("id").filter("id is not null").distinct()

        def scored(some: DataFrame) -> DataFrame:
            each = some.select("seg", asked_of, F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")).select("seg", "q", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
            if gone is not None:
                each = each.join(_few(gone.select("seg", "id"), self._gone(state["segments"])), ["seg", "id"], "left_anti")
            if allowed is not None:
                each = each.join(allowed, "id", "left_semi")
            hits = each.groupBy("id", "dl", "q").agg(F.sum("tf").alias("tf"))
            # summed in the order of the query, as ``bm25`` does, so that equal documents have equal scores
            parts = F.array_sort(F.collect_list(F.struct(place.alias("place"), part(F.col("tf"), F.col("dl")).alias("part"))))  # a part for each term of the query
            found = hits.groupBy("id").agg(parts.alias("_p"))
            found = found.filter(F.size("_p") == len(asked) if require_all else F.lit(True))
            return found.select("id", F.aggregate("_p", F.lit(0.0), lambda s, x: s + x.part).alias("score"))

        if k is None:
            return scored(blocks)
        heads = blocks.select("seg", "cell", "max_tf", "min_dl", asked_of).groupBy("seg", "cell", "q").agg(F.sum("max_tf").alias("tf"), F.min("min_dl").alias("dl"))
        bounds = heads.groupBy("seg", "cell").agg(F.sum(part(F.col("tf"), F.col("dl"))).alias("bound"), F.count("*").alias("_n"))
        bounds = bounds.filter(F.col("_n") == len(asked) if require_all else F.lit(True))
        best = bounds.orderBy(F.desc("bound"), "seg", "cell").limit(FIRST_CELLS + 1).collect()
        if len(best) <= FIRST_CELLS:
            return top(scored(self._cells(blocks, best)), k)
        head = top(scored(self._cells(blocks, best[:FIRST_CELLS])), k).collect()  # k rows
        least = head[k - 1]["score"] * (1 - 1e-9) if len(head) >= k else 0.0  # sums of doubles may differ in the last place
        rest = bounds.filter(F.col("bound") >= least)
        named_cells = rest.limit(NAMED_CELLS + 1).collect()
        if len(named_cells) <= NAMED_CELLS:
            return top(scored(self._cells(blocks, named_cells)), k)
        return top(scored(blocks.join(rest.select("seg", "cell"), ["seg", "cell"], "left_semi")), k)

    def _none(self) -> DataFrame:
        names = [s["name"] for s in self.state()["segments"]]
        kind = self._read("docs", names).schema["id"].dataType.simpleString() if names else "long"
        return self.spark.createDataFrame([], f"id {kind}, score double")

    @staticmethod
    def _cells(blocks: DataFrame, cells: list) -> DataFrame:
        """The blocks of the named cells; the names are literals, so they reach the scans."""
        by: dict[str, list[int]] = {}
        for c in cells:
            by.setdefault(c["seg"], []).append(c["cell"])
        if not by:
            return blocks.limit(0)
        return blocks.filter(reduce(lambda x, y: x | y, [(F.col("seg") == s) & F.col("cell").isin(cs) for s, cs in by.items()]))

    def _frequencies(self, blocks: DataFrame, asked_of: Column, asked: list[str], unite: bool, state: dict) -> dict[str, int]:
        """Living documents with each term of the query. A document is in one cell, so those of several terms
        under a prefix are united within cells, from the ids alone."""
        if unite:
            own = blocks.select("seg", "cell", "ids", asked_of).groupBy("seg", "cell", "q").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("n"))
        else:
            own = blocks.select("n", asked_of)
        found = {r["q"]: r["n"] for r in own.groupBy("q").agg(F.sum("n").alias("n")).collect()}  # a row for each term of the query
        gone = self._dead(state["dead"])
        if gone is not None:
            holds = lambda q: lambda x: x.startswith(q[:-1]) if q.endswith("*") else x == F.lit(q)
            lost = gone.agg(*[F.count_if(F.exists("terms", holds(q))) for q in asked]).first()
            found = {q: found.get(q, 0) - m for q, m in zip(asked, lost, strict=True)}
        return found
