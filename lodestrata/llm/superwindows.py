"""Distributed search for repeated windows (of bytes or of words), shared by two operators.

1. Equal texts fold into one document by a 128-bit text hash; only light rows are grouped.
2. Each text is cut into super-windows: runs of consecutive windows with the same minimiser. Equal
   windows have equal minimisers, so a minimiser seen once in the corpus rules its windows out.
3. Super-windows whose minimiser repeats travel as one packed string each to the minimiser's bucket.
   A bucket of more than ``limit`` strings is dealt out over ceil(n / limit) salts.
4. There equal strings, which sorting brings together, fold into the first; the others repeat whole
   and are marked at once. The distinct strings of a whole bucket go to the operator's own method,
   which marks windows. Those of a salted bucket meet once more, without salts; where still more than
   ``CUT`` distinct strings share a minimiser they are cut into windows, and equal windows meet by
   their bytes, pre-aggregated. So no task holds more than ``CUT`` strings of a bucket, and windows count
   as equal only if all their bytes are.
5. Marks are gathered per document and joined to its text.

The text is shuffled once for steps 2 and 3 and once for step 5. ``rid`` (hash of id and text) with
``h1`` (hash of the text) names a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persist_table, text_slices

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SLICE = 1 << 18
LIMIT = 4_096
#: Distinct strings of a bucket that one task settles at most.
CUT = 65_536
CHUNK_BYTES = 1 << 19


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def mer_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive units, built by doubling: a mer's hash depends on its units alone."""
    power, width, out = MULTIPLIER, 1, units.astype(np.uint64) + np.uint64(1)
    total, total_width = None, 0
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                if total is None:
                    total, total_width = out, width
                else:  # the wider part stands first
                    n = len(units) - total_width - width + 1
                    total = out[:n] * np.uint64(pow(int(MULTIPLIER), total_width, 1 << 64)) + total[width : width + n]
                    total_width += width
            if 2 * width > k:
                return mixed(total)
            out = out[: len(out) - width] * power + out[width:]
            power, width = power * power, 2 * width


def sliding_minimum(values: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while 2 * span <= w:
        values = np.minimum(values[: len(values) - span], values[span:])
        span *= 2
    rest = w - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs(units: np.ndarray, window: int, k: int, slice_: int = SLICE) -> tuple[np.ndarray, ...]:
    """(minimiser hash, first window, number of windows, minimiser's place from the first window's start)
    of the super-windows of one text."""
    found = []
    for at in range(0, len(units) - window + 1, slice_):
        h = mer_hashes(units[at : at + slice_ + window - 1], k)
        place = np.arange(len(h), dtype=np.uint64)
        low = np.uint64(0xFFFFFF)
        best = (sliding_minimum((h & ~low) | place, window - k + 1) & low).astype(np.int64)  # leftmost of equals
        first = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
        found.append((h[best[first]].view(np.int64), first + at, np.diff(np.r_[first, len(best)]), best[first] - first))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Bytes:
    """Windows of ``window`` bytes of the text as it is."""

    def __init__(self, window: int, mer: int):
        self.window, self.mer = window, mer

    def read(self, data: memoryview) -> tuple[bytes, np.ndarray, Callable]:
        raw = bytes(data)
        return raw, np.frombuffer(raw, np.uint8), lambda a, b: raw[a:b]


class Words:
    """Windows of ``window`` words; words are runs of other bytes than ASCII white space."""

    def __init__(self, window: int, mer: int):
        self.window, self.mer = window, mer
        self.table = mixed(np.arange(1, 4097, dtype=np.uint64) * MULTIPLIER) | np.uint64(1)

    def read(self, data: memoryview) -> tuple[bytes, np.ndarray, Callable]:
        raw = b" ".join(bytes(data).split())
        if not raw:
            return raw, np.empty(0, np.uint64), lambda a, b: b""
        a = np.frombuffer(raw, np.uint8)
        starts = np.r_[0, np.flatnonzero(a == 32) + 1]
        ends = np.r_[starts[1:] - 1, len(a)]
        hashes = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):  # slices of whole words
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE)))
            part, own = a[starts[at] : ends[to - 1]], starts[at:to] - starts[at]
            inside = np.arange(len(part)) - np.repeat(own, np.diff(np.r_[own, len(part)]))
            with np.errstate(over="ignore"):
                hashes[at:to] = np.add.reduceat(part * self.table[inside & 4095] * (part != 32), own)
            at = to
        return raw, mixed(hashes), lambda i, j: raw[starts[i] : ends[j - 1]]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"))
    return rows.select("id", "text", "h1", "h2", F.xxhash64("id", "h1").alias("rid"))


def firsts(rows: DataFrame) -> DataFrame:
    """One row per distinct text: its first document, and whether other documents have it too."""
    ids = F.struct("id")
    per_text = rows.select("id", "h1", "h2").groupBy("h1", "h2").agg(F.min(ids).alias("first"), (F.min(ids) != F.max(ids)).alias("many"))
    return per_text.select("h1", "h2", F.col("first.id").alias("first"), "many").withColumn("rid", F.xxhash64("first", "h1"))


def _names(kind: str) -> list[str]:
    return [x.split()[0] for x in kind.split(", ")]


def minimisers(texts: DataFrame, units: Bytes | Words) -> DataFrame:
    """(rid, h1, hash): the minimiser of every super-window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [runs(units.read(x)[1], units.window, units.mer)[0] for x in text_slices(batch.column(3))]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hashes], ["rid", "h1", "hashes"])

    return texts.mapInArrow(run, "rid long, h1 long, hashes array<long>").select("rid", "h1", F.explode("hashes").alias("hash"))


def packed_strings(texts: DataFrame, units: Bytes | Words, id_type: str, limit: int) -> DataFrame:
    """Super-windows with a repeated minimiser: (hash, salt, hot, id, rid, h1, start, n, packed)."""
    schema = STRINGS.format(id_type=id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(6)
            offsets, hashes, counts = known.offsets.to_numpy(), known.values.field(0).to_numpy(), known.values.field(1).to_numpy()
            held: list[list] = [[] for _ in range(6)]
            which, size = [], 0
            for row, data in enumerate(text_slices(batch.column(3))):
                own, index = np.unique(hashes[offsets[row] : offsets[row + 1]], return_index=True)
                many = counts[offsets[row] : offsets[row + 1]][index]
                _, codes, cut = units.read(data)
                h, start, n, place = runs(codes, units.window, units.mer)
                at = np.minimum(np.searchsorted(own, h), len(own) - 1)
                for k in np.flatnonzero(own[at] == h).tolist():
                    packed = cut(int(start[k]), int(start[k] + n[k]) + units.window - 1)
                    salts = -(-int(many[at[k]]) // limit)
                    # -1: the bucket is whole
                    salt = (xxhash.xxh32_intdigest(int(start[k]).to_bytes(8, "little"), batch.column(0)[row].as_py() & 0xFFFFFFFF)) % salts if salts > 1 else -1
                    for x, v in zip(held, (int(h[k]), salt, int(start[k]), int(n[k]), packed, int(place[k])), strict=True):
                        x.append(v)
                    which.append(row)
                    size += len(packed)
                if size > 1 << 23:
                    yield _string_rows(batch, held, which, schema)
                    held, which, size = [[] for _ in range(6)], [], 0
            if which:
                yield _string_rows(batch, held, which, schema)

    return texts.mapInArrow(run, schema)


def _string_rows(batch: pa.RecordBatch, held: list[list], which: list[int], schema: str) -> pa.RecordBatch:
    take = pa.array(which)
    columns = [pa.array(held[0], pa.int64()), pa.array(held[1], pa.int32()), batch.column(2).take(take), batch.column(0).take(take), batch.column(1).take(take)]
    columns += [pa.array(held[2], pa.int64()), pa.array(held[3], pa.int32()), pa.array(held[4], pa.binary()), pa.array(np.zeros(len(which), bool)), pa.array(held[5], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, _names(schema))


#: (place in the order of id, rid and start, packed string, number of windows, the minimiser's place in
#: the string) of a bucket's distinct strings.
Group = list[tuple[int, bytes, int, int]]
#: A bucket worker gets groups of two or more distinct strings and gives one mask of windows for each.
Marker = Callable[[list[Group]], list[list[np.ndarray]]]
STRINGS = "hash long, salt int, id {id_type}, rid long, h1 long, start long, n int, packed binary, many boolean, at int"


class _Bucket:
    """The distinct strings of the bucket that is being read, first occurrences first."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.bytes, self.cut = 0, False


def settled(strings: DataFrame, units: Bytes | Words, marker: Marker, id_type: str, keep_first: bool, limit: int, chunk_bytes: int) -> DataFrame:
    """Rows of ``STRINGS`` and a, b: with null strings the unit ranges [a, b) to mark; with strings what is
    left to settle: the distinct strings of a salted bucket (salt 0 or more), or the windows, one string
    each, of a bucket of over ``limit`` distinct strings (salt -2)."""
    schema = STRINGS.format(id_type=id_type) + ", a long, b long"
    keys = ["hash", "salt"]
    dealt = strings.repartition(*keys).sortWithinPartitions(*keys, "packed", "id", "rid", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[_Bucket] = []
        bucket, size, last = _Bucket(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            same, repeat = _runs_of_equals(batch, last)
            last = batch.slice(batch.num_rows - 1, 1)
            copies = np.flatnonzero(same & ~repeat)
            if len(copies):
                yield _ranges(batch, copies, units.window, schema)
            fresh = np.flatnonzero(~same)
            # a string that others follow as equals stands for several
            several = np.searchsorted(copies, np.r_[fresh[1:], batch.num_rows]) > np.searchsorted(copies, fresh)
            if bucket.rows and len(copies) and (not len(fresh) or copies[0] < fresh[0]):
                bucket.rows[-1] = (*bucket.rows[-1][:8], True, bucket.rows[-1][9])
            held = batch.take(pa.array(fresh))
            for row, more in zip(zip(*[held.column(k).to_pylist() for k in range(10)], strict=True), several.tolist(), strict=True):
                if bucket.rows and row[:2] != bucket.rows[-1][:2]:
                    done.append(bucket)
                    size, bucket = size + bucket.bytes, _Bucket()
                    if size >= chunk_bytes:
                        yield from _marks(done, units, marker, schema, keep_first, batch.schema)
                        done, size = [], 0
                bucket.rows.append((*row[:8], row[8] or more, row[9]))
                bucket.bytes += len(row[7])
                if len(bucket.rows) >= limit and row[1] < 0 or bucket.cut:
                    # the last string may yet turn out to stand for several
                    bucket.cut = True
                    yield from _left(bucket.rows[:-1], units, schema, batch.schema)
                    bucket.rows = bucket.rows[-1:]
            kinds = batch.schema
        if last is not None:
            yield from _marks([*done, bucket], units, marker, schema, keep_first, kinds)

    return dealt.mapInArrow(run, schema)


def _runs_of_equals(batch: pa.RecordBatch, last: pa.RecordBatch | None) -> tuple[np.ndarray, np.ndarray]:
    """Whether a row has the bucket and string of the row before, and whether it is that very row again
    (a row that repeats in the table is the same document)."""
    whole = pa.Table.from_batches([last, batch] if last is not None else [batch]).combine_chunks()
    alike = lambda names: np.logical_and.reduce([pc.equal(whole[n][1:], whole[n][:-1]).to_numpy(zero_copy_only=False) for n in names]) if whole.num_rows > 1 else np.empty(0, bool)
    same = alike(["hash", "salt", "packed"])
    repeat = same & alike(["rid", "h1", "start"])
    if last is None:
        same, repeat = np.r_[False, same], np.r_[False, repeat]
    return same.astype(bool), repeat.astype(bool)


def _ranges(batch: pa.RecordBatch, rows: np.ndarray, window: int, schema: str) -> pa.RecordBatch:
    """Marks of whole strings; what only unsettled strings need is null."""
    some = batch.select(["rid", "h1", "start", "n"]).take(pa.array(rows))
    start, n = some.column(2).to_numpy(), some.column(3).to_numpy()
    filled = {"rid": some.column(0), "h1": some.column(1), "a": pa.array(start), "b": pa.array(start + n + window - 1)}
    kinds = {f.name: f.type for f in batch.schema}
    return pa.RecordBatch.from_arrays([filled[c] if c in filled else pa.nulls(len(rows), kinds[c]) for c in _names(schema)], _names(schema))


def _rows(rows: list[tuple], schema: str, kinds: pa.Schema) -> pa.RecordBatch:
    types = [*(f.type for f in kinds), pa.int64(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], _names(schema))


def _left(rows: list[tuple], units: Bytes | Words, schema: str, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Strings cut into their windows, which equal windows of other strings then meet by themselves."""
    out = []
    for hash_, _, id_, rid, h1, start, n, packed, many, at in rows:
        out += [(hash_, -2, id_, rid, h1, start + k, 1, w, many, at - k, None, None) for k, w in enumerate(window_bytes(units, packed, n))]
        if len(out) > 10_000:
            yield _rows(out, schema, kinds)
            out = []
    if out:
        yield _rows(out, schema, kinds)


def _marks(buckets: list[_Bucket], units: Bytes | Words, marker: Marker, schema: str, keep_first: bool, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    groups: list[Group] = []
    sources: list[list[tuple]] = []
    out: list[tuple] = []
    for bucket in buckets:
        rows = bucket.rows
        if bucket.cut:
            yield from _left(rows, units, schema, kinds)
            continue
        if rows and rows[0][1] >= 0:
            out += [(*row, None, None) for row in rows]
            continue
        if not keep_first:
            out += [(*row[:7], None, *row[8:], row[5], row[5] + row[6] + units.window - 1) for row in rows if row[8]]
        if len(rows) > 1:
            order = sorted(range(len(rows)), key=lambda k: ((rows[k][2] is not None, rows[k][2]) if rows[k][2] is not None else (False,), rows[k][3], rows[k][5]))  # noqa: B023
            place = {k: p for p, k in enumerate(order)}
            groups.append([(place[k], row[7], row[6], row[9]) for k, row in enumerate(rows)])
            sources.append(rows)
    for rows, masks in zip(sources, marker(groups) if groups else [], strict=True):
        for row, mask in zip(rows, masks, strict=True):
            if not mask.any():
                continue
            edges = np.array([0, len(mask)]) if mask.all() else np.flatnonzero(np.diff(np.r_[False, mask, False]))
            out += [(*row[:7], None, *row[8:], row[5] + x, row[5] + y - 1 + units.window) for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
    yield _rows(out, schema, kinds)


def window_bytes(units: Bytes | Words, packed: bytes, n: int) -> list[bytes]:
    """The windows of a packed string."""
    if isinstance(units, Bytes):
        return [packed[k : k + units.window] for k in range(n)]
    spaces = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32)
    starts, ends = np.r_[0, spaces + 1].tolist(), np.r_[spaces, len(packed)].tolist()
    return [packed[starts[k] : ends[k + units.window - 1]] for k in range(n)]


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, units: Bytes | Words, marker: Marker, keep_first: bool, limit: int = LIMIT, chunk_bytes: int = CHUNK_BYTES, cut: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, texts). rows: every row of docs as (id, h1, h2). texts: each distinct text once, as
    (rid, h1, id, text, h2, many, spans) with the unit ranges to remove; id is its first document."""
    id_type = docs.schema[id_col].dataType.simpleString()
    cut = CUT if cut is None else cut
    base = keyed(docs, id_col, text_col)
    one = firsts(base).select("rid", "h1", "h2", "many").hint("shuffle_hash")
    # all uses read the same columns, so that the exchange of the texts is one and is reused
    texts = base.select("rid", "h1", "id", "text").join(one, ["rid", "h1"])
    found = minimisers(texts, units)
    twice = found.groupBy("hash").agg(F.count("*").alias("c")).filter("c > 1")
    per_doc = found.join(twice, "hash").groupBy("rid", "h1").agg(F.collect_list(F.struct("hash", "c")).alias("known"))
    candidates = texts.join(per_doc.hint("shuffle_hash"), ["rid", "h1"])
    strings = packed_strings(candidates, units, id_type, limit)
    marks = persist_table(settled(strings, units, marker, id_type, keep_first, cut, chunk_bytes), "marks")
    names = _names(STRINGS)
    # the distinct strings of salted buckets, bucket by bucket
    salted = marks.filter("salt >= 0 and packed is not null").select(*names).withColumn("salt", F.lit(-1))
    more = persist_table(settled(salted, units, marker, id_type, keep_first, cut, chunk_bytes), "marks")
    windows = marks.union(more).filter("salt = -2").select("id", "rid", "h1", "start", "packed", "many")
    at = F.struct("id", "rid", "h1", "start")
    met = windows.groupBy("packed").agg(F.min(at).alias("top"), (F.min(at) != F.max(at)).alias("several"), F.max("many").alias("any"))
    goes = (at != F.col("top")) if keep_first else F.lit(True)
    hit = windows.join(met.filter("several" if keep_first else "several or any"), "packed").filter(goes)
    single = hit.select("rid", "h1", F.col("start").alias("a"), (F.col("start") + units.window).alias("b"))
    spans = marks.union(more).filter("packed is null").select("rid", "h1", "a", "b").union(single)
    spans = spans.groupBy("rid", "h1").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return base.select("id", "h1", "h2"), texts.join(spans.hint("shuffle_hash"), ["rid", "h1"], "left")


def span_columns(spans: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, a, b) of a column of lists of ranges."""
    return spans.offsets.to_numpy(), spans.values.field(0).to_numpy(), spans.values.field(1).to_numpy()


def covered(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Boolean mask of n units under half-open ranges."""
    return np.cumsum(np.bincount(a, minlength=n + 1) - np.bincount(b, minlength=n + 1))[:n] > 0
