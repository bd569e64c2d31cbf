"""Suffix-array dedup: bytes under a 100-byte string that starts earlier in the corpus go.

``superwindows`` deals the strings that may hold repeats into buckets and folds equal ones. The
distinct strings of whole buckets, ``COLLECTION_BYTES`` or more of them at once, form a collection whose
Burrows-Wheeler transform is built column by column: every round inserts one symbol of each string
(from the right end). A first pass over the column of symbols counts how many stand before a
string's current suffix, which gives the new suffix's place; a second pass merges the new rows into
the sorted suffixes and updates the common prefixes of the rows that got a new neighbour. Rows whose
common prefix reaches the window's length are equal windows; the first in (document, start) order
stays, the others are marked.

Both passes read the old rows and write the new ones sequentially, block by block, in files of the
task (removed with it); only collections of under ``MEMORY_ROWS`` suffixes stay in memory.

Defined results: a null text is empty; texts shorter than a window lose nothing; rows that agree in
id and text are one document and each get its result; of rows that share only the id the order is
that of a hash of the text; a null id is smallest.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices
from .superwindows import LIMIT, Bytes, Group, covered, repeated_spans, span_columns

WINDOW, MER = 100, 32
BLOCK_ROWS = 1 << 20
MEMORY_ROWS = 1 << 18
#: Bytes of strings in one collection; a larger bucket is one collection all the same.
COLLECTION_BYTES = 1 << 20
STEP = 128
#: Classes of windows by what stands in front of the minimiser.
SIDES = 8


class Rows:
    """The sorted suffixes as three columns (position, common prefix with the row before, symbol in
    front), appended and read block by block: in files of ``folder``, or in memory without one."""

    def __init__(self, kinds: tuple, folder: str | None, name: str):
        self.kinds, self.parts, self.length = kinds, [], 0
        self.files = None if folder is None else [open(f"{folder}/{name}.{k}", "w+b") for k in range(3)]

    def start(self) -> None:
        """Forget all rows; files are written over from their beginning."""
        self.parts, self.length = [], 0
        for f in self.files or ():
            f.seek(0)

    def append(self, *columns: np.ndarray) -> None:
        self.length += len(columns[0])
        if self.files is None:
            self.parts.append(columns)
        else:
            for f, x in zip(self.files, columns, strict=True):
                x.tofile(f)

    def read(self, rows: int, columns: tuple[int, ...] = (0, 1, 2)) -> Iterator[list[np.ndarray]]:
        if self.files is None and len(self.parts) > 1:
            self.parts = [tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))]
        for k in columns if self.files else ():
            self.files[k].flush()
            self.files[k].seek(0)
        for at in range(0, self.length, rows):
            if self.files is None:
                yield [self.parts[0][k][at : at + rows] for k in columns]
            else:
                yield [np.fromfile(self.files[k], self.kinds[k], min(rows, self.length - at)) for k in columns]

    def close(self) -> None:
        for f in self.files or ():
            f.close()


class Collection:
    """The text of all strings (each after an end mark, symbols coded from 1) and what a round needs."""

    def __init__(self, strings: list[bytes], depth: int):
        if depth > 255:
            raise ValueError("common prefixes are held as bytes")
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.ends = np.cumsum(lengths + 1)
        self.starts, self.rounds, self.depth = (self.ends - lengths).astype(np.int32), int(lengths.max(initial=0)), depth
        raw = np.frombuffer(b"\0" + b"\0".join(strings), np.uint8)
        mark = np.zeros(len(raw), bool)
        mark[np.r_[0, self.ends[:-1]]] = True
        used = np.unique(raw[~mark])
        code = np.zeros(256, np.uint8 if len(used) < 255 else np.uint16)
        code[used] = np.arange(1, len(used) + 1)
        self.symbols = len(used) + 1
        # end marks behind, so that a comparison may run past the last string
        self.text = np.concatenate([np.where(mark, 0, code[raw]).astype(code.dtype), np.zeros(depth + 1, code.dtype)])
        self.heads = np.lib.stride_tricks.sliding_window_view(self.text, depth)
        self.kinds = np.int32, np.uint8, code.dtype
    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes, up to the depth and never over an end mark."""
        out = np.empty(len(a), np.uint8)
        for at in range(0, len(a), 1 << 13):
            x, y = self.heads[a[at : at + (1 << 13)]], self.heads[b[at : at + (1 << 13)]]
            apart = (x != y) | (x == 0)
            out[at : at + (1 << 13)] = np.where(apart.any(axis=1), apart.argmax(axis=1), self.depth)
        return out


class Counts:
    """How often each symbol stands in front of the suffixes of every step of the sorted rows. Rounds add
    to the steps; when one has grown to twice its size, all are counted anew."""

    def __init__(self, symbols: int):
        self.symbols, self.starts, self.steps = symbols, np.zeros(1, np.int64), np.zeros((1, symbols), np.int64)

    def recount(self, front: np.ndarray) -> None:
        self.starts = np.arange(0, max(1, len(front)), STEP)
        self.steps = np.zeros((len(self.starts), self.symbols), np.int64)
        for at in range(0, len(self.starts), 256):
            part = front[at * STEP : (at + 256) * STEP]
            cells = np.arange(len(part)) // STEP * self.symbols + part
            n = -(-len(part) // STEP)
            self.steps[at : at + n] = np.bincount(cells, minlength=n * self.symbols).reshape(n, self.symbols)

    def before(self, front: np.ndarray, rank: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands in front of a suffix before ``rank``."""
        ends = np.r_[self.starts[1:], len(front)]
        if (ends - self.starts).max() > 2 * STEP:
            self.recount(front)
        step = np.searchsorted(self.starts, rank, "right") - 1
        upto = np.cumsum(self.steps, axis=0) - self.steps
        found, inside = upto[step, symbol], rank - self.starts[step]
        near = np.lib.stride_tricks.sliding_window_view(np.concatenate([front, np.zeros(2 * STEP, front.dtype)]), 2 * STEP)
        for at in range(0, len(rank), 1 << 12):
            part = slice(at, at + (1 << 12))
            same = (near[self.starts[step[part]]] == symbol[part, None]) & (np.arange(2 * STEP) < inside[part, None])
            found[part] += np.count_nonzero(same, axis=1)
        return found

    def add(self, target: np.ndarray, front: np.ndarray) -> None:
        """New rows, in front of which held rows and with which symbols in front."""
        step = np.searchsorted(self.starts, target, "right") - 1
        np.add.at(self.steps, (step, front), 1)
        grown = np.bincount(step, minlength=len(self.starts))
        self.starts = self.starts + np.cumsum(grown) - grown


def _merged(held: np.ndarray, new: np.ndarray, slot: np.ndarray, keep: np.ndarray) -> np.ndarray:
    out = np.empty(len(keep), held.dtype)
    out[keep] = held
    out[slot] = new
    return out


def insert_column(c: Collection, counts: Counts, held: Rows, new: Rows, current: np.ndarray, rank: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """One round: every string that goes on inserts the suffix longer by one symbol than its
    ``current`` one, which stands at ``rank``. Returns both for the new suffixes, in their order."""
    symbol = c.text[current - 1]
    column = np.concatenate([x for (x,) in held.read(block_rows, (2,))])  # a byte or two for each suffix
    found, totals = counts.before(column, rank, symbol), counts.steps.sum(axis=0)
    # in front of the suffixes that begin with a symbol stand the empty ones and those of lesser symbols
    begin = len(c.ends) + np.concatenate([[0, 0], np.cumsum(totals[1:])])[: c.symbols]
    place = begin[symbol] + found
    order = np.argsort(place, kind="stable")
    place, position = place[order], (current[order] - 1).astype(np.int32)
    front = c.text[position - 1]
    done, at, last, last_new = 0, 0, 0, False
    target = place - np.arange(len(place))  # in front of which held row
    counts.add(target, front)
    for pos, lcp, bwt in held.read(block_rows):
        # rows that go behind the last block's end wait for the next; the very last are appended below
        to = int(np.searchsorted(target, at + len(pos), "left"))
        where = target[done:to] - at
        fresh = np.zeros(len(pos) + len(where), bool)
        slot = where + np.arange(len(where))
        fresh[slot] = True
        keep = ~fresh
        pos, lcp, bwt = (_merged(x, y, slot, keep) for x, y in ((pos, position[done:to]), (lcp, np.uint8(0)), (bwt, front[done:to])))
        touched = np.flatnonzero(fresh | np.r_[last_new, fresh[:-1]])
        before = pos[touched - 1]
        if len(touched) and touched[0] == 0:
            before[0] = last
        lcp[touched] = c.common(before, pos[touched])
        new.append(pos, lcp, bwt)
        at += len(pos) - (to - done)
        done, last, last_new = to, pos[-1], bool(fresh[-1])
    if done < len(place):
        pos = position[done:]
        new.append(pos, c.common(np.r_[last, pos[:-1]], pos), front[done:])
    return position.astype(np.int64), place


def collection(strings: list[bytes], depth: int, block_rows: int = BLOCK_ROWS, memory_rows: int = MEMORY_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pos, lcp, starts): all suffixes of the collection in order as positions in its text (where
    each string follows one end mark), common prefixes up to ``depth``, and where strings start."""
    c = Collection(strings, depth)
    with tempfile.TemporaryDirectory(prefix="suffixes-") as folder:
        where = folder if len(c.text) > memory_rows else None
        held, new = Rows(c.kinds, where, "0"), Rows(c.kinds, where, "1")
        current, rank = c.ends, np.arange(len(strings), dtype=np.int64)  # the empty suffixes: a string ends at `ends`
        held.append(current.astype(np.int32), np.zeros(len(current), np.uint8), c.text[current - 1])
        counts = Counts(c.symbols)
        counts.recount(c.text[current - 1])
        for _ in range(c.rounds):
            goes_on = c.text[current - 1] != 0
            new.start()
            current, rank = insert_column(c, counts, held, new, current[goes_on], rank[goes_on], block_rows)
            held, new = new, held
        parts = [x[:2] for x in held.read(block_rows)]
        held.close()
        new.close()
    return np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts]), c.starts


def first_windows(window: int, mer: int, block_rows: int = BLOCK_ROWS, memory_rows: int = MEMORY_ROWS):
    """Bucket worker: marks the windows that occur in an earlier string of their group.

    A window holds its bucket's minimiser and ``window - mer`` bytes around it. Windows are told apart into
    ``SIDES`` classes by how many of these stand in front; those of a class have a stretch of bytes in
    common, and a window whose stretch no other string of the bucket has cannot repeat. Only the part of
    a string that is left, from its first to its last window that may repeat, enters the collection."""
    step = -(-(window - mer) // SIDES)

    def stretches(packed: bytes, at: int) -> list[bytes | None]:
        found = []
        for k in range(SIDES):
            front, behind = min(k * step, window - mer), max(0, window - mer - (k + 1) * step)
            found.append(packed[at - front : at + mer + behind] if at >= front and at + mer + behind <= len(packed) else None)
        return found

    def mark(groups: list[Group]) -> list[list[np.ndarray]]:
        strings, row, home, cuts, out = [], [], [], [], []
        for number, group in enumerate(groups):
            every = [stretches(packed, at) for _, packed, _, at in group]
            times = Counter((k, x) for found in every for k, x in enumerate(found) if x is not None)
            for (place, packed, n, at), found in zip(group, every, strict=True):
                # class k has k * step bytes in front, up to those of the next class: windows at - (k + 1) * step + 1 ... at - k * step
                open_ = [k for k, x in enumerate(found) if x is not None and times[k, x] > 1]
                first = max(0, at - (open_[-1] + 1) * step + 1) if open_ else 0
                last = min(n, at - open_[0] * step + 1) if open_ else 0
                out.append((number, n, first))
                if first < last:
                    strings.append(packed[first : last - 1 + window])
                    row.append(place)
                    home.append(number)
                    cuts.append(len(out) - 1)
        found: list[list[np.ndarray]] = [[] for _ in groups]
        masks = dict(zip(cuts, _later(strings, np.array(row), np.array(home), window, block_rows, memory_rows), strict=True)) if strings else {}
        for k, (number, n, first) in enumerate(out):
            whole = np.zeros(n, bool)
            if k in masks:
                whole[first : first + len(masks[k])] = masks[k]
            found[number].append(whole)
        return found

    return mark


def _later(strings: list[bytes], row: np.ndarray, home: np.ndarray, window: int, block_rows: int, memory_rows: int) -> list[np.ndarray]:
    """Per string, which of its windows occur in a string of its group that stands before it."""
    pos, lcp, starts = collection(strings, window, block_rows, memory_rows)
    owner = np.searchsorted(starts, pos, "right") - 1
    offset = pos - starts[owner]
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    full = lengths[owner] - offset >= window
    owner, offset, kin = owner[full], offset[full], np.cumsum(lcp < window)[full]
    kin = kin * (int(home.max()) + 1) + home[owner]
    order = np.argsort(kin, kind="stable")
    owner, offset, kin = owner[order], offset[order], kin[order]
    begin = np.flatnonzero(np.r_[True, kin[1:] != kin[:-1]])
    # a string holds its bucket's minimiser once, so a window stands once in a string
    early = row[owner]
    least = np.repeat(np.minimum.reduceat(early, begin), np.diff(np.r_[begin, len(kin)]))
    ends = np.cumsum(lengths - window + 1)
    flat = np.zeros(int(ends[-1]), bool)
    flat[(ends - (lengths - window + 1))[owner] + offset] = early > least
    return np.split(flat, ends[:-1])


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, mer: int = MER, limit: int = LIMIT, **collection_limits) -> tuple[DataFrame, DataFrame]:
    """(rows, results): one result per distinct text: (h1, h2, first, n_bytes, n_removed, n_spans,
    kept), for the first document that has it; all others lose every byte (if a window fits)."""
    units = Bytes(window, mer)
    rows, texts = repeated_spans(docs, id_col, text_col, units, first_windows(window, mer, **collection_limits), keep_first=True, limit=limit, chunk_bytes=COLLECTION_BYTES)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, starts, ends = span_columns(batch.column(6))
            total, gone, runs_, kept = [], [], [], []
            for k, data in enumerate(text_slices(batch.column(3))):
                lo, hi = offsets[k], offsets[k + 1]
                total.append(len(data))
                if lo == hi:
                    gone.append(0)
                    runs_.append(0)
                    kept.append(bytes(data))
                    continue
                mask = covered(len(data), starts[lo:hi], ends[lo:hi])
                gone.append(int(np.count_nonzero(mask)))
                runs_.append(int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1])))
                kept.append(np.frombuffer(data, np.uint8)[~mask].tobytes())
            columns = [batch.column(1), batch.column(4), batch.column(2), *(pa.array(x, pa.int64()) for x in (total, gone, runs_)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "first", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = f"h1 long, h2 long, first {id_type}, n_bytes long, n_removed long, n_spans long, kept binary"
    return rows, texts.mapInArrow(run, schema)


def _per_row(rows: DataFrame, results: DataFrame, kept: str, nothing, window: int) -> DataFrame:
    joined = rows.join(results, ["h1", "h2"])
    copy = ~F.col("id").eqNullSafe(F.col("first")) & (F.col("n_bytes") >= window)
    return joined.select(
        "id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, nothing).otherwise(F.col(kept)).alias(kept),
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every row; kept is binary, as a cut may fall inside a character."""
    rows, results = repeated_bytes(docs, id_col, text_col, window)
    return _per_row(rows, results.distinct(), "kept", F.lit(b""), window).withColumnRenamed("id", id_col)


def suffix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of ``op2``."""
    rows, results = repeated_bytes(docs, id_col, text_col)
    digests = results.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept").distinct()
    return _per_row(rows, digests, "kept_sha256", F.lit(hashlib.sha256(b"").hexdigest()), WINDOW).withColumnRenamed("id", id_col)


def brute_force(texts: list[tuple], window: int = WINDOW) -> list[tuple]:
    """Reference for tests over (id, text) rows with distinct ids."""
    seen: set[bytes] = set()
    out = {}
    for key, text in sorted(set(texts), key=lambda r: (r[0] is not None, r[0])):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - window + 1):
            w = raw[k : k + window]
            if w in seen:
                gone[k : k + window] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[key] = (key, len(raw), int(gone.sum()), int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1)), hashlib.sha256(kept).hexdigest())
    return [out[key] for key, _ in texts]
