"""Substring dedup: word windows that occur more than once, by super-k-mer partitioning.

Consecutive windows that share a minimiser travel as one packed string to the minimiser's bucket,
where sorting the windows counts them exactly (see ``superwindows`` for the distributed frame and
for how large buckets are dealt out). Every word under a window that occurs anywhere else goes.

Defined results: null and wordless texts have no words; texts shorter than a window lose nothing;
rows that agree in id and text are one document and each get its result; rows that share only the
id are documents of their own.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices
from .superwindows import LIMIT, Group, Words, covered, repeated_spans, span_columns, window_bytes

WINDOW, MER = 35, 8


def sorted_counts(units: Words):
    """Bucket worker: windows of a group's distinct strings, sorted, counted as runs of equals."""

    def mark(groups: list[Group]) -> list[list[np.ndarray]]:
        out = []
        for group in groups:
            windows = sorted((w, s, o) for s, (_, packed, n, _) in enumerate(group) for o, w in enumerate(window_bytes(units, packed, n)))
            masks = [np.zeros(n, bool) for _, _, n, _ in group]
            for (w, s, o), (v, t, q) in zip(windows, windows[1:], strict=False):
                if w == v:
                    masks[s][o] = masks[t][q] = True
            out.append(masks)
        return out

    return mark


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, mer: int = MER, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(rows, results): see ``superwindows.repeated_spans``; results has one row per distinct text:
    (h1, h2, n_words, n_removed, kept), kept being the remaining words joined by one space."""
    units = Words(window, mer)
    rows, texts = repeated_spans(docs, id_col, text_col, units, sorted_counts(units), keep_first=False, limit=limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many, (offsets, starts, ends) = batch.column(5).to_pylist(), span_columns(batch.column(6))
            total, gone, kept = [], [], []
            for k, data in enumerate(text_slices(batch.column(3))):
                words = bytes(data).split()
                lo, hi = offsets[k], offsets[k + 1]
                mask = np.full(len(words), True) if many[k] and len(words) >= window else covered(len(words), starts[lo:hi], ends[lo:hi])
                total.append(len(words))
                gone.append(int(mask.sum()))
                kept.append(b" ".join(w for w, m in zip(words, mask.tolist(), strict=True) if not m) if gone[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(4), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["h1", "h2", "n_words", "n_removed", "kept"])

    return rows, texts.mapInArrow(run, "h1 long, h2 long, n_words long, n_removed long, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept text) of every row."""
    rows, results = repeated_words(docs, id_col, text_col, window)
    return rows.join(results.distinct(), ["h1", "h2"]).select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))


def substring_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of ``op3``."""
    rows, results = repeated_words(docs, id_col, text_col)
    digests = results.select("h1", "h2", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")).distinct()
    return rows.join(digests, ["h1", "h2"]).select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256")


def brute_force(texts: list[tuple], window: int = WINDOW) -> list[tuple]:
    """Reference for tests over (id, text) rows."""
    counts: Counter = Counter()
    words = {row: ((row[1] or "").encode()).split() for row in set(texts)}
    for w in words.values():
        counts.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    out = []
    for row in texts:
        w = words[row]
        gone = {j for k in range(len(w) - window + 1) if counts[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((row[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
