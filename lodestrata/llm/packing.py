"""Token ids packed into fixed-length rows by best-fit decreasing.

Texts are encoded with a public vocabulary file (its path is a parameter), an end token follows each
document, and documents longer than a row are cut into row-sized pieces plus a rest, so no token is
lost. Pieces of a block of ``block_tokens`` tokens are placed longest first into the open row with
the least sufficient room, found by descending a segment tree over the room values. A block is
bounded, so the memory of a task does not depend on its input.

Output, one row per packed sequence: (shard, block, row) names it; ``input_ids`` is a row of the id
matrix (little endian, ``dtype`` wide, padded with the end token); ``cu_seqlens`` are the cumulative
segment lengths; ``position_resets`` the places at which positions start from 0 again; ``doc_ids``
and ``offsets`` say which document each segment is from and at which of its tokens it starts.

Defined results: a null or empty text is its end token alone; rows that repeat an id are packed each
for itself; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokeniser pattern that belongs to the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_TOKEN = 50_256
SEQ_LEN = 2_048
BLOCK_TOKENS = 1 << 22
SCHEMA = "shard int, block int, row int, n_tokens int, doc_ids array<{id}>, offsets array<long>, cu_seqlens array<int>, position_resets array<int>, input_ids binary"


def load_encoder(path: str = VOCABULARY, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class _Irregular(Exception):
    pass


class WordCache(dict):
    """Encodes texts word by word, with the ids of frequent words remembered.

    The pattern always breaks right before a space that a non-space follows, so a text is the
    concatenation of its words encoded each with its leading space. Where a space is followed by
    more white space that does not hold, and the whole text is encoded at once.
    """

    def __init__(self, encoder, dtype: str, entries: int = 400_000, longest: int = 48):
        super().__init__()
        self.encoder, self.dtype, self.entries, self.longest = encoder, dtype, entries, longest

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise _Irregular
        found = self._ids(" " + word)
        if len(word) <= self.longest:
            if len(self) >= self.entries:
                self.clear()
            self[word] = found
        return found

    def _ids(self, text: str) -> bytes:
        return np.array(self.encoder.encode_ordinary(text), self.dtype).tobytes()

    def encode(self, text: str) -> np.ndarray:
        first, *words = text.split(" ")
        try:
            found = b"".join([self._ids(first), *map(self.__getitem__, words)])
        except _Irregular:
            found = self._ids(text)
        return np.frombuffer(found, self.dtype)


class RoomTree:
    """Segment tree over room 0..capacity: which rooms have an open row, and the least one that suffices."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.base
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) with the smallest room >= least, removed from the tree."""
        at = least + self.base
        if not self.count[at]:
            while at > 1 and not (at & 1 == 0 and self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.base:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.base
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of piece numbers; ties keep the input's order."""
    rows: list[list[int]] = []
    tree = RoomTree(capacity)
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        if (found := tree.take(size)) is None:
            found = capacity, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(k)
        tree.add(room - size, row)
    return rows


def split_pieces(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, offset, length) of every piece; the pieces of a document tile it."""
    count = np.maximum(1, -(-lengths // capacity))
    doc = np.repeat(np.arange(len(lengths)), count)
    offset = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * capacity
    return doc, offset, np.minimum(capacity, lengths[doc] - offset)


def pack_block(ids: list, tokens: list[np.ndarray], seq_len: int, end_token: int, dtype: str) -> Iterator[tuple]:
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    doc, offset, size = split_pieces(lengths, seq_len)
    for row in best_fit_decreasing(size, seq_len):
        matrix = np.full(seq_len, end_token, dtype)
        ends = np.concatenate([[0], np.cumsum(size[row])]).astype(np.int32)
        for k, a, b in zip(row, ends, ends[1:], strict=False):
            matrix[a:b] = tokens[doc[k]][offset[k] : offset[k] + size[k]]
        yield int(ends[-1]), [ids[doc[k]] for k in row], offset[row].tolist(), ends.tolist(), ends[:-1].tolist(), matrix.tobytes()


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seq_len: int = SEQ_LEN,
    vocabulary: str = VOCABULARY,
    end_token: int = END_TOKEN,
    block_tokens: int = BLOCK_TOKENS,
    dtype: str = "<u2",
) -> DataFrame:
    """Packed sequences of all rows of ``docs``; see the module's text for the columns."""
    kind = docs.schema[id_col].dataType
    schema = SCHEMA.format(id=kind.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordCache(load_encoder(vocabulary), dtype)
        end = np.array([end_token], dtype)
        shard, block = TaskContext.get().partitionId(), 0
        id_type = None
        ids, tokens, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(enumerate(pack_block(ids, tokens, seq_len, end_token, dtype)))
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            for at in range(0, len(rows), 2048):
                columns = zip(*[(shard, block, k, *r) for k, r in rows[at : at + 2048]], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            id_type = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.concatenate([encoder.encode(text.as_py() or ""), end])
                ids.append(key)
                tokens.append(found)
                held += len(found)
                if held >= block_tokens:
                    yield from flush()
                    ids, tokens, held, block = [], [], 0, block + 1
        if ids:
            yield from flush()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def position_ids(cu_seqlens: list[int], seq_len: int = SEQ_LEN) -> np.ndarray:
    """Positions of a packed row: 0, 1, ... from every reset; the padding counts from 0 as well."""
    marks = np.zeros(seq_len, np.int64)
    starts = np.array([*cu_seqlens[:-1], *([cu_seqlens[-1]] if cu_seqlens[-1] < seq_len else [])])
    marks[starts] = np.diff(starts, prepend=0)
    return np.arange(seq_len) - np.cumsum(marks)


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet, a folder for each shard, readable on its own."""
    packed.write.mode("errorifexists").partitionBy("shard").parquet(path)


def unpack(packed: DataFrame, dtype: str = "<u2") -> DataFrame:
    """(id, offset, ids): every segment of the packed rows, for an exact round trip."""
    segments = packed.select("input_ids", F.explode(F.arrays_zip("doc_ids", "offsets", F.slice("cu_seqlens", 1, F.size("cu_seqlens") - 1).alias("a"), F.slice("cu_seqlens", 2, F.size("cu_seqlens") - 1).alias("b"))).alias("s"))
    width = np.dtype(dtype).itemsize
    cut = F.substring("input_ids", F.col("s.a") * width + 1, (F.col("s.b") - F.col("s.a")) * width)
    return segments.select(F.col("s.doc_ids").alias("id"), F.col("s.offsets").alias("offset"), cut.alias("ids"))
