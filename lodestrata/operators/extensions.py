"""What a user plugs in: text embedders, vector stores, query planners, analysers, rerankers and the search
function under test; and the parts of images that are arithmetic on arrays."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.planner import Plan, parse
from . import metrics as M
from . import retrieval as R
from . import sinks


#: Texts that are given to an embedder at once.
SLICE = 256


class TextEmbedder(ABC):
    """Unit vectors of texts; ``column`` runs ``embed`` over slices of Arrow batches."""

    name: str
    version = "1"
    dimension: int

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray:
        """(texts, dimension) float32; blank texts are zero vectors."""

    def one(self, text: str) -> list[float]:
        return self.embed([text])[0].tolist()

    def column(self, text: Column) -> Column:
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                parts = [self.embed([x or "" for x in batch.slice(at, SLICE).to_pylist()]) for at in range(0, len(batch), SLICE)]
                # one flat array of numbers, no object for each vector
                flat = np.concatenate(parts) if parts else np.empty((0, self.dimension), np.float32)
                ends = np.arange(len(flat) + 1, dtype=np.int32) * self.dimension
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.float32, copy=False).reshape(-1)))

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "array<float>")(text)


class HashedWords(TextEmbedder):
    """A deterministic embedder without a model: every word adds a signed unit at two hashed places."""

    def __init__(self, dimension: int = 64):
        self.name, self.dimension = "hashed-words", dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        import hashlib

        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                for at in (h & 0xFFFF, h >> 16 & 0xFFFF):
                    out[row, at % self.dimension] += 1 if h >> 40 & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


class VectorStore:
    """Vectors of entities by model: add, query, delete. A filter is a predicate on the entity id."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def add(self, new: DataFrame) -> VectorStore:
        return VectorStore(sinks.store_vectors(self.rows, new))

    def delete(self, entity_type: str, ids: DataFrame) -> VectorStore:
        return VectorStore(sinks.delete_vectors(self.rows, entity_type, ids))

    def query(self, vector: list[float], model_name: str, k: int = 10, threshold: float | None = None, keep: Callable[[Column], Column] | None = None) -> DataFrame:
        """(id, score) of the nearest by cosine; a query without direction finds nothing."""
        of_model = self.rows.filter(F.col("model_name") == model_name)
        if not any(vector):
            return of_model.limit(0).select(F.col("entity_id").alias("id"), F.lit(0.0).alias("score"))
        return R.knn(of_model, vector, k, "entity_id", "vector", threshold, None if keep is None else keep(F.col("entity_id")))


class QueryPlanner(ABC):
    @abstractmethod
    def plan(self, sentence: str, now: date, persons: dict[str, str]) -> Plan: ...


class GrammarPlanner(QueryPlanner):
    def plan(self, sentence: str, now: date, persons: dict[str, str]) -> Plan:
        return parse(sentence, now, persons)


class Analyser(ABC):
    """Understands files: a model behind it gives JSON, which ``functions.text.recovered_json`` reads."""

    name: str
    version: str

    @abstractmethod
    def available(self) -> bool: ...

    @abstractmethod
    def analyse(self, files: DataFrame) -> DataFrame:
        """(file_id, raw_response)."""


class NoAnalyser(Analyser):
    name, version = "none", "0"

    def available(self) -> bool:
        return False

    def analyse(self, files: DataFrame) -> DataFrame:
        return files.limit(0).select("file_id", F.lit(None).cast("string").alias("raw_response"))


#: A search function under test: sentence and category to rows with ``path``, best first by ``rank``.
Search = Callable[[str, str | None], DataFrame]


def evaluated(search: Search, queries: list[tuple], k: int = 10) -> DataFrame:
    """Metrics of ``queries``(query_id, sentence, category, target files)."""
    spark = None
    runs = None
    for query_id, sentence, category, _ in queries:
        found = search(sentence, category)
        spark = found.sparkSession
        ranked = found if "rank" in found.columns else found.withColumn("rank", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))
        rows = ranked.select(F.lit(query_id).alias("query_id"), F.col("path").alias("item"), "rank")
        runs = rows if runs is None else runs.unionByName(rows)
    qrels = spark.createDataFrame([(q, t, 1) for q, _, _, targets in queries for t in targets], "query_id string, item string, gain int")
    return M.per_query(runs.withColumn("query_id", F.col("query_id").cast("string")), qrels, k)


# ---------------------------------------------------------------- images as arrays

SIDE, LOW = 32, 8


def cosine_transform(n: int = SIDE) -> np.ndarray:
    """The orthonormal DCT-II as a matrix."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return (np.sqrt(np.where(k == 0, 1, 2) / n) * np.cos((2 * x + 1) * k * np.pi / (2 * n))).astype(np.float32)


def perceptual_hash(grey: np.ndarray) -> int:
    """64 bits of a 32 x 32 grey image: which low frequencies lie above the median of those that are not constant."""
    d = cosine_transform()
    low = (d @ grey.astype(np.float32).reshape(SIDE, SIDE) @ d.T)[:LOW, :LOW]
    return int.from_bytes(np.packbits((low > np.median(low[1:, 1:])).ravel()).tobytes(), "big")


def perceptual_hashes(images: DataFrame, pixels: str = "pixels") -> DataFrame:
    """``images`` with ``phash`` (16 hex digits) and ``hash`` (the same as signed long), null for images that
    are not 32 x 32 or have unknown pixels. Images that share bits are found by ``duplicates.hamming_pairs``."""

    at = images.columns.index(pixels)
    schema = images.withColumn("phash", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [x.values for x in batch.column(at)]
            found = [None if x is None or len(x) != SIDE * SIDE or x.null_count else f"{perceptual_hash(x.to_numpy()):016x}" for x in values]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], schema.names)

    return images.mapInArrow(run, schema).withColumn("hash", F.conv("phash", 16, -10).cast("long"))
