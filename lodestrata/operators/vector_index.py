"""Exact nearest vectors over a stored index that reads only the files that can hold one.

Vectors of one model are kept as unit vectors in balls: a ball has a centre, and its files a radius each, so the
cosine with a query is at most (2 - max(0, d - R)^2) / 2 where d is the distance of query and centre. A query
reads the files with the largest bounds first and then those whose bound reaches the k-th score found there;
others are not opened. Bounds and file names are in the commit (``sources.tables.CommitLog``), which is
what the driver holds: a row for each file. Additions go to new files of their ball, replaced and deleted
vectors have their own files written anew, and all others stay as they are.

Defined results: as ``retrieval.knn`` for what is stored: ties go to the smaller id; vectors without direction (null,
zero, or with unknown components) have no cosine and are not stored; a query without direction finds
nothing; of vectors with one id the last one added stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..sources.tables import CommitLog, Conflict, _batches, _seen
from . import vectors as V
from .retrieval import dot, top

#: Vectors of a ball, balls at most, files that a query reads first.
BALL, BALLS, FIRST = 4096, 4096, 4
CLOSE = 1e-9


class VectorIndex:
    def __init__(self, spark: SparkSession, folder: str, ball: int = BALL, lease: float = 60.0):
        self.spark, self.ball, self.log = spark, ball, CommitLog(spark, folder, lease)
        self.folder = self.log.folder
        self.read_last: list[str] = []  # files that the last query read

    def state(self) -> dict:
        last = self.log.latest()
        return last[1] if last else {"centres": [], "files": [], "schema": None, "batches": {}}

    def files(self) -> list[dict]:
        """(path, ball, radius, rows) of the current files."""
        return self.state()["files"]

    def _rows(self, state: dict, files: list[dict]) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(state["schema"])).parquet(*[f"{self.folder}/{f['path']}" for f in files])

    # ------------------------------------------------------------ changes

    def add(self, vectors: DataFrame, id_col: str, vector_col: str, batch: tuple[str, int] | None = None, tries: int = 5) -> int:
        """Store ``vectors``; those with a known id are replaced, and all other columns are kept with them."""
        rest = [c for c in vectors.columns if c not in (id_col, vector_col)]
        rows = V.usable(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), *rest), "v").filter("id is not null").dropDuplicates(["id"])
        norm = F.sqrt(dot(F.col("v"), F.col("v")))
        rows = rows.withColumn("_n", norm).filter("_n > 0").withColumn("v", F.transform("v", lambda x: F.try_divide(x, F.col("_n")))).drop("_n")
        return self._change(rows, rows.select("id"), batch, tries)

    def delete(self, ids: DataFrame, batch: tuple[str, int] | None = None, tries: int = 5) -> int:
        return self._change(None, ids.toDF("id").distinct(), batch, tries)

    def _change(self, rows: DataFrame | None, ids: DataFrame, batch: tuple[str, int] | None, tries: int) -> int:
        for _ in range(tries):
            last = self.log.latest()
            number, state = (last[0], last[1]) if last else (-1, self.state())
            if _seen(state, batch):
                return number
            made = f"data/{uuid.uuid4().hex}"
            files, centres, schema = list(state["files"]), state["centres"], state["schema"]
            if rows is not None and not centres:
                V.checkpoints(self.spark)
                rows = rows.checkpoint()
                n = rows.count()
                centres = V._sample(rows, max(1, min(BALLS, -(-n // self.ball) * 2))).tolist()
            parts = [] if rows is None else [rows]
            if files:
                held = self._rows(state, files).select("id", F.col("_metadata.file_path").alias("_file"))
                stale = {"data/" + r["_file"].rsplit("/data/", 1)[1] for r in held.join(ids, "id", "left_semi").select("_file").distinct().collect()}  # files
                old = [f for f in files if f["path"] in stale]
                files = [f for f in files if f["path"] not in stale]
                if old:
                    parts.append(self._rows(state, old).join(ids, "id", "left_anti"))
            new = None
            for p in parts:
                p = p if schema is None else p.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in StructType.fromJson(schema)])
                new = p if new is None else new.unionByName(p)
            if new is not None and centres:
                schema = schema or new.schema.jsonValue()
                files += self._written(new, centres, made)
            try:
                self.log.commit(number + 1, {"centres": centres, "files": files, "schema": schema, "batches": _batches(state, batch)})
                return number + 1
            except Conflict:
                self.log.discard(made)
        raise Conflict(f"{self.folder}: no commit in {tries} tries")

    def _written(self, rows: DataFrame, centres: list, made: str) -> list[dict]:
        placed = _nearest(rows, np.array(centres))
        placed.repartition("_ball").sortWithinPartitions("_ball", "id").write.partitionBy("_ball").parquet(f"{self.folder}/{made}")
        schema = StructType([*placed.schema.fields])
        found = self.spark.read.schema(schema).parquet(f"{self.folder}/{made}").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.first("_ball").alias("ball"), F.max("_apart").alias("radius"), F.count("*").alias("rows")).collect()  # a row for each file
        return [{"path": f"{made}/{r['path'].split(made + '/', 1)[1]}", "ball": r["ball"], "radius": r["radius"], "rows": r["rows"]} for r in found]

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the newest ``keep`` commits, and the files that only these had."""
        known = self.log.entries()
        old = sorted(known)[: -keep or None]
        used = {f["path"] for n, e in known.items() if n not in old for f in e["files"]}
        for number in old:
            self.log.remove(number, [f["path"] for f in known[number]["files"] if f["path"] not in used])

    # ------------------------------------------------------------ search

    def query(self, vector: list[float], k: int = 10, threshold: float | None = None, keep: Column | None = None) -> DataFrame:
        """(id, score): the ``k`` nearest by cosine, of those that ``keep`` (a predicate on the stored columns) lets
        through, from ``threshold`` on."""
        state, q = self.state(), np.asarray(vector, float)
        self.read_last = []
        size = float(np.sqrt((q * q).sum()))
        if not state["files"] or not np.isfinite(size) or size == 0:
            return self._none(state)
        q = q / size
        apart = np.sqrt(((np.array(state["centres"]) - q) ** 2).sum(1))
        bound = {f["path"]: (2 - max(0.0, apart[f["ball"]] - f["radius"] - CLOSE) ** 2) / 2 for f in state["files"]}
        order = sorted(state["files"], key=lambda f: -bound[f["path"]])
        least = -1.0 if threshold is None else threshold
        order = [f for f in order if bound[f["path"]] >= least - CLOSE]
        if not order:
            return self._none(state)
        head = self._scored(state, order[:FIRST], q, k, threshold, keep)
        if len(order) > FIRST:
            found = head.collect()  # k rows
            if len(found) >= k:
                least = max(least, found[-1]["score"])
            order = order[:FIRST] + [f for f in order[FIRST:] if bound[f["path"]] >= least - CLOSE]
            head = self._scored(state, order, q, k, threshold, keep)
        self.read_last = [f["path"] for f in order]
        return head

    def _scored(self, state: dict, files: list[dict], q: np.ndarray, k: int, threshold: float | None, keep: Column | None) -> DataFrame:
        rows = self._rows(state, files)
        rows = rows if keep is None else rows.filter(keep)
        scored = rows.select("id", dot(F.col("v"), F.array(*[F.lit(float(x)) for x in q])).alias("score"))
        return top(scored if threshold is None else scored.filter(F.col("score") >= threshold), k)

    def _none(self, state: dict) -> DataFrame:
        kind = StructType.fromJson(state["schema"])["id"].dataType.simpleString() if state["schema"] else "long"
        return self.spark.createDataFrame([], f"id {kind}, score double")


def _nearest(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` with the number of their nearest centre and the distance from it."""
    names = rows.columns
    at = names.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, V.ROWS):
                part = batch.slice(k, V.ROWS)
                apart = V._apart(V._matrix(part.column(at)), centres)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(apart.min(1)), pa.array(apart.argmin(1))], [*names, "_apart", "_ball"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("_apart", DoubleType()), StructField("_ball", LongType())]))
