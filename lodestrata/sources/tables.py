"""Tables as versions: readers see whole committed versions while a writer makes the next one.

Data are Parquet files, written first and under names of their own. A commit is one small JSON file with
a number, created without overwriting, that says which of them are the table; so of two writers that
started from the same version one fails and can merge again. A writer that dies leaves either nothing or
a commit that is not whole: readers pass over it, and a writer that meets one older than ``lease`` seconds
takes it out of the way and goes on. A commit carries the last batch of each stream, so a batch that comes
again changes nothing. All access goes through the file system that the address names; on the driver only
commits are held (a row for each file or segment)."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has committed the version in between."""


class CommitLog:
    """Numbered commits of a folder, each a JSON object."""

    def __init__(self, spark: SparkSession, folder: str, lease: float = 60.0):
        self.spark, self.folder, self.lease = spark, folder.rstrip("/"), lease
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, number: int):
        return self._path(f"{self.folder}/versions/{number:012d}.json")

    def _read(self, path) -> dict | None:
        """The commit, or none where it is not there or not whole."""
        if not self._files.exists(path):
            return None
        stream = self._files.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def numbers(self) -> list[int]:
        """Of all commits, whole or not."""
        marks = self._path(f"{self.folder}/versions")
        if not self._files.exists(marks):
            return []
        return sorted(int(n.removesuffix(".json")) for n in (s.getPath().getName() for s in self._files.listStatus(marks)) if n.endswith(".json"))

    def get(self, number: int) -> dict | None:
        return self._read(self._at(number))

    def entries(self) -> dict[int, dict]:
        found = {n: self.get(n) for n in self.numbers()}
        return {n: e for n, e in found.items() if e is not None}

    def latest(self) -> tuple[int, dict] | None:
        for number in reversed(self.numbers()):
            if (entry := self.get(number)) is not None:
                return number, entry
        return None

    def commit(self, number: int, entry: dict) -> None:
        """Make ``entry`` the commit ``number``, or raise: the number is taken by a whole commit, or by one that
        a writer is about to finish."""
        path, own = self._at(number), entry | {"writer": uuid.uuid4().hex}
        self._clear(path, number)
        try:
            stream = self._files.create(path, False)
        except Exception as e:  # the file system's own errors: another writer was first, or the folder is gone
            if self._files.exists(path):
                raise Conflict(f"version {number} of {self.folder} is taken") from e
            raise
        try:
            stream.write(bytearray(json.dumps(own).encode()))
        finally:
            stream.close()
        if self.get(number) != own:  # a writer that waited longer than the lease has lost its number
            raise Conflict(f"version {number} of {self.folder} was taken over")

    def _clear(self, path, number: int) -> None:
        if not self._files.exists(path):
            return
        if self._read(path) is not None or time.time() - self._files.getFileStatus(path).getModificationTime() / 1000 < self.lease:
            raise Conflict(f"version {number} of {self.folder} is taken")
        aside = self._path(f"{self.folder}/void/{number:012d}-{uuid.uuid4().hex}")
        self._files.mkdirs(aside.getParent())
        if not self._files.rename(path, aside):
            raise Conflict(f"version {number} of {self.folder} is being taken over")
        if self._read(aside) is not None:  # it was finished at the last moment: it stands
            self._files.rename(aside, path)
            raise Conflict(f"version {number} of {self.folder} is taken")

    def remove(self, number: int, data: list[str] = ()) -> None:
        self._files.delete(self._at(number), False)
        for path in data:
            self._files.delete(self._path(f"{self.folder}/{path}"), True)

    def discard(self, path: str) -> None:
        self._files.delete(self._path(f"{self.folder}/{path}"), True)


def _seen(entry: dict | None, batch: tuple[str, int] | None) -> bool:
    return batch is not None and entry is not None and entry["batches"].get(batch[0], -1) >= batch[1]


def _batches(entry: dict | None, batch: tuple[str, int] | None) -> dict:
    return dict((entry or {}).get("batches", {})) | ({batch[0]: batch[1]} if batch else {})


class VersionedTable:
    """A table that is written as a whole each time."""

    def __init__(self, spark: SparkSession, folder: str, lease: float = 60.0):
        self.spark, self.log = spark, CommitLog(spark, folder, lease)
        self.folder = self.log.folder

    def versions(self) -> dict[int, str]:
        """Committed versions with the folders of their data."""
        return {n: f"{self.folder}/data/{e['data']}" for n, e in self.log.entries().items()}

    def current(self) -> int | None:
        last = self.log.latest()
        return None if last is None else last[0]

    def read(self, version: int | None = None) -> DataFrame:
        """The current version, or an older one that is still kept. The frame goes on reading it while
        newer ones are committed."""
        number = self.current() if version is None else version
        entry = None if number is None else self.log.get(number)
        if entry is None:
            raise FileNotFoundError(f"no version in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/data/{entry['data']}")

    def write(self, rows: DataFrame, based_on: int | None = None, partition_by: list[str] = (), batch: tuple[str, int] | None = None) -> int:
        """Commit ``rows`` as the version after ``based_on`` (none: the current one). With ``batch``, a stream's
        name and a number that grows, a batch that is committed already changes nothing."""
        number = self.current() if based_on is None else based_on
        before = None if number is None else self.log.get(number)
        if _seen(before, batch):
            return number
        number = 0 if number is None else number + 1
        data = uuid.uuid4().hex
        rows.write.partitionBy(*partition_by).parquet(f"{self.folder}/data/{data}")
        try:
            self.log.commit(number, {"data": data, "batches": _batches(before, batch)})
        except Conflict:
            self.log.discard(f"data/{data}")
            raise
        return number

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 5, batch: tuple[str, int] | None = None) -> int:
        """Commit ``change(current rows)``; begins again from the newer version where another writer was first."""
        for _ in range(tries):
            base = self.current()
            if _seen(None if base is None else self.log.get(base), batch):
                return base
            try:
                return self.write(change(self.read(base)), base, batch=batch)
            except Conflict:
                continue
        raise Conflict(f"{self.folder}: no commit in {tries} tries")

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the newest ``keep`` versions."""
        known = self.log.entries()
        for number in sorted(known)[: -keep or None]:
            self.log.remove(number, [f"data/{known[number]['data']}"])


class KeyedTable:
    """Rows with a unique key (integers or text) in files of disjoint key ranges. An upsert writes the ranges
    that its keys fall in anew and leaves all other files as they are."""

    def __init__(self, spark: SparkSession, folder: str, key: str, rows_per_file: int = 1_000_000, lease: float = 60.0):
        self.spark, self.key, self.rows_per_file, self.log = spark, key, rows_per_file, CommitLog(spark, folder, lease)
        self.folder = self.log.folder

    def files(self) -> list[dict]:
        """(path, low, high, rows) of the current files, in order of their keys."""
        last = self.log.latest()
        return last[1]["files"] if last else []

    def read(self, version: int | None = None) -> DataFrame:
        last = self.log.latest() if version is None else (version, self.log.get(version))
        if last is None or last[1] is None:
            raise FileNotFoundError(f"no version in {self.folder}")
        return self._rows(last[1], last[1]["files"])

    def _rows(self, entry: dict, files: list[dict]) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{f['path']}" for f in files])

    def upsert(self, changes: DataFrame, order: list[str] | None = None, deleted: Column | None = None, batch: tuple[str, int] | None = None, tries: int = 5) -> int:
        """Rows of new keys are added, those of known keys replaced, where ``deleted`` holds removed. Of changes
        with one key the last by ``order`` counts (without: any one of them). ``batch`` as in ``VersionedTable``.
        Null keys raise."""
        for _ in range(tries):
            last = self.log.latest()
            number, entry = last if last else (-1, None)
            if _seen(entry, batch):
                return number
            made, files = self._merged(changes, order, deleted, entry)
            schema = entry["schema"] if entry else changes.schema.jsonValue()
            try:
                self.log.commit(number + 1, {"files": files, "schema": schema, "batches": _batches(entry, batch)})
                return number + 1
            except Conflict:
                self.log.discard(made)
        raise Conflict(f"{self.folder}: no commit in {tries} tries")

    def _merged(self, changes: DataFrame, order: list[str] | None, deleted: Column | None, entry: dict | None) -> tuple[str, list[dict]]:
        known = entry["files"] if entry else []
        kinds = StructType.fromJson(entry["schema"]) if entry else changes.schema
        columns = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kinds]
        gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
        marked = changes.withColumns({"_gone": gone, "_range": range_of(F.col(self.key), [f["low"] for f in known])})
        place = F.row_number().over(Window.partitionBy(self.key).orderBy(*[F.desc(c) for c in order or [self.key]]))
        one = marked.withColumn("_place", place).filter("_place = 1")
        # a row for each range, of which there are as many as files
        touched = {r["_range"]: r["n"] for r in one.groupBy("_range").agg(F.count("*").alias("n")).collect()}
        stale = [f for k, f in enumerate(known) if k in touched]
        new = one.filter(~F.col("_gone")).select(*columns, "_range")
        rows = new
        if stale:
            old = self._rows(entry, stale).withColumn("_range", range_of(F.col(self.key), [f["low"] for f in known]))
            rows = old.join(one.select(self.key), self.key, "left_anti").select(*columns, "_range").unionByName(new)
        parts = -(-(sum(f["rows"] for f in stale) + sum(touched.values())) // self.rows_per_file)
        made = f"data/{uuid.uuid4().hex}"
        rows.repartitionByRange(max(1, parts), "_range", self.key).sortWithinPartitions("_range", self.key).write.partitionBy("_range").parquet(f"{self.folder}/{made}")
        fresh = self._stats(made, kinds) if touched else []
        return made, sorted([f for k, f in enumerate(known) if k not in touched] + fresh, key=lambda f: f["low"])

    def _stats(self, made: str, schema: StructType) -> list[dict]:
        written = self.spark.read.schema(schema).parquet(f"{self.folder}/{made}")
        found = written.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count("*").alias("rows"), F.count_if(F.col(self.key).isNull()).alias("nulls")).collect()
        if any(r["nulls"] for r in found):
            self.log.discard(made)
            raise ValueError(f"{self.key} must not be null")
        return [{"path": f"{made}/{r['path'].split(made + '/', 1)[1]}", "low": r["low"], "high": r["high"], "rows": r["rows"]} for r in found]

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the newest ``keep`` versions, and the files that only these had."""
        known = self.log.entries()
        old = sorted(known)[: -keep or None]
        used = {f["path"] for n, e in known.items() if n not in old for f in e["files"]}
        for number in old:
            self.log.remove(number, [f["path"] for f in known[number]["files"] if f["path"] not in used])


def range_of(key: Column, lows: list) -> Column:
    """Which of the ranges that begin at ``lows`` (sorted) a key falls in; keys below the first are in it too."""
    if not lows:
        return F.lit(0).cast("long")

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        text = isinstance(lows[0], str)
        edges = np.array(lows, dtype=object if text else np.int64)
        for keys in batches:
            # null keys raise later, so any range does for them
            known = keys.fillna(lows[0]).to_numpy(object if text else np.int64)
            yield pd.Series(np.maximum(np.searchsorted(edges, known, "right") - 1, 0), dtype="int64")

    return run(key)
