"""A stream of file changes: a Python data source over the listings of folders that come and go.

    spark.dataSource.register(FolderChanges)
    spark.readStream.format("folder_changes").options(subscriptions=..., journal=...).load()

``subscriptions`` is a text file with a folder on each line. It is read again for every batch, so folders are
added and removed while the stream runs; the files of a folder that is taken off it are reported as
deleted. A batch compares the listing (paths, sizes, times; database files and what ``ignored`` names are left
out) with the one before and writes what differs to ``journal`` as one numbered file, put in place by a rename.
The offset is that number, so a stream that starts again from its checkpoint reads the same changes again and then
goes on; every ``SNAPSHOT`` numbers the whole listing is written, and a restart replays what came after it.

The driver lists names and never opens files. Created and modified files are hashed where they are read, in tasks
of ``FILES`` files each, piece by piece. A file that is gone when its task comes has a null hash.

Events: (ts, event_type, path, size_bytes, content_hash) with created, modified and deleted. ``moves`` makes a
deletion and a creation with one content a move, which is a join with the catalogue's hashes and not the source's
business.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "ts timestamp, event_type string, path string, size_bytes bigint, content_hash string"
FILES, SNAPSHOT, PIECE = 500, 200, 1 << 20
#: What a watcher leaves out: databases and their journals, hidden files, unfinished downloads.
IGNORED = (".db", ".sqlite", ".sqlite3", "-wal", "-shm", "-journal", ".tmp", ".crdownload", ".part")


def _system(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def _text(uri: str) -> str | None:
    files, path = _system(uri)
    if files.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
        return None
    with files.open_input_stream(path, compression=None) as f:
        return f.read().decode()


class Changes(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class FolderReader(DataSourceStreamReader):
    def __init__(self, subscriptions: str, journal: str):
        self.subscriptions, self.journal = subscriptions, journal
        self.number, self.known = 0, {}
        self._restored = False

    # ------------------------------------------------------------ journal

    def _name(self, number: int, kind: str = "changes") -> str:
        return f"{self.journal.rstrip('/')}/{number:012d}-{kind}.json"

    def _put(self, uri: str, value) -> None:
        files, path = _system(uri)
        files.create_dir(os.path.dirname(path), recursive=True)
        with files.open_output_stream(f"{path}.{os.getpid()}.tmp", compression=None) as f:
            f.write(json.dumps(value).encode())
        files.move(f"{path}.{os.getpid()}.tmp", path)

    def _restore(self) -> None:
        """The last listing: the newest snapshot and the changes after it."""
        files, root = _system(self.journal)
        names = [] if files.get_file_info(root).type == pyarrow.fs.FileType.NotFound else sorted(os.path.basename(i.path) for i in files.get_file_info(pyarrow.fs.FileSelector(root)) if i.path.endswith(".json"))
        snapshots = [int(n[:12]) for n in names if n.endswith("-listing.json")]
        self.number = max(snapshots, default=0)
        self.known = {p: tuple(v) for p, v in json.loads(_text(self._name(self.number, "listing"))).items()} if snapshots else {}
        for n in sorted(int(n[:12]) for n in names if n.endswith("-changes.json")):
            if n > self.number:
                self._apply(json.loads(_text(self._name(n))))
                self.number = n
        self._restored = True

    def _apply(self, changes: list) -> None:
        for _, kind, path, size, changed in changes:
            if kind == "deleted":
                self.known.pop(path, None)
            else:
                self.known[path] = (size, changed)

    # ------------------------------------------------------------ offsets

    def initialOffset(self) -> dict:
        return {"number": 0}

    def latestOffset(self) -> dict:
        if not self._restored:
            self._restore()
        now, listing = time.time(), self._listing()
        changes = [(now, "deleted", p, *self.known[p]) for p in sorted(self.known.keys() - listing.keys())]
        changes += [(now, "modified" if p in self.known else "created", p, *listing[p]) for p in sorted(listing) if self.known.get(p) != listing[p]]
        if changes:
            self.number += 1
            self._put(self._name(self.number), changes)
            self._apply(changes)
            if self.number % SNAPSHOT == 0:
                self._put(self._name(self.number, "listing"), self.known)
        return {"number": self.number}

    def _listing(self) -> dict[str, tuple[int, int]]:
        found = {}
        for folder in dict.fromkeys(line.strip() for line in (_text(self.subscriptions) or "").splitlines()):
            if not folder:
                continue
            files, root = _system(folder)
            for i in files.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True, recursive=True)):
                name = i.base_name.lower()
                if i.type == pyarrow.fs.FileType.File and not name.startswith((".", "~$")) and not name.endswith(IGNORED):
                    found[i.path] = (i.size, int(i.mtime_ns or 0))
        return found

    def partitions(self, start: dict, end: dict) -> list[Changes]:
        rows = [tuple(r) for n in range(start["number"] + 1, end["number"] + 1) for r in json.loads(_text(self._name(n)) or "[]")]
        return [Changes(rows[k : k + FILES]) for k in range(0, len(rows), FILES)]

    def read(self, partition: Changes) -> Iterator[tuple]:
        for at, kind, path, size, _ in partition.rows:
            digest = None if kind == "deleted" else content_hash(path)
            yield datetime.fromtimestamp(at, timezone.utc), kind, path, size, digest

    def commit(self, end: dict) -> None:
        """Journal files stay: a stream may be started again from an older checkpoint."""


def content_hash(path: str) -> str | None:
    files, at = _system(path)
    digest = hashlib.sha256()
    try:
        with files.open_input_stream(at, compression=None) as f:
            while piece := f.read(PIECE):
                digest.update(piece)
    except OSError:
        return None
    return digest.hexdigest()


class FolderChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(self.options["subscriptions"], self.options["journal"])


def moves(events: DataFrame, known: DataFrame) -> DataFrame:
    """``events`` (a batch of them) with ``dest``: a deleted and a created path of one content are one ``moved``.
    ``known`` (path, content_hash) is the catalogue before the batch. Of several with one content the smallest
    paths pair up, in order; what is left over stays deleted or created. Null hashes never pair."""
    gone = events.filter("event_type = 'deleted'").drop("content_hash").join(known.select("path", "content_hash").dropDuplicates(["path"]), "path", "left")
    place = lambda c: F.row_number().over(Window.partitionBy("content_hash").orderBy(c))
    old = gone.filter("content_hash is not null").withColumn("_n", place("path")).select("content_hash", "_n", F.col("path").alias("_from"))
    new = events.filter("event_type = 'created' and content_hash is not null").withColumn("_n", place("path")).select("content_hash", "_n", F.col("path").alias("_to"))
    pairs = old.join(new, ["content_hash", "_n"]).select("_from", "_to")
    full: Column = F.col("event_type")
    by_from, by_to = pairs.withColumnRenamed("_from", "path"), pairs.select(F.col("_to").alias("path"), F.lit(True).alias("_came"))
    met = events.join(by_from, "path", "left").join(by_to, "path", "left")
    kept = met.filter(~((full == "created") & F.coalesce("_came", F.lit(False))))
    moved = (full == "deleted") & F.col("_to").isNotNull()
    return kept.select("ts", F.when(moved, "moved").otherwise(full).alias("event_type"), "path", F.when(moved, F.col("_to")).alias("dest"), "size_bytes", "content_hash")
