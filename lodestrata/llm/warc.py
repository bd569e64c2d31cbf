"""WARC archives of web pages through a chunked record table.

Payloads travel as rows (record, chunk number, at most ``chunk_bytes`` bytes), cut on the JVM side
as each row leaves; the writer streams them into gzip members, one per record, with a running SHA-1
that must end at the digest of the header, and the reader streams them back out as chunk rows that
carry the running SHA-1 and length of the payload so far. Of a record the Python workers hold a chunk
and the header at most; the JVM holds the payload of the one row that it cuts, as the table has it.

Equal payloads of at least ``dedup_bytes`` bytes are stored once: the row with the largest page id
is the response, the others are revisit records that refer to it by record id and repeat its
payload digest. Which is which is decided by an aggregate over digests before anything is written.

Files go to the shared folder through the file system that its address names. A task writes each
file under a name of its own attempt, and its manifest row counts only if the attempt succeeds, so
a retried task leaves no half-written archive in the manifest.

Defined results: a null payload is empty; rows that tie for the largest page id are all responses;
a null page id counts as smallest and is read back as null; a null address is left out of the
header; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persist_table, scratch_path

CHUNK_BYTES = 64 * 1024
DEDUP_BYTES = 1_000
SEGMENT_BYTES = 1 << 28
#: Repeated digests (60 bytes each) that are sent to every task at most; salts beyond.
BROADCAST_ROWS, SALTS = 100_000, 64
READ_TASKS = 100_000
VERSION, STOP = b"WARC/1.0\r\n", b"\r\n\r\n"
CHUNKS = "page_id long, record_type string, refers_to long, declared_digest string, declared_length long, chunk_no int, n_bytes long, running_sha1 string, last boolean, data binary"


def record_id(page_id: int | None) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}"


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", dedup_bytes: int = DEDUP_BYTES) -> DataFrame:
    """(page_id, url, html, n_bytes, digest, refers_to): refers_to is set for revisits only.

    Only digests that repeat are looked up. Up to ``BROADCAST_ROWS`` of them (counted first) go to every
    task and no payload moves; beyond, the join is dealt by digest and ``SALTS`` salts, so the copies
    of one page spread over as many tasks."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("html"))
    rows = rows.select("*", F.octet_length("html").cast("long").alias("n_bytes"), F.sha1(F.col("html").cast("binary")).alias("digest"))
    last = rows.filter(F.col("n_bytes") >= dedup_bytes).groupBy("digest", "n_bytes").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1 and top is not null").drop("n")
    last = persist_table(last, "repeated")
    if last.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(last), ["digest", "n_bytes"], "left")
    else:
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        copies = last.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        joined = dealt.join(copies, ["digest", "n_bytes", "salt"], "left")
    other = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return joined.select("page_id", "url", "html", "n_bytes", "digest", F.when(other, F.col("top")).alias("refers_to"))


def chunked(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk, in order; a revisit or an empty payload is one chunk without bytes. The payload is
    made bytes once, below the chunk numbers, and a chunk is cut from these bytes as its row leaves: the
    cost is linear in the payload, and no task holds a record's chunks."""
    n = F.when(F.col("refers_to").isNotNull(), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / chunk_bytes)).cast("int"))
    whole = rows.select("page_id", "url", "n_bytes", "digest", "refers_to", F.when(F.col("refers_to").isNull(), F.col("html").cast("binary")).alias("payload"))
    numbered = whole.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    data = F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))
    return numbered.select("page_id", "url", "n_bytes", "digest", "refers_to", "chunk_no", data.alias("data"))


def _header(page_id, url, n_bytes, digest, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(page_id)}>", "WARC-Date: 1970-01-01T00:00:00Z", f"Page-Id: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{record_id(refers_to)}>", f"Refers-To-Page-Id: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html", f"Payload-Length: {n_bytes}", f"Content-Length: {n_bytes if refers_to is None else 0}"]
    return VERSION + "\r\n".join(lines).encode() + STOP


def write(rows: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write ``decide``'s rows as .warc.gz files; the manifest (path, n_records, n_bytes) is returned, materialised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, records, size, member, running = None, "", 0, 0, None, None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for page_id, url, n_bytes, digest, refers_to, chunk_no, data in zip(*columns, batch.column(6), strict=True):
                if chunk_no == 0:
                    if member is not None:
                        size += out.write(_ended(member, running))
                    if out is not None and size >= segment_bytes:
                        out.close()
                        yield _manifest(path, records, size)
                        out = None
                    if out is None:
                        files, root = pa.fs.FileSystem.from_uri(folder)
                        files.create_dir(root, recursive=True)
                        name = f"pages-{uuid.uuid4().hex}.warc.gz"
                        out, path, records, size = files.open_output_stream(f"{root}/{name}", compression=None), f"{folder}/{name}", 0, 0
                    member, running = zlib.compressobj(1, zlib.DEFLATED, 31), [hashlib.sha1(), digest if refers_to is None else None]
                    size += out.write(member.compress(_header(page_id, url, n_bytes, digest, refers_to)))
                    records += 1
                if data.is_valid:
                    buffer = data.as_buffer()
                    running[0].update(buffer)
                    size += out.write(member.compress(buffer))
        if out is not None:
            size += out.write(_ended(member, running))
            out.close()
            yield _manifest(path, records, size)

    manifest = chunked(rows, chunk_bytes).mapInArrow(run, "path string, n_records long, n_bytes long")
    return persist_table(manifest, "manifest")


def _ended(member, running: list) -> bytes:
    """The last bytes of a record, whose running digest must have come to the one in its header."""
    if running[1] is not None and running[0].hexdigest() != running[1]:
        raise ValueError("the chunks of a record are not its payload")
    return member.compress(STOP) + member.flush()


def _manifest(path: str, records: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([records], pa.int64()), "n_bytes": pa.array([size], pa.int64())})


class _Members:
    """Byte stream over the gzip members of a file, read piece by piece."""

    def __init__(self, raw, piece: int = 1 << 16):
        self.raw, self.piece, self.held, self.inflate, self.left = raw, piece, b"", zlib.decompressobj(31), b""

    def read(self, most: int) -> bytes:
        """At least one byte, unless the stream has ended."""
        while not self.held:
            if self.inflate.eof:
                self.left, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            data = self.left or self.raw.read(self.piece)
            if not data:
                return b""
            self.held = self.inflate.decompress(data, self.piece)
            self.left = self.inflate.unconsumed_tail
        out, self.held = self.held[:most], self.held[most:]
        return out

    def until(self, mark: bytes) -> bytes:
        """Up to the mark, which is consumed; empty at the end of the stream."""
        got = bytearray()
        while not (data := self.read(self.piece)) == b"":
            start = max(0, len(got) - len(mark) + 1)
            got += data
            if (at := got.find(mark, start)) >= 0:
                self.held = bytes(got[at + len(mark) :]) + self.held
                return bytes(got[:at])
        return bytes(got)


def records(raw: io.RawIOBase | pa.NativeFile, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Chunk rows of one archive, in order."""
    stream = _Members(raw)
    while head := stream.until(STOP):
        if not head.startswith(VERSION.strip()):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
        page_id = int(fields["Page-Id"]) if fields["Page-Id"] else None
        refers = int(fields["Refers-To-Page-Id"]) if "Refers-To-Page-Id" in fields else None
        fixed = page_id, fields["WARC-Type"], refers, fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["Payload-Length"])
        left, done, number, digest = int(fields["Content-Length"]), 0, 0, hashlib.sha1()
        while True:
            data = bytearray()
            while left and len(data) < chunk_bytes:
                got = stream.read(min(left, chunk_bytes - len(data)))
                if not got:
                    raise ValueError("truncated record")
                data += got
                left -= len(got)
            digest.update(data)
            done += len(data)
            yield *fixed, number, done, digest.copy().hexdigest(), left == 0, bytes(data)
            number += 1
            if not left:
                break
        if stream.until(STOP):
            raise ValueError("record does not end where its length says")


def read(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives that a manifest lists, a task for each file (up to
    ``READ_TASKS``, beyond which tasks read several)."""
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, root = pa.fs.FileSystem.from_uri(path)
                with files.open_input_stream(root, compression=None) as raw:
                    held, size = [], 0
                    for row in records(raw, chunk_bytes):
                        held.append(row if with_data else (*row[:-1], None))
                        size += len(row[-1]) * with_data + 200
                        if size >= 1 << 22:
                            yield _batch(held, kinds, names)
                            held, size = [], 0
                    if held:
                        yield _batch(held, kinds, names)

    # an explicit number, as adaptive execution would gather a column of paths in one task
    return manifest.select("path").repartition(max(1, min(READ_TASKS, manifest.count()))).mapInArrow(run, CHUNKS)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def payloads(chunks: DataFrame) -> DataFrame:
    """One row per record from the last chunks; a revisit takes its length and digest from the record it refers to."""
    ends = chunks.filter("last").select("page_id", "record_type", "refers_to", "declared_digest", "declared_length", "n_bytes", "running_sha1")
    full = F.col("record_type") == "response"
    return ends.select(
        "page_id",
        "record_type",
        "refers_to",
        F.when(full, F.col("n_bytes")).otherwise(F.col("declared_length")).alias("payload_bytes"),
        F.when(full, F.col("running_sha1")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        (~full | ((F.col("n_bytes") == F.col("declared_length")) & (F.col("running_sha1") == F.col("declared_digest")))).alias("intact"),
    )


def archive_report(pages: DataFrame) -> DataFrame:
    """The digest of ``op6``: write all pages, read the archives back."""
    folder = scratch_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    manifest = write(decide(pages), folder)
    return payloads(read(manifest, with_data=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
