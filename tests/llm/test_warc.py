import gzip
import hashlib
import io

import pyarrow.fs as fs

from lodestrata.llm import warc as W

BIG = "é" * 200_000
ROWS = [(1, "http://a", "x" * 1000, "e"), (2, "http://b", "x" * 1000, "e"), (3, None, "x" * 999, "e"), (4, "u", "x" * 999, "e"), (5, "u", None, "e"), (6, "u", "", None), (7, "u", BIG, "e"), (8, "u", "a\r\n\r\nWARC/1.0\r\n", "e"), (None, "u", "y" * 2000, "e"), (9, "u\r\nX: y", "y" * 2000, "e"), (9, "u", "y" * 2000, "e")]


def expected():
    out = []
    for p, _, h, _ in ROWS:
        b = (h or "").encode()
        top = max((q for q, _, g, _ in ROWS if g == h and q is not None), default=p)
        revisit = len(b) >= 1000 and p != top
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def frame(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string, digest string")


def test_report(spark):
    assert sorted(map(tuple, W.archive_report(frame(spark)).collect()), key=str) == expected()


def test_round_trip_and_chunks(spark, tmp_path):
    manifest = W.write(W.decide(frame(spark)), f"file://{tmp_path}", chunk_bytes=100, segment_bytes=500)
    assert manifest.count() > 1
    chunks = W.read(manifest, chunk_bytes=64).collect()
    whole = {}
    for r in sorted(chunks, key=lambda r: r.chunk_no):
        if r.record_type == "response" and r.page_id is not None and r.page_id != 9:
            whole[r.page_id] = whole.get(r.page_id, b"") + bytes(r.data)
            assert len(r.data) <= 64
            assert r.running_sha1 == hashlib.sha1(whole[r.page_id]).hexdigest()
    assert whole[7] == BIG.encode() and whole[8] == ROWS[7][2].encode() and whole[5] == b""
    assert W.payloads(W.read(manifest)).filter("not intact").count() == 0
    for r in manifest.collect():
        raw = fs.LocalFileSystem().open_input_stream(r.path.removeprefix("file://"), compression=None).read()
        assert gzip.decompress(raw).count(b"WARC-Record-ID") >= r.n_records


def test_reader_over_small_pieces():
    head = W._header(3, "u", 5, hashlib.sha1(b"hello").hexdigest(), None)
    raw = gzip.compress(head + b"hello" + W.STOP) + gzip.compress(W._header(4, "u", 5, "d", 3) + W.STOP)
    rows = list(W.records(io.BytesIO(raw), 2))
    assert [r[5] for r in rows] == [0, 1, 2, 0] and rows[2][7] == hashlib.sha1(b"hello").hexdigest()


def test_empty(spark):
    assert W.archive_report(frame(spark).limit(0)).count() == 0


def test_archives_are_read_by_a_task_each(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(k, "u", f"{k} " * 600) for k in range(200)], "page_id long, url string, html string").repartition(6)
    manifest = W.write(W.decide(pages), f"file://{tmp_path}")
    assert manifest.count() >= 4
    chunks = W.read(manifest).withColumn("task", F.spark_partition_id())
    assert chunks.select("task").distinct().count() > 1 and chunks.count() == 200


def test_many_repeated_digests_join_by_salts(spark, monkeypatch):
    monkeypatch.setattr(W, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, W.archive_report(frame(spark)).collect()), key=str) == expected()


def test_a_chunk_leaves_before_the_next_is_cut(spark):
    """The plan lays out chunk numbers below the cut, and no array of chunks is made."""
    plan = W.chunked(W.decide(frame(spark)))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate", 1)
    assert "substring" in above and "as binary" not in above and "as binary" in below and "transform" not in plan


def test_cost_is_linear_in_the_payload(spark, tmp_path):
    """Four times the bytes in well under sixteen times the time, which copies of the whole for each chunk take."""
    import time

    from pyspark.sql import functions as F

    def seconds(megabytes: int) -> float:
        path = str(tmp_path / f"{megabytes}-{time.time_ns()}")
        spark.createDataFrame([(1, "u", "0123456789abcdef" * (megabytes << 16), megabytes << 20, "d", None)], "page_id long, url string, html string, n_bytes long, digest string, refers_to long").write.parquet(path)
        chunks = W.chunked(spark.read.parquet(path), chunk_bytes=2048)
        began = time.time()
        assert chunks.agg(F.sum(F.length("data"))).first()[0] == megabytes << 20
        return time.time() - began

    seconds(1)
    few, many = min(seconds(4) for _ in range(2)), min(seconds(16) for _ in range(2))
    assert many < 8 * few + 0.5, (few, many)


def test_the_writer_checks_its_digest(spark, tmp_path):
    from pyspark.sql import functions as F

    wrong = W.decide(frame(spark)).withColumn("digest", F.lit("0" * 40))
    try:
        W.write(wrong, f"file://{tmp_path}")
    except Exception as e:
        assert "not its payload" in str(e)
        return
    raise AssertionError("a wrong digest was written")
