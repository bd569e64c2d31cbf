import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import changes as N
from lodestrata.streaming import events as S


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, S.ROCKS)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def streamed(spark, folder, frames, work, name):
    """``work`` over a stream that gets ``frames`` one after the other, a batch each."""
    source = str(folder / f"{name}-in")
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = work(stream).writeStream.format("parquet").option("path", str(folder / f"{name}-out")).option("checkpointLocation", str(folder / f"{name}-check")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(str(folder / f"{name}-out"))


def test_lockouts_on_a_stream_are_those_of_a_batch(spark, tmp_path, rocks):
    rng = random.Random(3)
    rows = [(f"u{k % 3}", 1000.0 + 10 * k + rng.choice([0, 0, 0.5]), rng.random() < 0.15, k) for k in range(150)]
    schema = "who string, ts double, ok boolean, n long"
    parts = [rows[k : k + 50] for k in (0, 50, 100)]
    for part in parts:
        rng.shuffle(part)  # out of order within a batch
    parts[0][7], parts[1][3] = parts[1][3], parts[0][7]  # and over batches, within the delay
    end = [("end", 10_000.0, True, 999)]
    work = lambda df: S.attempt_outcomes(df, "who", "ts", "ok", 3, 60.0, 45.0, late="20 minutes")
    found = streamed(spark, tmp_path, [spark.createDataFrame(p, schema) for p in [*parts, end]], work, "lock")
    pick = lambda df: sorted((r.n, r.outcome, r.locked_until) for r in df.filter("who <> 'end'").collect())
    want = pick(work(spark.createDataFrame(rows, schema)))
    assert {o for _, o, _ in want} == {"ok", "failed", "locked"}
    assert pick(found) == want


def test_sessions_on_a_stream_and_late_rows(spark, tmp_path, rocks):
    kind = "side int, token string, ts double, revoked boolean, check_id long"
    first = [(0, "a", 0.0, False, None), (1, "a", 10.0, None, 1), (1, "a", 100.0, None, 2), (1, "a", 101.0, None, 3), (0, "b", 5.0, True, None), (0, "b", 5.0, False, None), (1, "b", 5.0, None, 4), (1, "c", 7.0, None, 5), (1, "a", 0.0, None, 6)]
    second = [(0, "a", 5000.0, False, None), (1, "a", 5001.0, None, 7)]
    late = [(1, "a", 20.0, None, 8)]  # behind the watermark: dropped
    end = [(0, "z", 90_000.0, False, None)]

    def work(df):
        return S.session_checks(df.filter("side = 0"), df.filter("side = 1"), 100.0, late="10 seconds")

    on = lambda rows: [(side, token, ts + 1000, *rest) for side, token, ts, *rest in rows]  # noqa: E731  a watermark begins at 0
    first, second, late, end = map(on, (first, second, late, end))
    found = streamed(spark, tmp_path, [spark.createDataFrame(p, kind) for p in (first, second, end, late)], work, "session")
    want = {1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 7: True}
    assert {r.check_id: r.valid for r in found.collect()} == want
    assert {r.check_id: r.valid for r in work(spark.createDataFrame(first + second, kind)).collect()} == want


def test_folders_come_and_go(spark, tmp_path):
    spark.dataSource.register(N.FolderChanges)
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir(), two.mkdir()
    (one / "a.txt").write_text("alpha")
    (one / "deep").mkdir()
    (one / "deep" / "b.txt").write_text("beta")
    (one / "x.db").write_text("left out")
    (one / ".hidden").write_text("left out")
    (two / "c.txt").write_text("gamma")
    subscribed = tmp_path / "folders.txt"
    subscribed.write_text(f"{one}\n")
    known: dict = {}
    stream = spark.readStream.format("folder_changes").options(subscriptions=str(subscribed), journal=str(tmp_path / "journal")).load()

    def run():
        """What there is, from a stream that is started anew and goes on from its checkpoint."""
        got = []
        S.ingest(stream, str(tmp_path / "check"), lambda batch, _: got.extend(tuple(r) for r in batch.select("event_type", "path", "size_bytes", "content_hash").collect()))
        for kind, path, _, digest in got:
            known.pop(path, None) if kind == "deleted" else known.__setitem__(path, digest)
        return sorted((kind, os.path.relpath(path, tmp_path)) for kind, path, _, _ in got)

    assert run() == [("created", "one/a.txt"), ("created", "one/deep/b.txt")]
    assert run() == []
    (one / "a.txt").write_text("alpha, longer")
    (one / "deep" / "b.txt").rename(one / "moved.txt")
    subscribed.write_text(f"{one}\n{two}\n")
    before = dict(known)
    assert run() == [("created", "one/moved.txt"), ("created", "two/c.txt"), ("deleted", "one/deep/b.txt"), ("modified", "one/a.txt")]
    assert known[str(one / "moved.txt")] == before[str(one / "deep" / "b.txt")] == N.content_hash(str(one / "moved.txt"))
    subscribed.write_text(f"{two}\n")
    assert run() == [("deleted", "one/a.txt"), ("deleted", "one/moved.txt")]
    assert set(known) == {str(two / "c.txt")}


def test_a_restart_reads_the_same_changes_and_snapshots_are_taken(tmp_path, monkeypatch):
    monkeypatch.setattr(N, "SNAPSHOT", 2)
    (tmp_path / "f").mkdir()
    (tmp_path / "subscriptions").write_text(str(tmp_path / "f"))
    make = lambda: N.FolderReader(str(tmp_path / "subscriptions"), str(tmp_path / "journal"))
    reader = make()
    for k in range(5):
        (tmp_path / "f" / f"{k}.txt").write_text(str(k))
        assert reader.latestOffset() == {"number": k + 1} == reader.latestOffset()
    again = make()
    assert again.latestOffset() == {"number": 5} and again.known == reader.known and len(again.known) == 5
    read = lambda r, a, b: [row[1:] for p in r.partitions({"number": a}, {"number": b}) for row in r.read(p)]
    assert read(again, 1, 4) == read(reader, 1, 4) and [os.path.basename(r[1]) for r in read(again, 1, 4)] == ["1.txt", "2.txt", "3.txt"]
    (tmp_path / "f" / "0.txt").unlink()
    assert read(again, 0, 1)[0][3] is None  # gone meanwhile: no hash
    assert json.loads((tmp_path / "journal" / "000000000004-listing.json").read_text()).keys() == {str(tmp_path / "f" / f"{k}.txt") for k in range(4)}


def test_moves_pair_by_content(spark):
    rows = [("deleted", "/a", None), ("deleted", "/b", None), ("deleted", "/c", None), ("created", "/x", "h1"), ("created", "/y", "h1"), ("created", "/z", "h2"), ("created", "/n", None), ("modified", "/m", "h3")]
    events = spark.createDataFrame([(k, p, h) for k, p, h in rows], "event_type string, path string, content_hash string").select(F.current_timestamp().alias("ts"), "event_type", "path", F.lit(1).cast("long").alias("size_bytes"), "content_hash")
    known = spark.createDataFrame([("/a", "h1"), ("/b", "h9"), ("/d", "h2"), ("/c", None)], "path string, content_hash string")
    found = {(r.event_type, r.path, r.dest) for r in N.moves(events, known).collect()}
    assert found == {("moved", "/a", "/x"), ("deleted", "/b", None), ("deleted", "/c", None), ("created", "/y", None), ("created", "/z", None), ("created", "/n", None), ("modified", "/m", None)}
