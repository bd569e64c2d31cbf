import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import postings as T
from lodestrata.operators import retrieval as R
from lodestrata.sources.tables import CommitLog, Conflict, KeyedTable, VersionedTable

WORDS = ["alpha", "beta", "gamma", "delta", "alphabet", *(f"w{k}" for k in range(80))]


def texts(seed, ids):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choices(WORDS, [40, 20, 9, 5, 7] + [2] * 80, k=rng.randint(0, 60)))) for k in ids]


def same(spark, index, docs, cases=((["alpha", "gamma"], []), (["gamma"], ["alph"]))):
    """The index against ``bm25`` over the documents that should be in it: all scores, and the best with ties."""
    for terms, prefixes in cases:
        for every in (True, False):
            want = {r.id: round(r.score, 9) for r in R.bm25(docs, "id", "text", terms, prefixes, every).collect()}
            assert {r.id: round(r.score, 9) for r in index.search(terms, prefixes, None, every).collect()} == want
            best = [(r.id, round(r.score, 6)) for r in R.top(R.bm25(docs, "id", "text", terms, prefixes, every).withColumn("score", F.round("score", 9)), 7).collect()]
            found = [(r.id, round(r.score, 6)) for r in index.search(terms, prefixes, 7, every).collect()]
            assert sorted(s for _, s in found) == sorted(s for _, s in best)
            assert all(want[i] == pytest.approx(s, abs=1e-6) for i, s in found)


def test_index_through_changes(spark, tmp_path):
    index = T.TextIndex(spark, str(tmp_path / "i"), cell=16)
    assert index.search(["alpha"]).count() == 0
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    now = dict(texts(1, range(300))) | {300: None, 301: ""}
    index.upsert(frame(list(now.items()) + [(None, "alpha")]), "id", "text", batch=("s", 0))
    same(spark, index, frame(list(now.items())), [(["alpha", "gamma"], []), ([], ["w1", "be"]), ([], ["nothing"])])
    change = dict(texts(2, range(250, 330)))
    for _ in range(2):
        index.upsert(frame(list(change.items())), "id", "text", batch=("s", 1))
    now |= change
    index.delete(frame([(k, "") for k in range(0, 330, 9)]).select("id"))
    now = {k: t for k, t in now.items() if k % 9}
    same(spark, index, frame(list(now.items())))
    state = index.state()
    assert state["docs"] == len(now) and len(state["segments"]) == 2 and len(state["dead"]) == 2
    assert index.merge(most=1) is not None and index.merge(most=1) is None
    assert len(index.state()["segments"]) == 1 and not index.state()["dead"]
    index.vacuum(keep=1)
    same(spark, index, frame(list(now.items())), [(["gamma"], ["alph"])])
    assert len(os.listdir(tmp_path / "i" / "data")) == 1


def test_ids_of_text_order_and_filters(spark, tmp_path):
    index = T.TextIndex(spark, str(tmp_path / "i"))
    rows = [("b", "one two", 1), ("b", "two two", 2), ("a", "two", 1), ("c", "two", 1)]
    index.upsert(spark.createDataFrame(rows, "k string, t string, at int"), "k", "t", order="at")
    assert {r.id for r in index.search(["one"]).collect()} == set()
    assert [r.id for r in index.search(["two"], k=2).collect()] == ["b", "a"]
    keep = spark.createDataFrame([("c",), (None,), ("c",)], "x string")
    assert [r.id for r in index.search(["two"], k=2, keep=keep).collect()] == ["c"]
    assert index.search([], []).count() == 0


def read_bytes(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalInputBytes()


def measured(spark, work):
    time.sleep(0.5)
    before = read_bytes(spark)
    work()
    time.sleep(0.5)  # the listener catches up
    return read_bytes(spark) - before


def test_an_upsert_touches_its_own_segment_and_a_search_reads_little(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, " ".join(f"v{rng.randrange(4000)}" for _ in range(60)) + (" rare" if k % 997 == 0 else "")) for k in range(6000)]
    docs = spark.createDataFrame(rows, "id long, text string")
    index = T.TextIndex(spark, str(tmp_path / "i"), cell=256)
    index.upsert(docs, "id", "text")
    first = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(tmp_path / "i" / "data") for f in fs}
    index.upsert(docs.filter("id < 60").withColumn("text", F.concat("text", F.lit(" rare fresh"))), "id", "text")
    assert all(os.stat(f).st_mtime_ns == t for f, t in first.items())
    index.merge()
    assert [s["docs"] for s in index.state()["segments"]] == [6000, 60]
    new = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "i" / "data") for f in fs if os.path.join(d, f) not in first)
    size = sum(os.path.getsize(f) for f in first)
    assert new < 0.1 * size
    blocks = sum(os.path.getsize(f) for f in first if "/blocks/" in f)
    spent = measured(spark, lambda: index.search(["rare"], k=5).collect())
    assert 0 < spent < 0.5 * blocks, (spent, blocks)
    want = docs.withColumn("text", F.when(F.col("id") < 60, F.concat("text", F.lit(" rare fresh"))).otherwise(F.col("text")))
    same(spark, index, want, [(["rare"], []), (["rare", "fresh"], []), ([], ["rar"])])


def test_top_k_skips_cells(spark, tmp_path, monkeypatch):
    """Long documents cannot beat short ones that hold the term as often; their cells are not read."""
    rows = [(k, "term" + " filler" * (3 if k < 40 else 400)) for k in range(600)]
    index = T.TextIndex(spark, str(tmp_path / "i"), cell=10)
    index.upsert(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    named = []
    cells = T.TextIndex._cells
    monkeypatch.setattr(T.TextIndex, "_cells", staticmethod(lambda blocks, some: named.append(len(some)) or cells(blocks, some)))
    assert [r.id for r in index.search(["term"], k=5).collect()] == [0, 1, 2, 3, 4]
    assert index.state()["segments"][0]["cells"] == 60 and max(named) <= 8
    monkeypatch.setattr(T, "NAMED_CELLS", 1)  # beyond it cells are joined
    monkeypatch.setattr(T, "FIRST_CELLS", 2)
    assert [r.id for r in index.search(["term"], k=5).collect()] == [0, 1, 2, 3, 4]


def test_index_in_a_search(spark):
    from datetime import date

    from lodestrata.plans import search as S
    from tests.test_engine import library

    lib = library(spark)
    o = S.Options(date(2026, 10, 7))
    index = T.TextIndex(spark, os.path.join(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"), f"index{time.time_ns()}"))
    index.upsert(S.contents(lib.files), "file_id", "content")
    with_index = S.Library(lib.files, lib.understanding, lib.text_vectors, lib.image_vectors, lib.people, index)
    for sentence in ("please find my os", "os ext:pdf"):
        a, b = ([(r.file_id, round(r.score, 9), r.explanation) for r in S.search(x, sentence, o).collect()] for x in (lib, with_index))
        assert a == b
    # limits come after the filters
    narrow = S.Options(date(2026, 10, 7), limits=S.Limits(text=1))
    assert [r.file_id for r in S.search(lib, "os ext:pdf", narrow).collect()] == [2]
    assert [r.file_id for r in S.search(with_index, "os ext:pdf", narrow).collect()] == [2]
    gone = S.Library(lib.files, existing=lib.files.filter("file_id <> 1").select("file_id"))
    assert {r.file_id for r in S.search(gone, "os", o).collect()} == {2}


# ---------------------------------------------------------------- commits


def test_a_dead_writer_blocks_nobody(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), lease=3600)
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    t.write(rows(1))
    # a writer that died between creating its commit and writing it
    (tmp_path / "t" / "versions" / "000000000001.json").touch()
    assert t.current() == 0 and t.read().count() == 1
    with pytest.raises(Conflict):  # it may still be at work
        t.write(rows(2))
    t.log.lease = 0
    assert t.update(lambda r: r.union(rows(2))) == 1
    assert {r.id for r in t.read().collect()} == {1, 2} and list(t.versions()) == [0, 1]


def test_a_slow_writer_learns_that_it_lost(spark, tmp_path, monkeypatch):
    log = CommitLog(spark, str(tmp_path / "t"), lease=0.0)
    log.commit(0, {"data": "a", "batches": {}})
    path = tmp_path / "t" / "versions" / "000000000001.json"
    path.write_text('{"da')
    time.sleep(0.01)
    log.commit(1, {"data": "b", "batches": {}})
    assert log.get(1)["data"] == "b" and log.latest()[0] == 1
    # one that finished just as it was taken out of the way stands
    whole = path.read_text()
    real, calls = log._read, []
    monkeypatch.setattr(log, "_read", lambda p: None if not calls.append(p) and len(calls) == 1 else real(p))
    with pytest.raises(Conflict):
        log._clear(log._at(1), 1)
    assert path.read_text() == whole
    with pytest.raises(Conflict):
        log.commit(1, {"data": "c", "batches": {}})


def test_batches_count_once(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    t.write(rows(1), batch=("s", 0))
    for number in (1, 1, 0):
        t.update(lambda r: r.union(rows(2)), batch=("s", number))
    t.update(lambda r: r.union(rows(3)), batch=("other", 0))
    assert sorted(r.id for r in t.read().collect()) == [1, 2, 3] and t.current() == 2


@pytest.mark.parametrize("kind", ["long", "string"])
def test_keyed_upserts_leave_other_ranges(spark, tmp_path, kind):
    key = (lambda k: f"k{k:05d}") if kind == "string" else (lambda k: k)
    frame = lambda rows: spark.createDataFrame([(key(k), v, g, o) for k, v, g, o in rows], f"k {kind}, v string, gone boolean, at int")
    t = KeyedTable(spark, str(tmp_path / "t"), "k", rows_per_file=100)
    now = {k: "old" for k in range(0, 2000, 2)}
    t.upsert(frame([(k, v, False, 0) for k, v in now.items()]).select("k", "v"), batch=("s", 0))
    files = t.files()
    assert len(files) >= 8 and all(a["high"] < b["low"] for a, b in zip(files, files[1:], strict=False))
    change = [(k, "new", k % 3 == 0, 1) for k in range(300, 340)] + [(301, "older", False, 0), (-5, "first", False, 1), (9000, "last", False, 1)]
    for _ in range(2):
        t.upsert(frame(change), order=["at"], deleted=F.col("gone"), batch=("s", 1))
    for k, v, gone, at in sorted(change, key=lambda r: r[3]):
        now.pop(k, None) if gone else now.__setitem__(k, v)
    assert {r.k: r.v for r in t.read().collect()} == {key(k): v for k, v in now.items()}
    after = t.files()
    kept = [f for f in files if f in after]
    assert len(kept) >= len(files) - 4 and all(a["high"] < b["low"] for a, b in zip(after, after[1:], strict=False))
    assert t.read(0).count() == 1000  # readers of the old version go on
    t.vacuum(keep=1)
    assert t.read().count() == len(now) and all((tmp_path / "t" / f["path"]).exists() for f in t.files())
    with pytest.raises(ValueError):
        t.upsert(spark.createDataFrame([(None, "x")], f"k {kind}, v string"))
    t.upsert(frame([(k, "", True, 0) for k in now]), deleted=F.col("gone"))
    assert t.read().count() == 0


def test_scores_that_show_alike_go_by_path(spark):
    """The order is that of the scores shown: beyond five digits the path decides."""
    from lodestrata.plans import search as S

    rows = spark.createDataFrame([(1, 0.0765947, "/b"), (2, 0.0765917, "/a"), (3, 0.07661, "/c")], "file_id long, score double, _order_path string")
    assert [r.file_id for r in rows.orderBy(*S.sorted_by(rows, "relevance")).collect()] == [3, 2, 1]


def shuffled_bytes(spark):
    """Bytes that the stages so far have written for shuffles."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_changes_shuffle_documents_once_and_no_postings(spark, tmp_path):
    """Texts, single postings and blocks went through shuffles before, and a deletion shuffled all old documents."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(k, " ".join(f"word{rng.randrange(4000)}" for _ in range(150))) for k in range(2000)], "id long, text string")
    index = T.TextIndex(spark, str(tmp_path / "i"), cell=256)
    time.sleep(0.5)
    start = shuffled_bytes(spark)
    index.upsert(docs, "id", "text")
    time.sleep(0.5)
    made = shuffled_bytes(spark)
    index.delete(docs.filter("id % 5 = 0").select("id"))
    time.sleep(0.5)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert made - start < 1.2 * size, (made - start, size)
    assert shuffled_bytes(spark) - made < 0.1 * size
    same(spark, index, docs.filter("id % 5 <> 0"), [(["word7"], []), ([], ["word39"])])


def test_repeated_ids_and_long_documents_of_a_batch(spark, tmp_path, monkeypatch):
    """Only rows of repeated ids meet (or all, if these are many), and cells are cut by words, too."""
    rows = [(k, f"alpha beta{k % 3} " * 5) for k in range(40)] + [(k, f"zeta beta{k % 2}") for k in range(0, 40, 4)] + [(41, None), (42, "")]
    docs = spark.createDataFrame(rows, "id long, text string")
    want = docs.groupBy("id").agg(F.max("text").alias("text"))
    for few, words in ((500_000, 1 << 20), (2, 16)):
        monkeypatch.setattr(T, "FEW_IDS", few)
        monkeypatch.setattr(T, "CELL_WORDS", words)
        index = T.TextIndex(spark, str(tmp_path / f"i{few}"))
        index.upsert(docs, "id", "text")
        same(spark, index, want, [(["alpha"], []), (["zeta"], ["beta"]), ([], ["b"])])
