import io
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import catalogue as C
from lodestrata.operators import duplicates as D
from lodestrata.operators import entities as E
from lodestrata.operators import governance as G
from lodestrata.operators import metrics as M
from lodestrata.operators import retrieval as R
from lodestrata.plans.planner import DateRange, decompose_roles, parse, strip_fillers
from lodestrata.sources import views
from lodestrata.sources.tables import KeyedTable
from lodestrata.streaming import events as S

NOW = date(2026, 10, 7)


@pytest.mark.parametrize(
    ("text", "when"),
    [
        ("photos between 5 and 10 Dec 2024", DateRange(date(2024, 12, 5), date(2024, 12, 10))),
        ("bills from 9 December", DateRange(day=9, month=12)),
        ("Dec 9 2023 notes", DateRange(date(2023, 12, 9), date(2023, 12, 9))),
        ("statements March 2024", DateRange(date(2024, 3, 1), date(2024, 3, 31))),
        ("in may", None),
        ("files last week", DateRange(date(2026, 9, 30), NOW)),
        ("last month", DateRange(date(2026, 9, 7), NOW)),
        ("last year", DateRange(date(2025, 10, 7), NOW)),
        ("photos from today", DateRange(NOW, NOW)),
        ("yesterday", DateRange(date(2026, 10, 6), date(2026, 10, 6))),
        ("last monday", DateRange(date(2026, 10, 5), date(2026, 10, 5))),
        ("last wednesday", DateRange(date(2026, 9, 30), date(2026, 9, 30))),
        ("notes of 31 Feb 2024", DateRange(date(2024, 2, 1), date(2024, 2, 29))),
        ("between 30 and 31 February 2024", DateRange(date(2024, 2, 1), date(2024, 2, 29))),
        ("from 10th to 5th Dec 2024", DateRange(date(2024, 12, 5), date(2024, 12, 10))),
        ("past 10 days", DateRange(date(2026, 9, 27), NOW)),
        ("no date", None),
    ],
)
def test_dates(text, when):
    assert parse(text, NOW).when == when


def test_plan():
    p = parse("please find my bank statements and salary slips ext:pdf size:>10MB", NOW)
    assert p.extension == "pdf" and p.size == ("gt", 10 << 20)
    assert set(p.document_types) >= {"Bank Statement", "Salary Slip"} and "Banking & Finance" in p.categories
    assert parse("photos of Priya", NOW, {"priya": "Priya"}).persons == ("Priya",)
    assert "image" in parse("selfie at the beach", NOW).file_types and parse("selfie at the beach", NOW).intent == "visual"
    assert parse("i need my DBMS DA 3", NOW).intent == "academic" and "database management system" in parse("dbms notes", NOW).expansions
    assert strip_fillers("can you please show me the report please") == "report"


def test_roles():
    r = decompose_roles("a man wearing red shirt holding umbrella in the park")
    assert r.subjects == ("man", "guy", "person") and r.clothing == ("shirt",) and r.scene == ("park",) and r.objects == ("umbrella",) and ("red", "shirt") in r.bound
    assert r.relationships == ("wearing red shirt", "holding umbrella", "in park") and r.actions == ("wearing", "holding") and r.composed and r.visual
    assert decompose_roles("guy in blue shirt").bound == (("blue", "shirt"),) and decompose_roles("woman in red").clothing == ("red",)
    assert decompose_roles("dog").visual and not decompose_roles("notes").visual and decompose_roles("") == decompose_roles("the")


def test_date_predicate_without_year(spark):
    days = spark.createDataFrame([(date(2020, 12, 9),), (date(2021, 12, 10),), (None,)], "d date")
    assert days.filter(DateRange(day=9, month=12).predicate(F.col("d"))).count() == 1


@pytest.mark.parametrize(
    ("text", "name", "kind"),
    [
        ("number 2345 6789 0123", "a", "ID_DOCUMENT"),
        ("ABCDE1234F", "a", "ID_DOCUMENT"),
        ("A1234567", "my passport", "ID_DOCUMENT"),
        ("A1234567", "a", "NONE"),
        ("SBIN0001234", "a", "BANKING_FINANCE"),
        ("account no: 123456789", "bank.txt", "BANKING_FINANCE"),
        ("cheque deposit balance", "a", "BANKING_FINANCE"),
        ("internal use only", "a", "CONFIDENTIAL"),
        (None, None, "NONE"),
    ],
)
def test_sensitivity(spark, text, name, kind):
    row = spark.createDataFrame([(text, name)], "t string, n string").select(G.sensitivity(F.col("t"), F.col("n")).alias("k")).first()
    assert row.k == kind


def test_masking_leaks_nothing(spark):
    rows = spark.createDataFrame([(1, "secret.pdf", "/x/secret.pdf", ".pdf", "the secret", "PROTECTED"), (2, "open.txt", "/x/open.txt", ".txt", "open", "NORMAL"), (3, "h", "h", ".x", "h", "HIDDEN")], "file_id long, filename string, path string, extension string, extracted_text string, privacy_state string")
    seen = G.masked(G.visible(rows, False), False).collect()
    assert len(seen) == 2 and "secret" not in str(seen) and "open.txt" in str(seen)
    assert "secret" in str(G.masked(G.visible(rows, True), True).collect())


def test_hamming_equals_brute_force(spark):
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(10)]
    hashes = [(k, (b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(9)))) & (2**64 - 1)) for k, b in enumerate(base * 6)]
    rows = spark.createDataFrame([(k, h - 2**64 if h >> 63 else h) for k, h in hashes], "id long, hash long")
    want = {(a, b, (x ^ y).bit_count()) for a, x in hashes for b, y in hashes if a < b and (x ^ y).bit_count() <= 8}
    assert {tuple(r) for r in D.hamming_pairs(rows, 8).collect()} == want


def test_vectors(spark):
    v = spark.createDataFrame([(101, [1.0, 0.0, 0.0, 0.0]), (102, [0.9, 0.1, 0.0, 0.0]), (103, [0.0, 1.0, 0.0, 0.0]), (104, [0.0] * 4)], "id long, v array<float>")
    assert [r.id for r in R.knn(v, [1, 0, 0, 0], 2, "id", "v").collect()] == [101, 102]
    assert R.knn(v.filter("id <> 101"), [1, 0, 0, 0], 1, "id", "v").first().id == 102


def test_suppression_and_components(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 1.0, 1.0, 10.0, 10.0, 0.8), (1, 3, 50.0, 50.0, 10.0, 10.0, 0.7), (2, 4, 0.0, 0.0, 5.0, 5.0, 0.1)], "image_id long, det_id long, x double, y double, w double, h double, confidence double")
    assert {r.det_id for r in E.suppress_overlaps(boxes).collect()} == {1, 3, 4}


def _checkpoints(spark, folder):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(folder))


def test_components_of_a_long_chain(spark, tmp_path):
    _checkpoints(spark, tmp_path)
    edges = spark.createDataFrame([(k, k + 1) for k in range(39)] + [(100, 101), (200, 200)], "a long, b long")
    assert {r.node: r.component for r in E.components(edges).collect()} == {k: 0 for k in range(40)} | {100: 100, 101: 100, 200: 200}
    with pytest.raises(RuntimeError):
        E.components(edges, rounds=1)


def test_propagation_over_a_long_chain(spark, tmp_path):
    import math

    _checkpoints(spark, tmp_path)
    at = lambda k: [math.cos(k * 0.3), math.sin(k * 0.3)]
    detections = spark.createDataFrame([(k, at(k)) for k in range(1, 13)], "det_id long, det_vector array<double>")
    references = spark.createDataFrame([(7, at(0))], "person_id long, ref_vector array<double>")
    assert {tuple(r) for r in E.propagate(detections, references, 0.95, 0.03).collect()} == {(k, 7) for k in range(1, 13)}
    with pytest.raises(RuntimeError):
        E.propagate(detections, references, 0.95, 0.03, rounds=3)


def test_mentions_of_whole_names_and_aliases(spark):
    persons = spark.createDataFrame([(1, "Mary Ann Lee", ["Annie"]), (2, "Arun", None), (3, "Li", ["Xu"]), (4, "Ann Mary", ["J. Smith"])], "person_id long, name string, aliases array<string>")
    files = spark.createDataFrame([(1, "a.txt", "with mary ann lee."), (2, "mary ann lee.pdf", None), (3, "b.txt", "Mary Lee and Ann, Dharun, li xu"), (4, "c.txt", "annie met ARUN"), (5, "d.txt", "j smith; mary annlee")], "file_id long, filename string, extracted_text string")
    assert {tuple(r) for r in E.text_mentions(persons, files).collect()} == {(1, 1), (1, 2), (1, 4), (2, 4), (4, 5)}
    assert {tuple(r) for r in E.text_mentions(persons.drop("aliases"), files).collect()} == {(1, 1), (1, 2), (2, 4)}


def test_json_recovery_and_html(spark):
    ticks = "`" * 3
    rows = spark.createDataFrame([('{"k": 1}',), (f'so {ticks}json\n{{"k": 2}}\n{ticks}',), ('x {"k": 3} y',), ("none",)], "t string")
    assert [r.k for r in rows.select(T.recovered_json(F.col("t"), "k long")["k"].alias("k")).collect()] == [1, 2, 3, None]
    page = spark.createDataFrame([("<p>a &amp; b</p><script>x<y</script><!-- no --><b>c</b>",)], "h string")
    assert page.select(T.html_text(F.col("h")).alias("x")).first().x == "a & b c"


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.txt").write_bytes("é".encode())
    (tmp_path / "b.txt").write_bytes(b"\xe9")
    (tmp_path / "c.db").write_bytes(b"x")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="u"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "d.docx").write_bytes(data.getvalue())
    (tmp_path / "e.docx").write_bytes(b"broken")
    found = views.read_files(spark, str(tmp_path))
    assert found.count() == 4
    assert {r.t for r in found.filter("path like '%.txt'").select(views.decoded(F.col("content")).alias("t")).collect()} == {"é"}
    assert {r.text for r in views.docx_text(found.filter("path like '%.docx'")).collect()} == {"one\ntwo", None}


def test_upsert_helpers(spark):
    old = spark.createDataFrame([(1, "a", None)], "id int, x string, y string")
    new = spark.createDataFrame([(1, "b", "c"), (2, "d", None), (2, "d", None)], "id int, x string, y string")
    assert {r.x for r in C.insert_ignore(old, new, ["id"]).collect()} == {"a", "d"}
    assert C.partial_update(old, spark.createDataFrame([(1, None, "z")], "id int, x string, y string"), "id").first() == (1, "a", "z")


def test_streams_equal_batches(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, 0, s), s % 2, k) for s, k in ((0, "created"), (1, "modified"), (2, "modified"), (40, "deleted"), (41, "created"))]
    events = spark.createDataFrame(rows, "ts timestamp, path long, event_type string")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = S.tumbling(stream, "10 seconds", ["path"]).writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, S.tumbling(events, "10 seconds", ["path"]).collect()))
    assert sorted((r.path, r.event_type, r.n_events) for r in S.debounce(events, ["path"], "5 seconds").collect()) == [(0, "deleted", 1), (0, "modified", 2), (1, "created", 1), (1, "modified", 1)]
    kept = KeyedTable(spark, str(tmp_path / "out"), "path")
    for _ in range(2):  # the second run finds nothing new
        S.ingest(stream, str(tmp_path / "check"), S.merge_into(kept, "events", ["ts"]))
    assert {(r.path, r.event_type) for r in kept.read().collect()} == {(0, "deleted"), (1, "created")}
    # a batch that comes again, with other rows even, is known
    S.merge_into(kept, "events", ["ts"])(events.withColumn("event_type", F.lit("again")), 0)
    assert {(r.path, r.event_type) for r in kept.read().collect()} == {(0, "deleted"), (1, "created")}


def test_components_of_a_chain_of_200(spark, tmp_path):
    _checkpoints(spark, tmp_path)
    edges = spark.createDataFrame([(k, k + 1) for k in range(199)], "a long, b long")
    assert {r.component for r in E.components(edges).collect()} == {0}


def test_rerank_keeps_queries_apart(spark):
    rows = [(q, q * 100 + k, k, 1.0 - k / 10, 0.0 if k == 1 else 1.0) for q in (1, 2) for k in range(1, 7)]
    ranked = spark.createDataFrame(rows, "q long, id long, rank int, score double, second double")
    got = {(r.q, r.rank): r.id for r in R.rerank(ranked, F.col("second"), query="q").collect()}
    for q in (1, 2):
        assert [got[q, k] for k in range(1, 7)] == [q * 100 + k for k in (2, 3, 4, 5, 1, 6)]
    one = R.rerank(ranked.filter("q = 1"), F.col("second"))
    assert [r.id for r in one.orderBy("rank").collect()] == [102, 103, 104, 105, 101, 106]


def test_metrics_count_an_item_once(spark):
    runs = spark.createDataFrame([(1, "/a/X.pdf", 1), (1, "/b/x.PDF", 2), (1, "/a/y.pdf", 3), (2, "z", 1)], "query_id long, item string, rank int")
    qrels = spark.createDataFrame([(1, "x.pdf", 1), (2, "q", 1)], "query_id long, item string, gain int")
    got = {r.query_id: r for r in M.per_query(runs, qrels, 5).collect()}
    assert tuple(got[1])[1:] == (1, 0.2, 1.0, 1.0, 1.0) and tuple(got[2])[1:] == (0, 0.0, 0.0, 0.0, 0.0)


def test_percentiles(spark):
    values = [float(x) for x in (5, 1, 1, 9, 3, 3, 3, 20, 7)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
    import numpy as np

    assert np.allclose(M.latency(rows, "v").first(), np.percentile(values, [50, 95, 99]))
    ordered = sorted(values)
    assert tuple(M.index_percentiles(rows, "v").first()) == tuple(ordered[int(len(ordered) * p)] for p in (0.5, 0.95, 0.99))
    assert M.latency(rows.limit(0), "v").first().p50 is None


def test_boxes_without_area_stay(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 500.0, 500.0, 0.0, 0.0, 0.8), (1, 3, 1.0, 1.0, 0.0, 5.0, 0.7)], "image_id long, det_id long, x double, y double, w double, h double, confidence double")
    assert {r.det_id for r in E.suppress_overlaps(boxes).collect()} == {1, 2, 3}


def test_matches_are_cosines(spark):
    found = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "det_id long, det_vector array<double>")
    known = spark.createDataFrame([(7, [3.0, 0.0]), (8, [0.0, 5.0]), (9, [1e-9, 0.0])], "person_id long, ref_vector array<double>")
    assert [tuple(r) for r in E.best_matches(found, known).collect()] == [(1, 7, 1.0, 1.0)]


def test_code_mixed_scripts(spark):
    rows = spark.createDataFrame([("\u0d05\u0d06",), ("\u0d85\u0d86",), ("photo kaatu",), ("plain",)], "t string")
    assert [r.k for r in rows.select(T.code_mixed(F.col("t")).alias("k")).collect()] == [True, False, True, False]


def test_watcher_suffixes(spark):
    rows = spark.createDataFrame([("/a/x.txt~",), ("/a/x.TMP",), ("/a/.log",), ("/a/log",), ("/venv/a",), ("/a/~$b.docx",), ("C:\\\\AppData\\\\b.txt",)], "p string")
    assert [r.k for r in rows.select(C.ignored(F.col("p")).alias("k")).collect()] == [False, True, True, False, True, True, True]


def test_attempts_lock_and_recover(spark):
    rows = [("a", float(t), False) for t in (0, 10, 20, 30, 40)] + [("a", 50.0, True), ("a", 99.9, False), ("a", 101.0, False), ("a", 102.0, True), ("a", 103.0, False)]
    rows += [("b", float(t), False) for t in (0, 100, 200, 250, 301)] + [("c", 1.0, True), (None, 1.0, True)]
    attempts = spark.createDataFrame(rows, "who string, ts double, ok boolean").repartition(3)
    got = {(r.who, r.ts): (r.outcome, r.locked_until) for r in S.attempt_outcomes(attempts, "who", "ts", "ok").collect()}
    assert got["a", 40.0] == ("failed", 100.0) and got["a", 50.0] == ("locked", 100.0) and got["a", 99.9][0] == "locked"
    # what was refused counts for nothing, the failures before the lockout still do
    assert got["a", 101.0] == ("failed", 161.0) and got["a", 102.0][0] == "locked"
    assert got["b", 301.0] == ("failed", None) and got["c", 1.0] == ("ok", None) and (None, 1.0) not in got


def test_sessions(spark):
    grants = spark.createDataFrame([("t", 0.0, False), ("t", 500.0, True), ("t", 600.0, False), ("u", 10.0, False)], "token string, ts double, revoked boolean")
    checks = spark.createDataFrame([("t", 0.0, 1), ("t", 499.0, 2), ("t", 550.0, 3), ("t", 2400.0, 4), ("t", 2400.1, 5), ("u", 5.0, 6), ("x", 1.0, 7)], "token string, ts double, check_id long")
    assert {r.check_id for r in S.session_checks(grants, checks).filter("valid").collect()} == {1, 2, 4}


def test_debounce_ties(spark):
    rows = [(datetime(2024, 1, 1), 1, "created", 2), (datetime(2024, 1, 1), 1, "deleted", 1)]
    events = spark.createDataFrame(rows, "ts timestamp, path long, event_type string, event_id long")
    assert S.debounce(events, ["path"], "5 seconds", tie="event_id").first().event_type == "created"


def test_suppression_of_many_boxes_takes_a_step_for_each_that_stays(spark):
    """5,000 boxes of one image that all stay are 12 million pairs one by one."""
    import time

    at = spark.range(5_000).select(F.lit(1).cast("long").alias("image_id"), F.col("id").alias("det_id"), (F.col("id") * 3.0).alias("x"), F.lit(0.0).alias("y"), F.lit(2.0).alias("w"), F.lit(2.0).alias("h"), F.lit(0.5).alias("confidence"))
    extra = spark.createDataFrame([(1, -1, 0.0, 0.0, 2.0, 2.0, 0.4), (1, -2, 0.0, 0.0, 0.0, 2.0, 0.4), (1, -3, None, 0.0, 2.0, 2.0, 0.4)], "image_id long, det_id long, x double, y double, w double, h double, confidence double")
    E.suppress_overlaps(extra).count()  # workers are up
    began = time.time()
    kept = {r.det_id for r in E.suppress_overlaps(at.union(extra)).collect()}
    assert time.time() - began < 5
    assert kept == {*range(5_000), -2, -3}


def test_embedders_get_slices_of_a_batch(spark):
    import numpy as np

    from lodestrata.operators import extensions as X

    class Counts(X.TextEmbedder):
        name, dimension = "counts", 2

        def embed(self, texts):
            return np.array([[len(t), len(texts)] for t in texts], np.float32)

    rows = spark.range(3_000, numPartitions=1).selectExpr("id", "case when id % 7 <> 0 then repeat('a', int(id % 50)) end as text")
    got = {r.id: list(r.v) for r in rows.select("id", Counts().column(F.col("text")).alias("v")).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: float(k % 50 if k % 7 else 0) for k in range(3_000)}
    assert max(v[1] for v in got.values()) <= 256
    assert rows.limit(0).select(Counts().column(F.col("text")).alias("v")).count() == 0


def test_a_large_bucket_of_terms_is_dealt_over_tasks(spark, tmp_path):
    docs = spark.range(4_000, numPartitions=8).selectExpr("id", "concat_ws(' ', transform(sequence(0, 30), k -> concat('aa', hash(id, k) & 1048575)), if(id % 3 = 0, 'aab', 'aac')) as text")
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "200k")
    try:
        R.write_index(docs, "id", "text", str(tmp_path))
    finally:
        spark.conf.set(name, before)
    assert [len(list(d.glob("*.parquet"))) > 3 for d in (tmp_path / "postings").glob("bucket=*")] == [True]
    score = lambda found: {r.id: round(r.score, 9) for r in found.collect()}
    assert score(R.bm25_indexed(spark, str(tmp_path), ["aab"], ["aa1"], False)) == score(R.bm25(docs, "id", "text", ["aab"], ["aa1"], False))
