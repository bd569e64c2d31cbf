from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import extensions as X
from lodestrata.operators import people as P
from lodestrata.operators import retrieval as R
from lodestrata.operators import sinks as K
from lodestrata.operators import understanding as U
from lodestrata.plans import search as S
from lodestrata.plans.planner import decompose_roles
from lodestrata.sources.tables import Conflict, VersionedTable

NOW = date(2026, 10, 7)
DU = "file_id long, document_type string, title string, event_name string, description string, people array<string>, entities array<string>, objects array<string>, colors array<string>, activities array<string>, visual_concepts array<string>, semantic_tags array<string>, locations array<string>, relationships array<string>, important_text array<string>"


def du(spark, *rows):
    base = {"document_type": "photo", "title": "", "event_name": None, "description": ""}
    names = [x.split()[0] for x in DU.split(", ")]
    return spark.createDataFrame([tuple((base | r).get(n, [] if n not in base else base[n]) if n != "file_id" else k for n in names) for k, r in enumerate(rows)], DU)


def scores(spark, sentence, *rows):
    found = U.evaluated(U.evidence(du(spark, *rows)), decompose_roles(sentence)).orderBy("file_id").collect()
    return [(r.subject_match, r.clothing_match, r.attribute_match, r.contradiction, r.role_score) for r in found]


def test_roles_bind_attributes_to_nouns(spark):
    blue = {"people": ["man"], "objects": ["blue shirt"], "colors": ["blue"], "description": "A man in a blue shirt"}
    tones = {"people": ["man"], "objects": ["brown t-shirt"], "colors": ["brown", "blue"], "description": "A man with blue tones"}
    food = {"objects": ["rice"], "colors": ["green"], "description": "A bowl"}
    got = scores(spark, "guy in blue shirt", blue, tones, food)
    assert got[0] == (1.0, 1.0, 1.0, 0.0, 1.0)
    assert got[1][2:4] == (0.2, 0.65) and got[1][4] < 0.2
    assert got[2] == (0.0, 0.0, 0.0, 0.7, 0.0)
    hero = {"people": ["spider-man character"], "objects": ["superhero suit"], "description": ""}
    assert scores(spark, "man in dress", hero)[0][3] == 0.6 and scores(spark, "man in dress", hero)[0][0] == 1.0
    assert scores(spark, "guy", {"people": ["superhero"]})[0][0] == 0.4
    files = spark.createDataFrame([(0,), (9,)], "file_id long")
    unknown = U.evaluated(files.join(U.evidence(du(spark, blue)), "file_id", "left"), decompose_roles("guy")).filter("file_id = 9").first()
    assert (unknown.subject_match, unknown.contradiction, unknown.role_score) == (0.0, 0.0, 0.0)


def test_lists_from_text(spark):
    rows = spark.createDataFrame([('["a", " b "]',), ("x, y,,",), (None,), ("",)], "t string")
    assert [r.x for r in rows.select(U.lists(F.col("t")).alias("x")).collect()] == [["a", "b"], ["x", "y"], [], []]


def library(spark):
    rows = [
        (1, "/a/os_notes.txt", "os_notes.txt", ".txt", 10, 1.7e9, "operating system notes", "NORMAL"),
        (2, "/a/secret.pdf", "secret.pdf", ".pdf", 20, 1.7e9, "the secret os", "PROTECTED"),
        (3, "/a/hidden.pdf", "hidden.pdf", ".pdf", 30, 1.7e9, "hidden os", "HIDDEN"),
        (4, "/a/beach.jpg", "beach.jpg", ".jpg", 40, 1.7e9, None, "NORMAL"),
    ]
    files = spark.createDataFrame(rows, "file_id long, path string, filename string, extension string, size_bytes long, modified_at double, extracted_text string, privacy_state string")
    vectors = spark.createDataFrame([(k, [1.0, 0.1 * k]) for k in range(1, 5)], "file_id long, vector array<double>")
    persons = spark.createDataFrame([(1, "Mary Ann", False, "", None), (2, "Bob", False, "", None)], "person_id long, name string, is_cluster boolean, notes string, avatar_file_id long")
    aliases = spark.createDataFrame([(1, "Annie")], "person_id long, alias string")
    detections = spark.createDataFrame([], "det_id long, file_id long, person_id long, confidence double, quality double, match_confidence double, vector array<double>")
    references = spark.createDataFrame([], "person_id long, source_file_id long, vector array<double>, is_reference boolean")
    links = spark.createDataFrame([(1, 4, "face", 0.9, True, "")], "person_id long, file_id long, link_type string, confidence double, is_confirmed boolean, notes string")
    people = P.People(persons, aliases, detections, references, links)
    return S.Library(files, du(spark, {}, {"objects": ["red shirt"]}), vectors, vectors, people)


def test_search_hides_masks_and_ranks(spark):
    lib = library(spark)
    got = {r.file_id: r for r in S.search(lib, "please find my os", S.Options(NOW)).collect()}
    assert 3 not in got and 1 in got and 2 in got
    assert "secret" not in str(got[2]).replace("Protected", "") and got[2].path == "[PROTECTED PATH]"
    assert 3 in {r.file_id for r in S.search(lib, "please find my os", S.Options(NOW, authenticated=True)).collect()}
    assert 2 not in {r.file_id for r in S.search(lib, "please find my os", S.Options(NOW, protected="hide")).collect()}
    assert got[1].rank == 1 and got[1].badge.startswith("Relevance Score: ")


def test_search_by_person_category_and_order(spark):
    lib = library(spark)
    first = S.search(lib, "photos of annie", S.Options(NOW), image_query=[1.0, 0.0]).first()
    assert first.file_id == 4 and first.person == 0.9
    assert {r.extension for r in S.search(lib, "the os", S.Options(NOW, category="document", sort_by="size_desc")).collect()} <= {".txt", ".pdf"}
    assert [r.file_id for r in S.search(lib, "os", S.Options(NOW, authenticated=True, sort_by="size_asc", formats=("pdf",))).collect()] == [2, 3]
    assert S.search(lib, "zzz", S.Options(NOW)).count() == 0
    assert S.known_names(lib.people, "Bob's files with annie") == {"bob": "Bob", "annie": "Mary Ann"}


def test_ablations(spark):
    lib = library(spark)
    runs = S.ablations(lib, "os notes", S.Options(NOW), [1.0, 0.0], [1.0, 0.0])
    assert set(runs) == {"filename", "text", "text_images", "text_images_dense", "full", "no_filename"}
    assert {r.file_id for r in runs["filename"].collect()} == {1}
    full, bare = ({r.file_id: r.score for r in runs[n].collect()} for n in ("full", "no_filename"))
    assert full[1] > bare.get(1, 0) > 0


def test_evaluation_of_a_search_function(spark):
    lib = library(spark)
    search = lambda sentence, category: S.search(lib, sentence, S.Options(NOW, category=category))
    got = {r.query_id: r for r in X.evaluated(search, [("q1", "os notes", None, ["os_notes.txt"]), ("q2", "nothing here", None, ["x"])], 5).collect()}
    assert got["q1"].hit == 1 and got["q1"].reciprocal_rank == 1.0 and got["q2"].hit == 0


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.write(rows(1)) == 0
    old = t.read()
    assert t.update(lambda r: r.union(rows(2))) == 1
    assert {r.id for r in old.collect()} == {1} and {r.id for r in t.read().collect()} == {1, 2} and t.read(0).count() == 1
    with pytest.raises(Conflict):
        t.write(rows(3), based_on=0)
    t.write(rows(4))
    t.vacuum(keep=1)
    assert list(t.versions()) == [2] and t.read().first().id == 4


def test_vector_store_and_embedder(spark):
    v = spark.createDataFrame([("file", 101, "m", [1.0, 0.0], 2, 0), ("file", 102, "m", [0.9, 0.1], 2, 0), ("file", 103, "n", [0.0, 1.0], 2, 0)], "entity_type string, entity_id long, model_name string, vector array<float>, dimension int, at int")
    store = X.VectorStore(v)
    assert [r.id for r in store.query([1.0, 0.0], "m", 2).collect()] == [101, 102]
    assert store.query([0.0, 0.0], "m").count() == 0
    less = store.delete("file", spark.createDataFrame([(101,)], "entity_id long"))
    assert [r.id for r in less.query([1.0, 0.0], "m", 2).collect()] == [102]
    assert [r.id for r in store.query([1.0, 0.0], "m", 2, keep=lambda i: i > 101).collect()] == [102]
    e = X.HashedWords(16)
    assert np.allclose(np.linalg.norm(e.embed(["a b", "b  A"]), axis=1), 1) and np.allclose(*e.embed(["a b", "b  A"])) and not e.embed([" "]).any()


def test_perceptual_hash_survives_noise():
    rng = np.random.default_rng(1)
    image = np.kron(rng.integers(0, 256, (8, 8)), np.ones((4, 4))).astype(np.float32)
    near, far = image + rng.normal(0, 2, image.shape), rng.integers(0, 256, (32, 32))
    a, b, c = (X.perceptual_hash(x) for x in (image, near, far))
    assert (a ^ b).bit_count() <= 5 < (a ^ c).bit_count()


def test_people_confirm_uses_the_suggestion_and_rejection_is_final(spark):
    lib = library(spark)
    detections = spark.createDataFrame([(1, 4, None, 0.8, 0.9, None, [1.0, 0.0]), (2, 4, None, 0.8, 0.2, None, [0.0, 1.0]), (3, 4, 2, 0.8, 0.2, 1.0, [0.0, 1.0])], lib.people.detections.schema)
    references = spark.createDataFrame([(1, 9, [2.0, 0.0], True)], lib.people.references.schema)
    p = P.People(lib.people.persons, lib.people.aliases, detections, references, lib.people.links)
    assert [tuple(r) for r in P.suggestions(p).collect()] == [(1, 1, 1.0)]
    done = P.confirm_faces(p, spark.createDataFrame([(1, None), (2, None)], "det_id long, person_id long"))
    assert {(r.det_id, r.person_id) for r in done.detections.collect()} == {(1, 1), (2, None), (3, 2)}
    assert done.references.count() == 2 and done.links.filter("person_id = 1 and confidence = 1.0").count() == 1
    gone = P.reject_faces(done, spark.createDataFrame([(1,)], "det_id long"))
    assert P.suggestions(gone).count() == 0 and gone.links.filter("person_id = 1").count() == 0


def test_people_create_twice_and_merge(spark):
    p = library(spark).people
    new = spark.createDataFrame([(" mary ann ", ["MA", "Mary Ann"], "n", 7, False), ("Zoe", [], "", None, False), ("zoe", ["Z"], "", 3, False)], "name string, aliases array<string>, notes string, avatar_file_id long, is_cluster boolean")
    made = P.create_persons(p, new)
    assert {(r.person_id, r.name, r.avatar_file_id) for r in made.persons.collect()} == {(1, "Mary Ann", 7), (2, "Bob", None), (3, "Zoe", 3)}
    assert {tuple(r) for r in made.aliases.collect()} == {(1, "Annie"), (1, "MA"), (3, "Z")}
    merged = P.merge_persons(made, spark.createDataFrame([(1, 2), (2, 2)], "source long, target long"))
    assert {r.person_id for r in merged.persons.collect()} == {2, 3}
    assert (2, "Mary Ann") in {tuple(r) for r in merged.aliases.collect()} and merged.links.first().person_id == 2


def test_understanding_is_replaced_by_version(spark):
    rows = lambda *r: spark.createDataFrame(r, "file_id long, model string, prompt_schema_version string, title string, updated_at int")
    got = U.store(rows((1, "m", "v1", "old", 1), (1, "m", "v2", "two", 1)), rows((1, "m", "v1", "new", 2), (2, "m", "v1", "x", 2)))
    assert {(r.file_id, r.prompt_schema_version, r.title) for r in got.collect()} == {(1, "v1", "new"), (1, "v2", "two"), (2, "v1", "x")}


def test_identities_and_jobs(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x")
    from lodestrata.sources import views

    found = views.read_files(spark, str(tmp_path))
    assert K.identities(found).first().content_hash is None
    assert K.identities(found, hashes=True).first().content_hash == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    files = spark.createDataFrame([(1, "failed"), (2, "indexed")], "file_id long, status string")
    assert [r.file_id for r in K.failed(files).collect()] == [1]


def test_query_terms():
    assert R.query_terms("My DA-3, my OS!") == (["my", "da", "3", "os"], [])
    assert R.query_terms("the lab of") == (["of"], ["the", "lab"])
    assert R.expansion_terms("DBMS da 3")[:3] == ["da 3", "da3", "da-3"]


def test_moves_are_two_events(spark):
    from lodestrata.streaming import events as E

    rows = spark.createDataFrame([(1, "moved", "/a", "/b"), (2, "created", "/c", None)], "ts long, event_type string, path string, dest string")
    assert {tuple(r) for r in E.moved(rows).collect()} == {(1, "deleted", "/a"), (1, "created", "/b"), (2, "created", "/c")}


def test_readers_see_versions_while_batches_are_merged(spark, tmp_path):
    """A stream of batches merges into a versioned table; a search that began before goes on with its version."""
    from lodestrata.streaming import events as E

    t = VersionedTable(spark, str(tmp_path / "t"))
    kind = "file_id long, text string, at int"
    t.write(spark.createDataFrame([(1, "old", 0)], kind))
    before = t.read()
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "new", 1), (2, "two", 1)], kind).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    E.ingest(stream, str(tmp_path / "check"), lambda batch, _: t.update(lambda rows: K.merged(rows, batch, ["file_id"], "at")))
    assert {r.text for r in before.collect()} == {"old"} and {r.text for r in t.read().collect()} == {"new", "two"}


def test_stored_index_reads_the_buckets_of_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"alpha beta {'gamma ' * (k % 4)} w{k}") for k in range(50)], "id long, text string")
    R.write_index(docs, "id", "text", str(tmp_path / "i"))
    for terms, prefixes in ((["alpha", "gamma"], []), (["gamma"], ["w1"]), ([], ["w"])):
        want = {r.id: round(r.score, 9) for r in R.bm25(docs, "id", "text", terms, prefixes).collect()}
        found = R.bm25_indexed(spark, str(tmp_path / "i"), terms, prefixes)
        assert {r.id: round(r.score, 9) for r in found.collect()} == want
    plan = R.bm25_indexed(spark, str(tmp_path / "i"), ["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket#" in plan.split("PartitionFilters:")[1][:60]


def test_file_lists(spark):
    from lodestrata.operators import catalogue as C

    f = spark.createDataFrame([(1, "b.JPG", ".JPG", 5), (2, "A.png", ".png", 7), (3, "c.mp4", ".mp4", 9)], "file_id long, filename string, extension string, size_bytes long")
    assert [r.file_id for r in C.ordered(f, "az").collect()] == [2, 1, 3]
    assert [r.file_id for r in C.videos(f).collect()] == [3]
    assert [r.file_id for r in C.ordered(C.shown(f, gallery=True), "size").collect()] == [2, 1]
    assert [r.file_id for r in C.shown(f, category_="all", formats=["jpg"]).collect()] == [1]


def test_translations_come_from_the_cache(spark):
    q = spark.createDataFrame([(" Photo ",), ("other",)], "query string")
    cache = q.limit(1).select(K.translation_key(F.lit("photo"), F.lit("m"), F.lit("en")).alias("cache_key"), F.lit("picture").alias("translated_text"))
    assert {(r.query, r.translated_text, r.was_translated) for r in K.translated(q, cache, "m", "en").collect()} == {(" Photo ", "picture", True), ("other", "other", False)}


def test_dates_score_captures_first(spark):
    from lodestrata.plans.planner import parse

    plan = parse("notes from 9 December 2023", NOW)
    rows = spark.createDataFrame([(1, date(2023, 12, 9), 0.0), (2, None, 1702080000.0), (3, None, 1702080000000.0), (4, date(2020, 1, 1), 1702080000.0), (5, None, None)], "file_id long, capture_date date, modified_at double")
    assert [r.s for r in rows.select("file_id", S.date_score(plan, rows).alias("s")).orderBy("file_id").collect()] == [1, 1, 1, -1, 0]


def test_answers_of_any_types(spark):
    fence = "`" * 3
    rows = ['{"document_type":" Invoice ","title":"","dates":["2020",5,1.5,null," ",{"a":1},["x"]],"people":"Bob","colors":{"a":1},"attributes":{"a":"b","n":2},"confidence":"0.5"}', f'text {fence}json\n{{"title":"T","objects":[]}}\n{fence} more', 'noise {"description":" d ","people":7} tail', None, "", "[1,2]", "broken {", '{"attributes":[1],"confidence":0.25,"title":5}']
    got = {r.k: r for r in U.answered(spark.createDataFrame([(k, r, "old") for k, r in enumerate(rows)], "k int, raw_response string, title string")).collect()}
    assert (got[0].document_type, got[0].title, got[0].dates, got[0].people, got[0].colors, got[0].attributes, got[0].confidence) == ("invoice", None, ["2020", "5", "1.5"], ["Bob"], [], {"a": "b", "n": "2"}, 0.5)
    assert got[1].title == "T" and got[2].description == "d" and got[2].people == [] and got[7].title == "5" and got[7].attributes == {} and got[7].confidence == 0.25
    assert [got[k].is_json for k in range(8)] == [True, True, True, False, False, False, False, True]
    assert got[3].document_type == "document" and got[3].description == "" and got[3].confidence == 1.0
