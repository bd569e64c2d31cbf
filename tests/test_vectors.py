import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import duplicates as D
from lodestrata.operators import entities as E
from lodestrata.operators import people as P
from lodestrata.operators import vectors as V


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def clustered(n, centres, seed=1, spread=0.1, dim=12):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    x = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(3)


def brute(x, t, y=None):
    dots = np.zeros((len(x), len(x if y is None else y)))
    for k in range(x.shape[1]):
        dots += np.multiply.outer(x[:, k], (x if y is None else y)[:, k])
    i, j = np.nonzero(dots >= t)
    return {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if y is not None or a < b}


def test_pairs_of_clusters_and_what_is_compared(spark, monkeypatch):
    monkeypatch.setattr(V, "BALL", 100)
    monkeypatch.setattr(V, "VISITS", 150)  # popular balls are copied
    x = clustered(2400, 40, spread=0.06)
    x[700:1100] = x[5]  # a hot ball that no pivot can split
    x[1100:1110] = -x[5]
    rows = frame(spark, x)
    found = [tuple(r) for r in V.similar_pairs(rows, 0.9).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(x, 0.9)
    compared = V.compared_pairs(rows, 0.9)
    assert compared < 0.3 * len(x) ** 2 / 2, compared


def test_pairs_at_the_border_of_any_norm_and_of_two_sides(spark, monkeypatch):
    monkeypatch.setattr(V, "BALL", 40)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 4)), 1)  # many products are the threshold itself
    x[:5] *= 6
    assert {tuple(r) for r in V.similar_pairs(frame(spark, x), 1.5).collect()} == brute(x, 1.5)
    y = np.round(rng.normal(size=(120, 4)), 1)
    found = [tuple(r) for r in V.similar_pairs(frame(spark, x), 1.5, frame(spark, y)).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(x, 1.5, y)


def test_odd_rows_take_no_part(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, None]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, 0.0]), (None, [1.0, 0.0]), (5, [1.0, 0.0])], "id long, v array<double>")
    assert sorted(tuple(r) for r in V.similar_pairs(rows, 0.5).collect()) == [(1, 5), (1, 5)]
    assert V.similar_pairs(rows.limit(0), 0.5).count() == 0 and V.best_two(rows, rows.limit(0).withColumnRenamed("id", "tag")).count() == 0
    text = rows.filter("id is not null").withColumn("id", F.concat(F.lit("k"), "id"))
    assert {tuple(r) for r in V.similar_pairs(text, 0.5).collect()} == {("k1", "k5")}


def brute_two(x, refs, tags):
    out = set()
    for k, v in enumerate(x):
        best: dict = {}
        for t, r in zip(tags, refs, strict=True):
            s = 0.0
            for a, b in zip(v.tolist(), r.tolist(), strict=True):
                s += a * b
            best[t] = max(best.get(t, -9.0), s)
        out |= {(k, t, s) for t, s in sorted(best.items(), key=lambda i: (-i[1], i[0]))[:2]}
    return out


def test_two_best_persons(spark, monkeypatch):
    monkeypatch.setattr(V, "BALL", 50)
    monkeypatch.setattr(V, "VISITS", 30)
    x, refs = clustered(250, 12, seed=2), clustered(330, 12, seed=2, spread=0.2)
    tags = [int(k) for k in np.random.default_rng(3).integers(0, 25, len(refs))]
    refs[100:130] = refs[3]  # equal references of several persons
    references = spark.createDataFrame([(t, r.tolist()) for t, r in zip(tags, refs, strict=True)], "tag long, v array<double>")
    assert {tuple(r) for r in V.best_two(frame(spark, x), references).collect()} == brute_two(x, refs, tags)
    monkeypatch.setattr(V, "BALL", 500)  # few references go to the tasks as they are
    assert {tuple(r) for r in V.best_two(frame(spark, x), references).collect()} == brute_two(x, refs, tags)
    one = references.withColumn("tag", F.lit(7))  # an int
    assert {(r.id, r.tag) for r in V.best_two(frame(spark, x), one).collect()} == {(k, 7) for k in range(len(x))}


def test_propagation_by_increments(spark):
    """Against rounds that compare everything anew."""
    x = clustered(160, 9, seed=6, spread=0.25, dim=6)
    tags = {k: k % 9 for k in range(0, 160, 20)}

    def rounds(confirmed, lead):
        known, open_, found = [(t, x[k]) for k, t in tags.items()], [k for k in range(160) if k not in tags], set()
        while True:
            new = []
            for k in open_:
                best: dict = {}
                for t, r in known:
                    best[t] = max(best.get(t, -9.0), float(x[k] @ r))
                top = sorted(best.items(), key=lambda i: (-i[1], i[0]))
                second = top[1][1] if len(top) > 1 else -1.0
                if top[0][1] >= confirmed and (1.0 if second < 0 else top[0][1] - second) >= lead:
                    new.append((k, top[0][0]))
            if not new:
                return found
            found |= set(new)
            known += [(t, x[k]) for k, t in new]
            open_ = [k for k in open_ if k not in dict(new)]

    faces = spark.createDataFrame([(k, x[k].tolist()) for k in range(160) if k not in tags], "det_id long, det_vector array<double>")
    references = spark.createDataFrame([(t, x[k].tolist()) for k, t in tags.items()], "person_id long, ref_vector array<double>")
    want = rounds(0.9, 0.03)
    assert len(want) > 20
    assert {tuple(r) for r in E.propagate(faces, references, 0.9, 0.03).collect()} == want


# ---------------------------------------------------------------- Hamming distances


@pytest.mark.parametrize("distance", [0, 2, 5, 8, 14])
def test_hamming_pairs(spark, distance):
    rng = random.Random(distance)
    hashes = [rng.getrandbits(64) for _ in range(120)]
    for h in hashes[:60]:
        for _ in range(2):
            hashes.append(h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, distance + 2))))
    hashes += [0, 0, 0xFFFF, (1 << 64) - 1, hashes[0]]
    rows = [(k, h - (1 << 64) if h >> 63 else h) for k, h in enumerate(hashes)] + [(900, None)]
    want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (a ^ b).bit_count() <= distance}
    found = [tuple(r) for r in D.hamming_pairs(spark.createDataFrame(rows, "id long, hash long").repartition(3), distance, ordered=True).collect()]
    assert found == sorted(want, key=lambda r: (r[2], r[0], r[1]))


def test_few_candidates(spark):
    """Random hashes: pairs met for a row, against the rows that there are."""
    n = 3000
    rows = spark.range(n).select("id", F.xxhash64("id").alias("hash"))
    for distance, share in ((8, 0.004), (14, 0.05)):
        assert D.hamming_candidates(rows, distance).count() < share * n * (n - 1) / 2


# ---------------------------------------------------------------- merges


def test_roots_of_chains_and_cycles(spark):
    pairs = [(1, 0), (2, 1), (3, 2), (3, 9), (10, 11), (11, 12), (12, 10), (13, 12), (14, 13), (20, 21), (21, 20), (30, 30), (40, 41)] + [(100 + k, 101 + k) for k in range(70)]
    found = {r.source: r.target for r in P.merge_roots(spark.createDataFrame(pairs, "source long, target long")).collect()}
    assert found == {1: 0, 2: 0, 3: 0, 11: 10, 12: 10, 13: 10, 14: 10, 21: 20, 40: 41} | {100 + k: 170 for k in range(70)}
    assert P.merge_roots(spark.createDataFrame([], "source long, target long")).count() == 0


def test_no_link_is_left_with_a_person_that_is_gone(spark):
    persons = spark.createDataFrame([(k, f"p{k}", False, "", None) for k in range(6)], "person_id long, name string, is_cluster boolean, notes string, avatar_file_id long")
    aliases = spark.createDataFrame([(0, "zero")], "person_id long, alias string")
    detections = spark.createDataFrame([(k, k, k % 6, 1.0, 1.0, 1.0, [1.0]) for k in range(12)], "det_id long, file_id long, person_id long, confidence double, quality double, match_confidence double, vector array<double>")
    references = spark.createDataFrame([(k, k, [1.0], True) for k in range(6)], "person_id long, source_file_id long, vector array<double>, is_reference boolean")
    links = spark.createDataFrame([(k, f, "face", 0.5, False, "") for k in range(6) for f in range(3)], "person_id long, file_id long, link_type string, confidence double, is_confirmed boolean, notes string")
    p = P.People(persons, aliases, detections, references, links)
    pairs = spark.createDataFrame([(0, 1), (1, 2), (3, 4), (4, 3), (5, 99)], "source long, target long")
    merged = P.merge_persons(p, pairs)
    left = {r.person_id for r in merged.persons.collect()}
    assert left == {2, 3, 5}
    for t in (merged.links, merged.detections, merged.references, merged.aliases):
        assert {r.person_id for r in t.select("person_id").distinct().collect()} <= left
    assert {tuple(r) for r in merged.aliases.collect()} == {(2, "zero"), (2, "p0"), (2, "p1"), (3, "p4")}
    assert merged.links.filter("person_id = 2").count() == 3 and merged.detections.count() == 12


# ---------------------------------------------------------------- stored index


def test_stored_vectors(spark, tmp_path):
    from lodestrata.operators import retrieval as R
    from lodestrata.operators.vector_index import VectorIndex

    x = clustered(1500, 20, seed=9, spread=0.05)
    rows = frame(spark, x).withColumn("label", F.col("id") % 3)
    index = VectorIndex(spark, str(tmp_path / "i"), ball=60)
    assert index.query([1.0] * 12, 3).count() == 0
    index.add(rows, "id", "v", batch=("s", 0))
    now = {k: v for k, v in enumerate(x)}

    def check(q, k=8, **options):
        stored = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in now.items()], "id long, v array<double>, label long")
        want = [(r.id, round(r.score, 9)) for r in R.knn(stored, list(q), k, "id", "v", **options).collect()]
        assert [(r.id, round(r.score, 9)) for r in index.query(list(q), k, **options).collect()] == want

    check(x[3] * 2)
    files = len(index.files())
    assert files > 15 and len(index.read_last) < 0.5 * files
    check(x[700], threshold=0.9, keep=F.col("label") == 1)
    check(-x[3], threshold=0.95)
    before = {f["path"] for f in index.files()}
    for _ in range(2):
        index.add(spark.createDataFrame([(3, (-x[3]).tolist(), 0), (9000, x[3].tolist(), 0), (9001, [0.0] * 12, 0), (9002, None, 0)], "id long, v array<double>, label long"), "id", "v", batch=("s", 1))
    now |= {3: -x[3], 9000: x[3]}
    assert len(before & {f["path"] for f in index.files()}) == len(before) - 1
    check(x[3])
    index.delete(spark.createDataFrame([(9000,), (700,)], "id long"))
    now.pop(9000), now.pop(700)
    check(x[3])
    check(x[700])
    index.vacuum(keep=1)
    check(x[10])
    assert index.query([0.0] * 12, 3).count() == 0


# ---------------------------------------------------------------- vectors without structure, equal references


def loose(n, seed=0, dim=24):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def moved(rows, large, one_sided):
    return V._blocks(rows, large, one_sided).count()


def test_vectors_without_structure_visit_few_blocks(spark, monkeypatch):
    """Balls sent nearly every vector to nearly every ball."""
    monkeypatch.setattr(V, "BALL", 50)
    x = loose(1500)
    rows = frame(spark, x)
    found = [tuple(r) for r in V.similar_pairs(rows, 0.5).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(x, 0.5)
    assert moved(*V._levels(V._rows(rows, True), 2 * V._radius(rows, 0.5), False), False) <= 3 * len(x)
    y = loose(300, 1)
    assert {tuple(r) for r in V.similar_pairs(frame(spark, y), 0.5, rows).collect()} == brute(y, 0.5, x)


@pytest.mark.parametrize("ball", [50, 5000])
def test_links_join_what_the_pairs_join(spark, monkeypatch, ball):
    monkeypatch.setattr(V, "BALL", ball)
    x = np.vstack([loose(700), clustered(500, 30, spread=0.05, dim=24)])
    x[800:900] = x[3]  # equal vectors
    rows = frame(spark, x).withColumn("id", F.when(F.col("id") % 50 == 7, F.col("id") - 1).otherwise(F.col("id")))  # some ids have two vectors
    pairs, links = V.similar_pairs(rows, 0.55), V.similar_links(rows, 0.55)
    assert {tuple(r) for r in links.collect()} <= {tuple(r) for r in pairs.collect()}
    assert links.count() < 0.5 * pairs.count()
    assert {tuple(r) for r in E.components(links).collect()} == {tuple(r) for r in E.components(pairs).collect()}


def test_two_best_of_references_without_structure(spark, monkeypatch):
    monkeypatch.setattr(V, "BALL", 40)
    x, refs = loose(200, 2), loose(900, 3)
    tags = [int(k) for k in np.random.default_rng(3).integers(0, 25, len(refs))]
    references = spark.createDataFrame([(t, r.tolist()) for t, r in zip(tags, refs, strict=True)], "tag long, v array<double>")
    assert {tuple(r) for r in V.best_two(frame(spark, x), references).collect()} == brute_two(x, refs, tags)


def test_equal_references_of_many_persons(spark, monkeypatch):
    """Each face met every person whose reference is as near as its second best."""
    monkeypatch.setattr(V, "BALL", 40)
    x = clustered(20, 4)
    refs = [(t, x[t % 5].tolist()) for t in range(2000)]
    references = spark.createDataFrame(refs, "tag long, v array<double>")
    assert {tuple(r) for r in V.best_two(frame(spark, x), references).collect()} == brute_two(x, x[[t % 5 for t in range(2000)]], range(2000))
    found = list(V._two(np.arange(2000), np.array([r[1] for r in refs]), np.arange(20), x))
    assert sum(b.num_rows for b in found) == 2 * len(x)


def test_some_thousand_references_go_to_the_tasks_without_a_shuffle_of_vectors(spark, monkeypatch):
    """More than BALL references sent every vector to balls or blocks before, as they do with no numbers to spare."""
    rng = np.random.default_rng(3)
    refs = spark.createDataFrame([(k % 7, rng.normal(size=4).tolist()) for k in range(V.BALL + 100)], "tag long, v array<double>")
    faces = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(50)], "id long, v array<double>")
    moved = lambda rows: "RepartitionByExpression" in rows._jdf.queryExecution().optimizedPlan().toString()
    found = V.best_two(faces, refs)
    assert not moved(found)
    monkeypatch.setattr(V, "FEW_NUMBERS", 0)
    dealt = V.best_two(faces, refs)
    assert moved(dealt)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in dealt.collect()}
