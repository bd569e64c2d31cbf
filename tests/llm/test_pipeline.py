import random

import corpus_pipeline as C
import pytest

from pyspark.sql import functions as F

from lodestrata.llm import packing, resemblance

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34 !!", None, None, 8), (10**6 + 2, "", "en", "s", 0)], docs.schema)
    now = docs.union(extra)
    kept = []
    for name, stage in C.STAGES[:-1]:
        now = C.persist_table(stage(spark, now, SF), name)
        assert now.columns == docs.columns
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
    language, near, clean, mixed = kept
    assert language == ids
    assert near < ids and clean < near and mixed <= clean
    text = {r.doc_id: r.text for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(t in text[d] for d in clean for t in items)
    packed = C.STAGES[-1][1](spark, now, SF)
    segments = packing.unpack(packed).collect()
    assert {r.id for r in segments} == mixed


def test_near_duplicates_keep_the_smallest_id(spark):
    rows = [(k, f"text number {k // 2} " + " ".join(f"w{k // 2}x{j}" for j in range(60)), "en", "s", 1) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in C.drop_near_duplicates(spark, docs, SF).collect()} == set(range(0, 20, 2))


def test_near_duplicates_at_similarity_of_0_8_and_more(spark):
    rng = random.Random(7)

    def similarity(a, b):
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        return len(x & y) / len(x | y)

    texts, near, far = [], set(), set()
    for group in range(40):  # a base, a copy at 0.8 to 0.95 and a relative at 0.5 to 0.75
        base = [f"g{group}w{rng.randrange(5000)}" for _ in range(300)]
        texts.append(base)
        for low, high, ids in ((0.80, 0.95, near), (0.5, 0.75, far)):
            copy = list(base)
            while not low <= similarity(base, copy) < high:
                copy = list(base)
                for at in rng.sample(range(300), rng.randrange(1, 30)):
                    copy[at] = f"new{rng.random()}"
            ids.add(len(texts))
            texts.append(copy)
    assert all(similarity(texts[k], texts[j]) < 0.8 for k in far for j in (k - 2, k - 1))
    rows = [(k, " ".join(t), "en", "s", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in C.drop_near_duplicates(spark, docs, SF).collect()} == set(range(len(texts))) - near


def test_language_stage_rejects_what_no_profile_resembles(spark):
    rng = random.Random(3)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(300))
    odd = ["\u0411\u044b\u0441\u0442\u0440\u0430\u044f \u043b\u0438\u0441\u0430", "\u4eca\u65e5\u306f", noise]
    extra = spark.createDataFrame([(10**6 + k, t, None, "s", len(t)) for k, t in enumerate(odd)], docs.schema)
    kept = {r.doc_id for r in C.identify_language(spark, docs.union(extra), SF).collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}


def test_run(spark):
    assert C.run(spark, SF).count() > 0


@pytest.mark.parametrize("stage", [s for _, s in C.STAGES])
def test_empty(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert stage(spark, docs, SF).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    """All pairs of distinct texts at a similarity of 0.8 or more, and the components of these links."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10**6, None), (10**6 + 1, "  "), (10**6 + 2, "a b"), (10**6 + 3, "A  b")]

    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    groups = {}
    for d, t in rows:
        groups.setdefault(shingles(t), []).append(d)
    sets, root = list(groups), {}
    first = {s: min(groups[s]) for s in sets}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    met = {(i, j) for h in holders.values() for i in h for j in h if i < j}
    for i, j in met:
        a, b = sets[i], sets[j]
        if len(a & b) >= 0.8 * len(a | b):
            x, y = find(first[a]), find(first[b])
            root[max(x, y)] = min(x, y)
    want = {(d, find(first[s])) for s, ids in groups.items() for d in ids}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.id, r.component_id) for r in resemblance.near_duplicates(table).collect()} == want


def test_near_duplicates_of_hot_buckets_over_salts(spark, monkeypatch):
    monkeypatch.setattr(resemblance, "BUCKET_ROWS", 7)
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for k in range(60):
        copy = list(base)
        for at in rng.sample(range(120), k % 3):
            copy[at] = f"n{k}x{at}"
        rows.append((k, " ".join(copy)))
    got = resemblance.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_stages_take_nulls_repeats_and_clashing_columns(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, "the same words in a row that go on and on", "en", "s", 1), (1, "one document of its own with some words", "en", "s", 1), (1, "another text under the id of the first one", "en", "s", 1), (2, None, None, None, None), (2, None, None, None, None), (3, "x" * 300_000, "en", "s", 1)]
    extra = [(F.lit(9).alias(n)) for n in ("fp", "score", "lang_pred", "component", "rate", "row", "words", "id")]
    docs = spark.createDataFrame(rows, names).select("*", *extra)
    for name, stage in C.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        assert kept.count() <= 20
    near = C.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in near).count("1") == 2 and any(r.doc_id is None for r in near)
    assert C.pack_tokens(spark, docs, SF).count() > 0
