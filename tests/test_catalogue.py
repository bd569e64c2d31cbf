import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as entry
from lodestrata.plans import registry as catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_duckdb(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.sql(catalogue.SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    at = [found.columns.index(c) for c in df.columns]
    want = [tuple(plain(r[k]) for k in at) for r in found.fetchall()]
    assert sorted((tuple(plain(v) for v in r) for r in df.collect()), key=str) == sorted(want, key=str)


def overlaps(a, b):
    w = min(a.x + a.w, b.x + b.w) - max(a.x, b.x)
    h = min(a.y + a.h, b.y + b.h) - max(a.y, b.y)
    inner, least = max(0, w) * max(0, h), min(a.w * a.h, b.w * b.h)
    return least > 0 and (inner / (a.w * a.h + b.w * b.h - inner) >= 0.35 or inner / least >= 0.5)


def test_suppression_by_hand(spark):
    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select(F.col("l_suppkey").alias("image_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("det_id"), (F.col("l_quantity") * 3).alias("x"), (F.col("l_tax") * 1000).alias("y"), (F.lit(20.0) + F.col("l_discount") * 100).alias("w"), F.lit(25.0).alias("h"), F.col("l_extendedprice").alias("confidence")).collect()
    kept: dict = {}
    for r in sorted(rows, key=lambda r: (-r.confidence, r.det_id)):
        if not any(overlaps(r, k) for k in kept.get(r.image_id, [])):
            kept.setdefault(r.image_id, []).append(r)
    want = {(i, r.det_id) for i, found in kept.items() for r in found}
    assert {tuple(r) for r in catalogue.QUERIES["n8_suppression"](spark, SF).collect()} == want


def test_propagation_by_hand(spark):
    import numpy as np

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    unit = lambda r: np.array(r.embedding, float) / np.linalg.norm(np.array(r.embedding, float))
    known = [(r.label, unit(r)) for r in rows if r.vec_id % 9 == 0]
    open_ = {r.vec_id: unit(r) for r in rows if r.vec_id % 9}
    found = {}
    while True:
        new = {}
        for d, v in open_.items():
            best = {}
            for who, w in known:
                best[who] = max(best.get(who, -2), float(v @ w))
            ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))
            second = ranked[1][1] if len(ranked) > 1 else -1
            if ranked[0][1] >= 0.4 and (second < 0 or ranked[0][1] - second >= 0.03):
                new[d] = ranked[0][0]
        if not new:
            break
        found |= new
        known += [(who, open_.pop(d)) for d, who in new.items()]
    assert {tuple(r) for r in catalogue.QUERIES["r24_propagation"](spark, SF).collect()} == set(found.items())


def test_attempts_by_hand(spark):
    got = catalogue.QUERIES["t7_attempt_outcomes"](spark, SF).collect()
    state: dict = {}
    for r in sorted(got, key=lambda r: (r.user_id, r.ts, r.ok)):
        recent, until = state.get(r.user_id, ([], 0.0))
        if r.ts < until:
            want = "locked"
        elif r.ok:
            recent, until, want = [], 0.0, "ok"
        else:
            recent, want = [x for x in recent if r.ts - x < 200_000] + [r.ts], "failed"
            until = r.ts + 100_000 if len(recent) >= 3 else until
        state[r.user_id] = recent, until
        assert r.outcome == want
    assert {r.outcome for r in got} == {"locked", "ok", "failed"}


def test_embedder_and_hashes_by_hand(spark):
    import numpy as np

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = catalogue.QUERIES["x1_embedded_texts"](spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        want = [0.0] * 64
        for word in (texts[r.doc_id] or "").lower().split():
            b = hashlib.blake2b(word.encode(), digest_size=8).digest()
            sign = 1 if b[5] & 1 else -1
            want[(b[0] + 256 * b[1]) % 64] += sign
            want[(b[2] + 256 * b[3]) % 64] += sign
        size = sum(v * v for v in want) ** 0.5 or 1
        assert np.allclose(r.vector, [v / size for v in want], atol=1e-5)
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    d = np.array([[np.sqrt((1 if k == 0 else 2) / 32) * np.cos(np.pi * (2 * x + 1) * k / 64) for x in range(32)] for k in range(32)])
    for r in catalogue.QUERIES["p7_perceptual_hashes"](spark, SF).collect():
        image = np.concatenate([np.array(vectors[r.vec_id]) * k for k in range(1, 17)]).reshape(32, 32)
        low = (d @ image @ d.T)[:8, :8]
        median = np.median(low[1:, 1:])
        clear = np.abs(low - median) > 1e-4  # float32 and float64 may part at the border
        bits = np.array([int(b) for b in f"{int(r.phash, 16):064b}"], bool).reshape(8, 8)
        assert ((low > median) == bits)[clear].all() and r.hash % 2**64 == int(r.phash, 16)


def test_every_query_has_sql_or_a_test_by_hand():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"n8_suppression", "r24_propagation", "t7_attempt_outcomes", "x1_embedded_texts", "p7_perceptual_hashes"}


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_search_reads_the_texts_three_times_at_most(spark):
    """Statistics and scores of text and all expansions, and the rows that are shown."""
    import re

    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = catalogue.QUERIES["q_search_academic"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet .*?ReadSchema: struct<([^>]*)", plan)
    assert scans and sum("text:" in s for s in scans) <= 3
