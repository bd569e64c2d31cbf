import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestrata.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_words = len(counts), sum(sum(c.values()) for _, c in counts)
    by_item = {}
    for i, t in items:
        by_item.setdefault(i, set()).update(terms(t))
    out = set()
    for item, ts in by_item.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t in ts if (df := sum(t in c for _, c in counts))}
        scored = []
        for d, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // n_words
            scored.append((-sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t, w in weight.items()), -math.inf if d is None else d))
        for rank, (s, d) in enumerate(sorted(x for x in scored if x[0])[:k], 1):
            out.add((item, rank, None if d == -math.inf else d, -s))
    return out


def made(seed=4, n=900):
    rng = random.Random(seed)
    vocabulary = ["the", "of", *(f"w{k}" for k in range(200)), "Über", "ÜBER", "x1y", "a"]
    weights = [300, 150, *(200 / (k + 1) for k in range(200)), 3, 3, 3, 5]
    text = lambda: rng.choice([" ", "-", "_", "."]).join(rng.choices(vocabulary, weights, k=int(rng.paretovariate(1.1) * 8)))[:20_000]
    docs = [(k, text()) for k in range(n)]
    docs += [(n + k, docs[7][1]) for k in range(120)]  # copies tie
    docs += [(2000, None), (2001, ""), (2002, "... ---"), (3, docs[3][1]), (None, docs[5][1] + " the"), (2003, "the " * 30_000), (2004, "THE OF")]
    items = [(k, text() if k % 3 else docs[k][1][:200]) for k in range(25)] + [(90, "zzz unseen"), (91, ""), (92, None), (93, "the"), (94, docs[7][1]), (95, "of w1"), (95, "w2 of of"), (None, "w3 w4")]
    rng.shuffle(docs)
    return docs, items


def test_whole_query(spark, monkeypatch):
    docs, items = made()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS n", "'a' AS terms", "2 AS score")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 AS rank", "8 AS doc_id")
    want = brute(docs, items, 50)
    found = [tuple(r) for r in L.search_report(d, i).collect()]
    assert len(found) == len(want) and set(found) == want
    # in blocks of items, and short texts in many slices
    monkeypatch.setattr(L, "SLICE", 40)
    assert {tuple(r) for r in L.search(d, i, 7, block_terms=60).collect()} == brute(docs, items, 7)
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d.filter("text is null"), i)):
        assert L.search(a, b).count() == 0


def test_text_ids(spark):
    docs, items = made(n=100)
    i = spark.createDataFrame([(str(k), t) for k, t in items if k is not None], "item_id string, text string")
    found = {tuple(r) for r in L.search(spark.createDataFrame(docs, "doc_id long, text string"), i, 5).collect()}
    assert found == brute(docs, [(str(k), t) for k, t in items if k is not None], 5)


def error(impacts, cuts, price):
    return sum((b - a) * max(impacts[a:b]) + price for a, b in zip(cuts, [*cuts[1:], len(impacts)], strict=True))


@pytest.mark.parametrize("widest", [1, 3, 8])
def test_blocks_have_the_least_error(widest):
    """Against all ways to cut short lists."""
    rng = random.Random(widest)
    lists = [[rng.choice([1, 2, 5, 9, 40]) for _ in range(rng.randint(0, 9))] for _ in range(40)]
    offsets = np.r_[0, np.cumsum([len(x) for x in lists])]
    impacts = np.array([v for x in lists for v in x], np.int64)
    starts = set(L.block_starts(impacts, offsets, widest, 1.5).tolist())
    for t, x in enumerate(lists):
        if not x:
            continue
        price = 1.5 * sum(x) / len(x)
        mine = [k for k in range(len(x)) if offsets[t] + k in starts]
        ways = ([0, *(k for k in range(1, len(x)) if mask >> (k - 1) & 1)] for mask in range(1 << (len(x) - 1)))
        fit = [w for w in ways if max(np.diff([*w, len(x)])) <= widest]
        assert mine[0] == 0 and mine in fit
        assert math.isclose(error(x, mine, price), min(error(x, w, price) for w in fit))


def shard_of(rng, size, n_terms):
    lengths = rng.integers(20, 400, size)
    lengths[: size // 50] = 10
    terms, docs, tfs = [], [], []
    for t in range(n_terms):
        own = np.flatnonzero(rng.random(size) < 0.6 / (t + 1))
        terms.append(np.full(len(own), t))
        docs.append(own)
        tfs.append(rng.geometric(0.5, len(own)) + 20 * (rng.random(len(own)) < 0.004))
    terms, docs, tfs = (np.concatenate(x) for x in (terms, docs, tfs))
    order = np.lexsort((terms, docs))
    return L.Shard(rng.permutation(size), lengths, terms[order].astype(np.int32), docs[order].astype(np.int32), tfs[order], n_terms, size, int(lengths.sum()))


def test_blocks_are_skipped_and_nothing_is_missed():
    rng = np.random.default_rng(3)
    shard = shard_of(rng, 30_000, 12)
    none = np.empty(0, np.int64)
    work = []
    for ts in ([0], [0, 3], [1, 5, 9], [8, 11], list(range(12))):
        ts = np.array(ts)
        ws = rng.integers(1, 3000, len(ts))
        exact = np.zeros(len(shard.ids), np.int64)
        for t, w in zip(ts, ws, strict=True):
            own = np.arange(shard.offsets[t], shard.offsets[t + 1])
            np.add.at(exact, shard.docs[own], w * shard.impact(own))
        order = np.lexsort((shard.ids, -exact))[:10]
        order = order[exact[order] > 0]
        shard.opened = shard.blocks = shard.scored = 0
        scores, ids = shard.best(ts, ws, 10, none, none)
        assert scores.tolist() == exact[order].tolist() and ids.tolist() == shard.ids[order].tolist()
        work.append((shard.opened / shard.blocks, shard.scored / len(shard.ids)))
    assert all(o <= 1 and s < 0.1 for o, s in work) and work[0][0] < 0.2 and work[1][0] < 0.6, work
    # what is already better closes everything
    shard.opened = 0
    shard.best(np.array([0]), np.array([1]), 2, np.array([1 << 60, 1 << 60]), np.array([1, 2]))
    assert shard.opened == 0


def test_runs_have_bounds():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(50)), "n": [3] * 50, "terms": pa.array([[1] * (k % 5) for k in range(50)], pa.list_(pa.int32())), "tfs": pa.array([[2] * (k % 5) for k in range(50)], pa.list_(pa.int32()))})
    runs = list(L._shards(iter([batch, batch.slice(0, 0), batch.slice(7)]), 9, 12))
    assert np.concatenate([r[0] for r in runs]).tolist() == [*range(50), *range(7, 50)]
    assert all(len(r[0]) <= 9 and len(r[2]) <= 12 for r in runs)
    assert sum(len(r[2]) for r in runs) == sum(k % 5 for k in [*range(50), *range(7, 50)])
    # a row that is larger than the bound is a run of its own
    assert [len(r[0]) for r in L._shards(iter([batch.slice(3, 3)]), 9, 2)] == [1, 1, 1]
