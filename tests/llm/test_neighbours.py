import numpy as np
import pytest

from lodestrata.llm import neighbours as N


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2), (1, 5)])
def test_hilbert_is_a_walk_over_all_cells(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    keys = N.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def brute(rows, k=20):
    ok = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 16]
    out = {}
    for q, v in ok:
        if q % 20 == 0:
            best = {}
            for i, w in ok:
                if i != q:
                    best[i] = max(best.get(i, -9e9), float((v * w).sum()))
            out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")


def vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    return [(k, x[k].tolist()) for k in range(n)]


def test_small_table_is_exact(spark):
    rows = vectors(300)
    rows += [(1000 + k, rows[0][1]) for k in range(60)]  # ties
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [None] + [1.0] * 15), (2060, [float("nan")] * 16), (2080, [float("inf")] * 16), (2100, [1.0]), (None, rows[1][1]), (7, rows[3][1]), (2120, [])]
    got = {}
    for r in N.neighbour_report(frame(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows)
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(found) + 1))
        assert [f[1] for f in found] == [w[0] for w in want[q]]
        assert np.allclose([f[2] for f in found], [w[1] for w in want[q]], rtol=0, atol=1e-12)


def test_few_and_none(spark):
    assert len(N.neighbour_report(frame(spark, vectors(5))).collect()) == 4
    assert N.neighbour_report(frame(spark, vectors(1))).count() == 0
    assert N.neighbour_report(frame(spark, [])).count() == 0


def test_recall_over_blocks_and_salts(spark, monkeypatch):
    """Windows of an eighth of each ordering, over many blocks, partitions and salts."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 100)
    monkeypatch.setattr(N, "QUERY_ROWS", 7)
    rows = vectors(2000, 3)
    got = {}
    for r in N.nearest(frame(spark, rows), lambda key: key % 20 == 0, curves=24, reach=128).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    want = brute(rows)
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_windows_are_the_neighbours_in_key_order(spark, monkeypatch):
    """With one ordering the candidates of a query are the ``reach`` vectors on either side."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    rows = vectors(300, 5)
    found, _ = N.folded(N.usable(frame(spark, rows), "vec_id", "embedding"), lambda key: key % 20 == 0, 20)
    reps = N.persist_table(found.withColumn("stratum", N.F.lit(0)), "vectors")
    ordering = N.Orderings(16, np.empty((0, 16)), 1, 4)
    ordered = N.persist_table(N.in_order(N.placed(reps, {(16, 0): 0}, {(16, 0): ordering}), 7), "ordered")
    line = [r.rid for r in ordered.filter("not asks").orderBy("pos").collect()]
    keys = [r.key for r in ordered.filter("not asks").orderBy("pos").collect()]
    assert keys == sorted(keys) and len(set(line)) == 300
    met = {}
    for r in N.screened(ordered, {0: 3}, 10, 500).collect():
        met.setdefault(r.q, set()).add(r.b)
    asked = {r.rid: r.pos for r in ordered.filter("asks").collect()}
    assert len(asked) == 15
    for q, pos in asked.items():
        assert met[q] == set(line[max(0, pos - 10) : pos + 10])


def test_ids_of_other_types_widths_and_repeats(spark):
    rows = [(f"id{k:04}", v) for k, v in vectors(200, 9)] + [("id0000", vectors(1, 8)[0][1])] + [(f"w{k}", [1.0, float(k)]) for k in range(30)]
    docs = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    got = {}
    for r in N.nearest(docs, lambda key: key.isin("id0000", "id0100", "w3")).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert [i for i, _ in got["w3"]] == [f"w{k}" for k in range(29, 8, -1)][:20]
    for q in ("id0000", "id0100"):
        own = [np.array(v) for i, v in rows if i == q]
        best = {}
        for i, v in rows:
            if i != q and len(v) == 16:
                best[i] = max([best.get(i, -9e9), *[float((o * np.array(v)).sum()) for o in own]])
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20]
        assert [i for i, _ in got[q]] == [i for i, _ in want]
        assert np.allclose([x for _, x in got[q]], [x for _, x in want], atol=1e-12)


def test_recall_of_unequal_norms(spark):
    rng = np.random.default_rng(11)
    n = 21_000
    x = rng.normal(size=(n, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True) * np.exp(rng.normal(size=(n, 1)))).astype(np.float32)
    got = {}
    for r in N.nearest(frame(spark, [(k, x[k].tolist()) for k in range(n)]), lambda key: key % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    exact = x.astype(np.float64)
    score = exact[::100] @ exact.T
    score[np.arange(len(score)), np.arange(0, n, 100)] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([len(got[100 * q] & set(best[q].tolist())) / 20 for q in range(len(best))]) >= 0.95


def test_recall_of_tight_clusters(spark):
    """Vectors that share their cells, and differ by less than a signed byte tells."""
    rng = np.random.default_rng(21)
    n, centres = 9_000, 4
    c = rng.normal(size=(centres, 32))
    x = (c[rng.integers(0, centres, n)] + 0.01 * rng.normal(size=(n, 32))).astype(np.float32)
    got = {}
    for r in N.nearest(frame(spark, [(k, x[k].tolist()) for k in range(n)]), lambda key: key % 100 == 0, curves=8, reach=128).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    exact = x.astype(np.float64)
    score = exact[::100] @ exact.T
    score[np.arange(len(score)), np.arange(0, n, 100)] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([len(got[100 * q] & set(best[q].tolist())) / 20 for q in range(len(best))]) >= 0.9
