import random

import numpy as np
import pytest

from lodestrata.llm import resemblance as R


@pytest.mark.parametrize("power", range(10, 33))
def test_recall_at_every_size(power):
    """By calculation at every size, and drawn: pairs of sketches at the similarity agree in a table's prefix."""
    tries = R.Tries(2**power, 0.8)
    assert tries.found(tries.tables) >= R.RECALL
    assert tries.width == max(12, power - 6)
    assert all(len(set(tries.places(t).tolist())) == 64 for t in range(0, tries.tables, 7))
    if power % 4:
        return
    apart = np.random.default_rng(power).random((6_000, R.WORDS * 64)) < tries.differ
    met = np.zeros(len(apart), bool)
    for t in range(tries.tables):
        met |= ~apart[:, tries.places(t)[: tries.width]].any(axis=1)
    assert met.mean() >= R.RECALL - 0.005


def test_tables_up_to_2_18_nodes_are_the_disjoint_runs():
    tries = R.Tries(50_000, 0.8)
    assert tries.tables == 31 and sorted(b for t in range(31) for b in tries.places(t)[:12].tolist()) == list(range(372))


def test_rounds_and_drawn_orders_find_the_same_components(spark, monkeypatch):
    rng = random.Random(8)
    texts = []
    for g in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(120)]
        for _ in range(rng.randint(1, 5)):
            copy = list(words)
            copy[rng.randrange(120)] = "x"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {tuple(r) for r in R.near_duplicates(docs).collect()}
    monkeypatch.setattr(R, "ROUND", 20)
    assert {tuple(r) for r in R.near_duplicates(docs).collect()} == want
    # as many tables as a collection of 2^30 nodes has, in several orders of the bits
    monkeypatch.setattr(R, "LEAST_WIDTH", 24)
    monkeypatch.setattr(R, "ROUND", 160)
    assert R.Tries(60, 0.8).tables > R.Tries(60, 0.8).runs
    assert {tuple(r) for r in R.near_duplicates(docs).collect()} == want


def test_salts_of_a_bucket_meet_where_all_its_pairs_are_similar(spark, monkeypatch):
    """Pairs of near copies whose members lie in different salts in every table, and nothing else that is alike."""
    rng = random.Random(3)
    rows = []
    for g in range(6):
        words = [f"w{rng.randrange(100_000)}" for _ in range(200)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join([*words[:-1], "x"]))]
    monkeypatch.setattr(R, "BUCKET_ROWS", 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in R.near_duplicates(docs).collect()} == {(k, k - k % 2) for k in range(12)}
