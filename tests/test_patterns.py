import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import patterns as P
from lodestrata.operators import entities as E


def test_all_patterns_in_one_pass(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abc ", k=rng.randint(1, 4)))
    patterns = [*(word() for _ in range(60)), "", "é", "abc", "abc", "b"]
    texts = ["".join(rng.choices("abcé ", k=rng.randint(0, 60))) for _ in range(200)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", P.found(F.col("text"), patterns).alias("p"))
    first = {p: k for k, p in reversed(list(enumerate(patterns))) if p}
    for r in rows.collect():
        assert r.p == sorted(k for p, k in first.items() if p in (texts[r.id] or ""))
    some = rows.select(P.among(F.col("p"), patterns, ["é", "abc", "é"]).alias("n"), "id").collect()
    assert all(r.n == ("é" in (texts[r.id] or "")) + ("abc" in (texts[r.id] or "")) for r in some)


def test_no_patterns_and_too_many(spark, monkeypatch):
    assert P.Automaton([]).found("text") == [] and P.Automaton([""]).found("text") == []
    monkeypatch.setattr(P, "MOST_BYTES", 5)
    with pytest.raises(ValueError):
        P.Automaton(["abc", "défg"])


def test_mentions_of_many_names_are_those_of_the_join(spark):
    rng = random.Random(4)
    names = [" ".join(rng.choice(["Ann", "Bo", "Cy", "Dee", "Éva", "Fox"]) for _ in range(rng.randint(1, 3))) for _ in range(40)] + [f"Person {k}" for k in range(100_000)]
    persons = spark.createDataFrame([(k, n, [f"alias{k}"] if k % 3 else None) for k, n in enumerate(names)], "person_id long, name string, aliases array<string>")
    files = [(k, " ".join(rng.choice(["ann", "BO", "cy,", "dee-", "éva", "fox", "person", "17", "alias1", "annex"]) for _ in range(12))) for k in range(60)] + [(98, None), (99, "")]
    rows = spark.createDataFrame(files, "file_id long, extracted_text string")
    one = {tuple(r) for r in E.text_mentions(persons, rows).collect()}
    assert one == {tuple(r) for r in E.text_mentions(persons, rows, most_bytes=10).collect()} and len(one) > 100
