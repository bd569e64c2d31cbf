import random

import numpy as np
import pytest

from lodestrata.llm import substring, suffix, superwindows

rng = random.Random(11)


def sorted_suffixes(strings):
    rows = sorted((s[k:], i, k) for i, s in enumerate(strings) for k in range(len(s) + 1))
    lcp = [0]
    for (a, _, _), (b, _, _) in zip(rows, rows[1:], strict=False):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        lcp.append(n)
    return rows, lcp


@pytest.mark.parametrize("memory", [1 << 20, 1])
def test_collection(memory):
    for _ in range(25):
        letters = rng.choice([b"ab", b"abcd", b"\x00\xff z"])
        strings = [bytes(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 12))]
        depth = rng.choice([3, 10, 100])
        pos, lcp, starts = suffix.collection(strings, depth, block_rows=7, memory_rows=memory)
        owner = np.searchsorted(starts, pos, "right") - 1
        got = [strings[o][p - starts[o] :] for o, p in zip(owner, pos, strict=True)]
        rows, want = sorted_suffixes(strings)
        assert got == [r[0] for r in rows]
        assert lcp.tolist() == [min(depth, x) for x in want]


def test_mers_depend_on_their_units_only():
    a = np.array([rng.randrange(5) for _ in range(500)], np.uint8)
    for k in (1, 2, 3, 5, 8, 13):
        h = superwindows.mer_hashes(a, k)
        by = {}
        for i in range(len(a) - k + 1):
            assert by.setdefault(tuple(a[i : i + k].tolist()), h[i]) == h[i]
        assert len(set(by.values())) == len(by)


def test_runs_tile_all_windows_and_equal_windows_share_their_hash():
    a = np.array(([1, 2, 3, 4, 5, 6, 7, 8] * 20 + [rng.randrange(4) for _ in range(300)]) * 2, np.uint8)
    for slice_ in (50, 1 << 18):
        h, start, n, place = superwindows.runs(a, 20, 6, slice_)
        mers = superwindows.mer_hashes(a, 6)
        assert (mers[start + place].view(np.int64) == h).all()
        assert start[0] == 0 and (start[1:] == start[:-1] + n[:-1]).all() and n.sum() == len(a) - 19
        by = {}
        for x, s, k in zip(h, start, n, strict=True):
            for i in range(s, s + k):
                assert by.setdefault(a[i : i + 20].tobytes(), x) == x


def corpus(join=" "):
    vocabulary = [f"{rng.choice('abcdefgé')}{k}" for k in range(200)]
    w = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base = w(60), w(150)
    out = [(1, None), (2, ""), (3, "short one"), (4, "short one"), (5, "x" * 700), (6, "y " * 300), (7, " ".join(base)), (8, " ".join(base)), (8, " ".join(base)), (90, "\n".join(base[:80] + w(3) + base[83:]))]
    out += [(10 + k, " ".join(w(rng.randrange(40)) + passage[k % 5 :] + w(rng.randrange(40)))) for k in range(25)]
    out += [(40 + k, " ".join(w(rng.randrange(120)))) for k in range(10)] + [(None, " ".join(base[20:]))]
    out.append((95, join.join(w(9_000) + passage + passage)))
    return out


@pytest.mark.parametrize(("limit", "cut"), [(4_096, 65_536), (3, 65_536), (3, 2), (4_096, 2)])
def test_substring_equals_brute_force(spark, limit, cut, monkeypatch):
    monkeypatch.setattr(superwindows, "CUT", cut)
    rows = corpus("\t") + [(7, "another text with id seven")]
    monkeypatch.setattr(substring, "LIMIT", limit)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, hash int").repartition(3)
    units_rows, results = substring.repeated_words(docs, limit=limit)
    from pyspark.sql import functions as F

    got = units_rows.join(results.distinct(), ["h1", "h2"]).select("id", "n_words", "n_removed", F.sha2("kept", 256))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(substring.brute_force(rows), key=str)


@pytest.mark.parametrize(("limit", "cut"), [(4_096, 65_536), (3, 65_536), (3, 2), (4_096, 2)])
def test_suffix_equals_brute_force(spark, limit, cut, monkeypatch):
    monkeypatch.setattr(superwindows, "CUT", cut)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, first int").repartition(3)
    parts, results = suffix.repeated_bytes(docs, limit=limit, block_rows=500, memory_rows=2_000)
    from pyspark.sql import functions as F

    digests = results.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept").distinct()
    import hashlib

    got = suffix._per_row(parts, digests, "kept_sha256", F.lit(hashlib.sha256(b"").hexdigest()), 100)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(suffix.brute_force(rows), key=str)


def test_reports_and_empty_tables(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring.substring_report(docs).collect()), key=str) == sorted(substring.brute_force(rows), key=str)
    assert sorted(map(tuple, suffix.suffix_report(docs).collect()), key=str) == sorted(suffix.brute_force(rows), key=str)
    for f in (substring.substring_report, suffix.suffix_report):
        assert f(docs.limit(0)).count() == 0
    assert {r.kept for r in substring.remove_repeats(docs.filter("doc_id = 3")).collect()} == {"short one"}
    assert {bytes(r.kept) for r in suffix.remove_repeats(docs.filter("doc_id = 3")).collect()} == {b"short one"}


def test_a_full_collection_goes_through_files(monkeypatch):
    """At the defaults the collection of a bucket chunk of ordinary size is kept in files."""
    opened = []

    class Watched(suffix.Rows):
        def __init__(self, kinds, folder, name):
            opened.append(folder)
            super().__init__(kinds, folder, name)

    monkeypatch.setattr(suffix, "Rows", Watched)
    shared = bytes(rng.randrange(97, 123) for _ in range(150))
    strings = [bytes(rng.randrange(97, 123) for _ in range(10)) + shared[: 110 + k % 40] for k in range(2_200)]
    assert sum(map(len, strings)) < suffix.COLLECTION_BYTES
    pos, lcp, starts = suffix.collection(strings, 100)
    assert all(opened) and len(opened) == 2
    whole = b"".join(b"\0" + s for s in strings) + b"\0"
    at = rng.sample(range(1, len(pos)), 300)
    for k in at:
        a, b = (whole[p : whole.index(b"\0", p)] for p in (pos[k - 1], pos[k]))
        assert a <= b
        n = 0
        while n < min(len(a), len(b), 100) and a[n] == b[n]:
            n += 1
        assert lcp[k] == n


def test_hot_bucket_at_the_default_limits(spark):
    """5,000 documents share a passage: more strings under one minimiser than the limit."""
    words = [f"q{k}" for k in range(60)]
    rows = [(k, f"{k} a{k * 7} " + " ".join(words) + f" b{k * 3}") for k in range(5_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix.suffix_report(docs).collect())) == sorted(suffix.brute_force(rows))
    assert sorted(map(tuple, substring.substring_report(docs).collect())) == sorted(substring.brute_force(rows))
