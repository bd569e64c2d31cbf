import random

from lodestrata.llm import lines as L

rng = random.Random(4)
VOCABULARY = [f"v{k}" for k in range(120)]


def corpus():
    w = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    pool = [" ".join(w(rng.randrange(1, 25))) for _ in range(40)]
    docs = [(1, None), (2, ""), (3, "\n\n"), (4, pool[0]), (4, "other " + pool[1]), (5, pool[0]), (5, pool[0])]
    for k in range(10, 70):
        out = []
        for _ in range(rng.randrange(1, 7)):
            line = rng.choice(pool).split()
            for _ in range(rng.randrange(4)):
                line[rng.randrange(len(line))] = rng.choice(VOCABULARY)
            out.append("  ".join(line))
        docs.append((k, "\n".join(out)))
    return docs + [(None, pool[3] + "\n" + pool[0]), (99, "\n".join(["a b c d e"] * 3000))]


def key_of(spark, texts):
    from pyspark.sql import functions as F

    return {r.t: r.k for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("k")).collect()}


def brute(spark, docs):
    keys = key_of(spark, {t or "" for _, t in docs})
    every = sorted(((d is not None, d, keys[t or ""], n, frozenset(x.split())) for d, t in {(d, t or "") for d, t in docs} for n, x in enumerate(t.split("\n"))), key=lambda r: r[:4] if r[0] else (False, 0, *r[2:4]))
    gone, seen = {}, {}
    for _, d, k, n, s in every:
        if s and (s in seen or any(len(s & e) * 5 >= 4 * len(s | e) for e in seen)):
            gone.setdefault((d, k), []).append(n)
        if s:
            seen.setdefault(s, 1)
    return {(d, len((t or "").split("\n")), ",".join(map(str, gone.get((d, keys[t or ""]), [])))) for d, t in docs}


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, k int")
    got = {(r.doc_id, r.n_lines, r.removed_lines) for r in L.line_report(docs).collect()}
    assert got == brute(spark, rows)
    texts = {r.doc_id: r.text for r in L.remove_lines(docs).collect() if r.doc_id not in (4, None)}
    assert texts[99] == "a b c d e" and texts[1] is None and texts[3] == "\n\n" and texts[5] == ""


def test_empty(spark):
    assert L.line_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def near_copies(n):
    """One line for each document: a stem of 50 words with five of them, in some three, replaced."""
    own, stem = random.Random(9), [f"stem{k}" for k in range(50)]
    docs = []
    for k in range(n):
        line = list(stem)
        for at in own.sample(range(50), 5 if k % 4 else 3):
            line[at] = f"other{own.randrange(30)}"
        docs.append((k, " ".join(line)))
    return docs


def test_near_copies_that_no_pilot_settles_make_few_pairs(spark, monkeypatch):
    n, made, judge, keep = 600, [], L.verified, L.persist_table

    def judged(pairs, held):
        made.append(("pairs", pairs.count()))
        return judge(pairs, held)

    def kept(df, name):
        out = keep(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(L, "verified", judged)
    monkeypatch.setattr(L, "persist_table", kept)
    rows = near_copies(n)
    got = {(r.doc_id, r.n_lines, r.removed_lines) for r in L.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(spark, rows)
    assert n / 10 < sum(r[2] == "0" for r in got) < n
    assert max(made, key=lambda m: m[1])[1] < 15 * n, made


def test_parity_bounds_the_difference(spark):
    from pyspark.sql import functions as F

    own = random.Random(3)
    rows = []
    for n in (5, 40, 64, 65, 70, 200):
        line = [f"w{own.randrange(10**6)}" for _ in range(n)]
        rows += [(" ".join(line + [f"x{own.randrange(10**6)}" for _ in range(m)]),) for m in (0, 1, n // 5, n)]
    docs = spark.createDataFrame([(k, t) for k, (t,) in enumerate(rows)], "doc_id long, text string")
    marked = L.marked_lines(L.keyed_lines(docs, "doc_id", "text"), L.rarity_sketch(docs, "text").scalar()).select("id", *L.SHAPE)
    a, b = marked.alias("a"), marked.alias("b")
    one, two = ({c: F.col(f"{x}.{c}") for c in marked.columns} for x in "ab")
    held = [set(t.split()) for (t,) in rows]
    for r in a.crossJoin(b).select(one["id"].alias("i"), two["id"].alias("j"), L.apart(one, two).alias("d"), L.may_match(one, two).alias("may")).collect():
        assert r.d <= len(held[r.i] ^ held[r.j])
        assert r.may or 5 * len(held[r.i] & held[r.j]) < 4 * len(held[r.i] | held[r.j])


def test_shares_cover_all_once():
    for n in (0, 1, 16, 17, 5000, 10**7):
        parts = L.shares(n)
        assert parts[0][0] == 0 and parts[-1][1] == 1 and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
        assert parts[0][1] * n <= L.GROWTH
