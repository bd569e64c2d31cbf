import hashlib
import re

from lodestrata.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, A), (2, "short item here"), (2, "short item here"), (10, "SHORT item, here"), (3, None), (4, "..."), (None, "alpha beta")]
DOCS = [
    (1, f"Zz {A.upper()} end", "x"),
    (2, "nothing at all", "x"),
    (3, None, None),
    (4, "", "x"),
    (5, "A short-item; HERE alpha beta", "x"),
    (5, "five again", "x"),
    (6, "É two three four five six seven eight nine ten eleven twelve one two three", "x"),
    (7, "word " * 3000 + A, "x"),
    (None, A, "x"),
    (1, f"Zz {A.upper()} end", "x"),
]


def words(t):
    t = "" if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    return WORD.findall(t)


def brute(docs, items, n=10):
    grams = {}
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        for k in range(max(1, len(w) - n + 1)):
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t, _ in docs:
        w, hit, found = words(t), set(), set()
        for g, ids in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def frames(spark, docs=DOCS, items=ITEMS):
    return spark.createDataFrame(docs, "doc_id long, text string, gram string"), spark.createDataFrame(items, "item_id long, text string")


def test_report_equals_brute_force(spark):
    docs, items = frames(spark)
    assert sorted(map(tuple, D.contamination_report(docs, items).collect()), key=str) == brute(DOCS, ITEMS)


def test_without_broadcast(spark):
    docs, items = frames(spark)
    a = D.decontaminate(docs, items).select("id", "hits", "items")
    b = D.decontaminate(docs, items, broadcast_ngrams=0).select("id", "hits", "items")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert D.contamination_report(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in D.contamination_report(docs, items.limit(0)).collect()} == {0}


def test_removal(spark):
    docs, items = frames(spark)
    kept = {r.doc_id: r.text for r in D.remove_hits(docs.filter("doc_id in (1, 2, 5)"), items).collect()}
    assert kept[1] == "Zz end" and kept[2] == "nothing at all"
    left = sorted(r.text for r in D.drop_contaminated(docs, items).collect() if r.text)
    assert left == ["five again", "nothing at all"]
