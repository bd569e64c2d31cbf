from collections import Counter

from lodestrata.llm import language as L


def test_grams_equal_counter():
    text = "Abc  déF, abc1x"
    s = "_abc_déf_abc_x_"
    want = Counter(c for c in s if c != "_") + Counter(zip(s, s[1:], strict=False)) + Counter(zip(s, s[1:], s[2:], strict=False))
    code = lambda g: sum((1 if c == "_" else ord(c)) << 21 * k for k, c in enumerate(reversed(g)))
    grams, counts = L.gram_counts(text)
    assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == {code(g): n for g, n in want.items()}


def test_slices(monkeypatch):
    text = "the quick brown fox. jumped! over" * 50
    whole = L.gram_counts(text)
    monkeypatch.setattr(L, "SLICE", 7)
    cut = L.gram_counts(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_ranked_cut_equals_full_sort():
    grams, counts = L.gram_counts("some words are here and there and everywhere, in every order " * 9 + "xq zv kj wp")
    assert L.ranked(grams, counts, 5).tolist() == [g for g, _ in sorted(zip(grams.tolist(), counts.tolist(), strict=True), key=lambda x: (-x[1], x[0]))][:5]


def test_held_out_accuracy_and_cases(spark):
    en, fr = "the house and the garden with this that those ", "la maison et le jardin avec ces choses que nous "
    rows = [(k, (en if k % 2 else fr) * (1 + k % 5), "en" if k % 2 else "fr", 0.5) for k in range(200)]
    rows += [(900, None, "en", 0.5), (901, "", "en", None), (902, "123 !!", "fr", 1.0), (903, en, None, 1.0), (None, fr, "fr", 1.0), (1, en, "en", 1.0), (904, en * 20_000, "en", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = L.language_report(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert {by[k].lang_pred for k in (900, 901, 902)} == {"und"} and by[903].lang_pred == "en" and by[None].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(out) > 20 and all(r.lang_pred == ("en" if r.doc_id % 2 else "fr") for r in out)
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.language_report(docs).collect()] == [("und", 0.0)]
    assert L.language_report(docs.limit(0)).count() == 0


def brute(rows):
    """Profiles and distances by dictionaries."""
    import zlib

    def grams(text):
        out, word = Counter(), []
        for c in (text or "").lower() + " ":
            if c.isalpha():
                word.append(c)
            elif word:
                w = ["_", *word, "_"]
                out.update((c,) for c in word)
                for n in (2, 3):
                    out.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
                word = []
        return out

    code = lambda g: sum((1 if c == "_" else ord(c)) << 21 * k for k, c in enumerate(reversed(g)))

    def spread(text):
        plain = "".join(c if c.isalpha() else "_" for c in (text or "").lower())
        while "__" in plain:
            plain = plain.replace("__", "_")
        plain = "_" + plain.strip("_") + "_"
        if plain == "__":
            return Counter()
        return Counter((c,) for c in plain if c != "_") + Counter(zip(plain, plain[1:], strict=False)) + Counter(zip(plain, plain[1:], plain[2:], strict=False))

    rank = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))][: L.DEPTH]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0
    sums = {}
    for d, text, lang in rows:
        if d is not None and not out(d) and lang is not None:
            sums.setdefault(lang, Counter()).update(spread(text))
    profiles = {k: {g: r for r, g in enumerate(rank(c))} for k, c in sums.items() if c}
    found = []
    for d, text, _ in rows:
        own = rank(spread(text))
        if not own or not profiles:
            found.append((d, out(d), "und", 0.0))
            continue
        far = {k: sum(abs(p[g] - r) if g in p else L.DEPTH for r, g in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        found.append((d, out(d), best, round(1 - far[best] / (len(own) * L.DEPTH), 9)))
    return found


def test_whole_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()] + [(10**6, None, "en"), (10**6 + 1, "42", "fr"), (10**6 + 2, "été à la", None)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in L.language_report(table).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_ties_go_to_the_first_language(spark):
    rows = [(k, "same words here", "b" if k % 2 else "a") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.language_report(docs).collect()} == {"a"}
