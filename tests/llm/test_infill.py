import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import infill as I

TEXTS = [None, "", "a", "ab", "a <P> b", "x<S>", "<M>", "<", "<P", "P>tail", "S>a<", "😀" * 50 + "é́\x00\n", "wort " * 400, "wort " * 400, "퟿", "a" * 300_000]


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    if h4 % 100 < 20:
        form, out = "spm", f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    else:
        form, out = "psm", f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    return doc_id, n, form, a, b - a, sha(out), sha(text)


def test_whole_query(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS * 8)] + [(None, "no id"), (5, "same id"), (1 << 62, "large id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs = docs.selectExpr("*", "'x' AS form", "1 AS n", "2 AS output", "3 AS rebuilt")  # clashing names
    found = sorted(map(tuple, I.infill_report(docs).collect()), key=str)
    assert found == sorted((brute(*r) for r in rows), key=str)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    assert I.infill_report(docs.limit(0)).count() == 0


def test_outputs_stay_and_go_back(spark):
    docs = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(TEXTS)], "doc_id long, text string, fim string")
    cut = I.fill_in_middle(docs, into="cut")
    assert cut.columns == ["doc_id", "text", "fim", "cut"]
    back = I.rebuilt(cut.select("doc_id", "text", "cut.*"))
    assert all((r["text"] or "") == r["rebuilt"]["text"] for r in back.collect())
    assert I.fill_in_middle(docs).select("fim.form").count() == len(TEXTS)


@given(st.text(alphabet="<>PSMab\n", max_size=40), st.integers(0, 10_000))
@settings(max_examples=300, deadline=None)
def test_every_text_comes_back(text, doc_id):
    how = I.Infill(of_100=100)
    n, form, head, gap, output = how.cut(str(doc_id), text)
    assert how.rebuild(output, form) == text and n == len(text)
    assert form == I.PLAIN or len(output) == len(text) + 9


@pytest.mark.parametrize("unit", [r"\w+|\s+", r"[^\n]*\n|[^\n]+", r"\X", r"x+"])
def test_other_units_lose_nothing(unit):
    how = I.Infill(of_100=100, unit=unit)
    for k, text in enumerate(t for t in TEXTS if t and len(t) < 5000):
        n, form, head, gap, output = how.cut(str(k), text)
        assert how.rebuild(output, form) == text
        ends = {0, *how.ends(text)}
        assert form == I.PLAIN or {head, head + gap} <= ends


def test_bad_parameters_and_outputs_raise():
    for wrong in ({"unit": r"a*"}, {"prefix": ""}, {"prefix": "<S>x", "suffix": "<S>"}, {"prefix": "<P", "suffix": "P<"}):
        with pytest.raises(ValueError):
            I.Infill(**wrong)
    with pytest.raises(ValueError):
        I.Infill().rebuild("<P>a<M>b", I.PSM)
