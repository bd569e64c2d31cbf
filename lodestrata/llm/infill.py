"""Fill-in-middle transformation of texts, and the way back.

A text is cut at the ends of two of its units (code points, unless another pattern is given) into
prefix, middle and suffix, which are put in another order between sentinels, so that a model of the
usual left-to-right kind learns to fill a gap. Form and cuts follow from a SHA-256 of the document's
id alone, so every run, partitioning and retry gives the same output.

An Arrow-batched pandas UDF does the work: the ``regex`` library's ``finditer`` walks over a whole
text and only the ends of the matches are kept, four bytes each, in one array; two look-ups in it
slice the text. Nothing is shuffled and rows do not depend on each other: a lost executor costs the
tasks it ran. Of a batch of rows (``spark.sql.execution.arrow.maxRecordsPerBatch``) a task holds the
texts and the outputs, and the ends of one text.

Defined results: a null text is empty; an empty text, and one that has a sentinel in it, stays as it
is (``plain``), so every output can be taken apart again; a null id counts as an empty one; rows that
share an id are cut by the same seeds; a column named as the result is replaced; an empty table gives
no rows. What a pattern leaves out between units stays with the unit that follows, and what it leaves
out at the end with the suffix, so nothing is lost.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODE_POINTS = r"(?s:.)"
PLAIN, PSM, SPM = "plain", "psm", "spm"
CUT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"
REBUILT = "text string, sha256 string"


@dataclass(frozen=True)
class Infill:
    """How texts are cut: the share of ``of_100`` texts that are, ``spm_of_100`` of these with the suffix
    first, the sentinels, the pattern of a unit, and the salt of the seeds."""

    of_100: int = 90
    spm_of_100: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = CODE_POINTS
    salt: str = "1:"

    def __post_init__(self) -> None:
        if regex.match(self.unit, ""):
            raise ValueError("a unit must not be empty")
        marks = self.marks
        for a in marks:
            for b in marks:
                # with these no sentinel can begin in one piece and end in the next
                if not a or (a is not b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                    raise ValueError("sentinels must not overlap or contain each other")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def seeds(self, doc_id: str) -> list[int]:
        digest = sha256(f"{self.salt}{doc_id}".encode()).hexdigest()
        return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]

    def ends(self, text: str) -> array:
        """The end of every unit, left to right. A task has one thread, so the matcher keeps its lock."""
        found = regex.compile(self.unit).finditer(text, concurrent=False)
        return array("I", map(regex.Match.end, found))

    def cut(self, doc_id: str, text: str) -> tuple[int, str, int | None, int | None, str]:
        """(units, form, code points of the prefix and of the middle, output)."""
        ends = self.ends(text)
        n = len(ends)
        h1, h2, h3, h4 = self.seeds(doc_id)
        if not text or h3 % 100 >= self.of_100 or any(m in text for m in self.marks):
            return n, PLAIN, None, None, text
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (ends[k - 1] if k else 0 for k in (first, second))
        head, gap, tail = text[:a], text[a:b], text[b:]
        if h4 % 100 < self.spm_of_100:
            return n, SPM, a, b - a, f"{self.suffix}{tail}{self.prefix}{head}{self.middle}{gap}"
        return n, PSM, a, b - a, f"{self.prefix}{head}{self.suffix}{tail}{self.middle}{gap}"

    def rebuild(self, output: str, form: str) -> str:
        """The text that ``cut`` took apart, from its output and form alone."""
        if form == PLAIN:
            return output
        first, second = (self.suffix, self.prefix) if form == SPM else (self.prefix, self.suffix)
        left, mid, rest = output.partition(second)
        right, end, gap = rest.partition(self.middle)
        if not left.startswith(first) or not mid or not end:
            raise ValueError(f"not an output of the form {form}: {output[:60]!r}")
        head, tail = left[len(first) :], right
        return tail + gap + head if form == SPM else head + gap + tail


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Infill = Infill(), into: str = "fim") -> DataFrame:
    """``docs`` with ``into``, a struct of CUT: the units of the text, its form, the code points of prefix
    and middle (null if plain), the output and its SHA-256."""

    @F.pandas_udf(CUT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows = [how.cut(i or "", t or "") for i, t in zip(ids, texts, strict=True)]
            found = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield found.astype({"prefix_chars": "Int64", "middle_chars": "Int64"}).assign(output_sha256=[_digest(r[-1]) for r in rows])

    return docs.withColumn(into, run(F.col(id_col).cast("string"), F.col(text_col)))


def rebuilt(rows: DataFrame, output: str = "output", form: str = "form", how: Infill = Infill(), into: str = "rebuilt") -> DataFrame:
    """``rows`` with ``into``, a struct of REBUILT: the text before the transformation and its SHA-256. A
    null output is empty, a null form plain; what no transformation can have made raises."""

    @F.pandas_udf(REBUILT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for outputs, forms in batches:
            texts = [how.rebuild(o or "", f or PLAIN) for o, f in zip(outputs, forms, strict=True)]
            yield pd.DataFrame({"text": texts, "sha256": [_digest(t) for t in texts]})

    return rows.withColumn(into, run(F.col(output), F.col(form)))


def infill_report(docs: DataFrame, how: Infill = Infill()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row."""
    cut = fill_in_middle(docs.select("doc_id", "text"), how=how).select("doc_id", "fim.*")
    return rebuilt(cut, how=how).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.col("rebuilt.sha256").alias("restored_sha256"))
