"""Language identification by rank-order n-gram profiles.

Every labelled text adds its n-gram counts (one to three letters, runs of anything else count as
one border sign) to its language's totals; the ``depth`` most frequent n-grams of a language, in
order, are its profile. A text's own most frequent n-grams are ranked alike, and the language with
the least mean out-of-place distance is predicted. Counts come from all learned documents over
whole texts; only the profiles (``depth`` rows a language) reach the driver.

Defined results: null texts and texts without a letter are ``und`` with score 0; the same holds for
all texts if nothing could be learned. Rows with a null label, or with a null id in ``op9``, are
not learned from. Ties go to the smaller n-gram and to the smaller language name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTH = 400
BORDER, SHIFT, SLICE = 1, np.int64(21), 1 << 20
FOLDS = 5
#: Profiles go to every task; there are a few hundred written languages.
MOST_LANGUAGES = 5_000
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)
    return _letters


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of a text as packed code points, and their counts; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.where(letter, points, BORDER).astype(np.int64)
    codes = codes[letter | np.r_[True, letter[:-1]]]
    codes = np.concatenate([[BORDER] * int(codes[0] != BORDER), codes, [BORDER] * int(codes[-1] != BORDER)]).astype(np.int64)
    found = []
    for at in range(0, len(codes), SLICE):
        part = codes[at : at + SLICE + 2]
        one = part[:SLICE]
        two = (part[:-1] << SHIFT | part[1:])[:SLICE]
        three = (part[:-2] << SHIFT * 2 | part[1:-1] << SHIFT | part[2:])[:SLICE]
        found.append(np.unique(np.concatenate([one[one != BORDER], two, three]), return_counts=True))
    return found[0] if len(found) == 1 else _merged(found)


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, where = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    return grams, np.bincount(where, np.concatenate([n for _, n in found]), len(grams)).astype(np.int64)


def ranked(grams: np.ndarray, counts: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    if len(grams) > 4 * depth:  # only what can reach the first ranks is sorted
        least = np.partition(counts, len(counts) - depth)[len(counts) - depth]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:depth]


def learn(labelled: DataFrame, depth: int = DEPTH) -> dict[str, list[int]]:
    """Profiles from ``labelled(lang, text)``: n-grams by falling count over all its rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams, counts = gram_counts(text.as_py())
                held.setdefault(lang, []).append((grams, counts))
                size += len(grams)
                if size > 1 << 21:
                    held = {k: [_merged(v)] for k, v in held.items()}
                    size = sum(len(v[0][0]) for v in held.values())
                    if size > 1 << 20:  # partial sums go on to the shuffle
                        yield from _rows(held)
                        held, size = {}, 0
        yield from _rows(held)

    sums = labelled.filter("lang is not null and text is not null").select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    sums = sums.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)
    most = MOST_LANGUAGES * depth
    rows = top.orderBy("lang", "rank").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"learn: more values of lang than a profile table for every task holds ({MOST_LANGUAGES})")
    profiles: dict[str, list[int]] = {}
    for r in rows:
        profiles.setdefault(r.lang, []).append(r.gram)
    return profiles


def _rows(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
    for lang, found in held.items():
        grams, counts = _merged(found)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])


class Profiles:
    """Look-up form of the profiles: for every known n-gram its rank in each language."""

    def __init__(self, profiles: dict[str, list[int]], depth: int = DEPTH):
        self.langs, self.depth = sorted(profiles), depth
        self.grams = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        self.ranks = np.full((len(self.grams), len(self.langs)), -1, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ranked(*gram_counts(text), self.depth) if text else ()
        if not len(grams) or not len(self.langs):
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        own = np.arange(len(grams), dtype=np.int32)[:, None]
        known = (self.grams[at] == grams)[:, None] & (self.ranks[at] >= 0)
        far = np.where(known, np.abs(self.ranks[at] - own), self.depth).sum(axis=0)
        best = int(np.argmin(far))
        return self.langs[best], 1.0 - float(far[best]) / (len(grams) * self.depth)


def predict(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """``docs`` with lang_pred and score added; a column of that name is replaced."""
    own = docs.drop("lang_pred", "score")
    schema = own.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    at = own.columns.index(text_col)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, depth)
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column(at)]
            extra = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], schema.names)

    return own.mapInArrow(label, schema)


def held_out(id_col: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def learn_from_folds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", depth: int = DEPTH) -> dict[str, list[int]]:
    known = docs.filter(~held_out(F.col(id_col)) & F.col(id_col).isNotNull())
    return learn(known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), depth)


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The digest of ``op9``: learn from four folds of five, predict all rows."""
    profiles = learn_from_folds(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.select("id", "text", held_out(F.col("id")).alias("held_out"))
    # the text stays behind in Python's memory: only the labels come back
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double"

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles)
        for batch in batches:
            got = [model.predict(x.as_py()) for x in batch.column(1)]
            extra = [pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *extra], ["id", "held_out", "lang_pred", "score"])

    return found.mapInArrow(label, schema).withColumnRenamed("id", id_col)


def least_score(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS) -> float:
    """Half of the score that 99 of 100 rightly predicted documents of the held-out fold reach; 0 without any."""
    rows = docs.filter(held_out(F.col(id_col), folds) & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    point = predict(rows, profiles).filter("lang_pred = lang").agg(F.percentile_approx("score", 0.01, 10_000)).first()[0]
    return point / 2 if point is not None else 0.0


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Documents with a recognised language, columns unchanged. ``und`` documents go, and those whose
    score is 0 or below ``least_score``: no profile resembles them (another script, random letters)."""
    profiles = learn_from_folds(docs, id_col, text_col, lang_col)
    bound = least_score(docs, profiles, id_col, text_col, lang_col)
    known = predict(docs, profiles, text_col).filter((F.col("lang_pred") != "und") & (F.col("score") > 0) & (F.col("score") >= bound))
    return known.select(*docs.columns)
