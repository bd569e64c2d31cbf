"""Matching, grading, propagation and clustering of entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import MOST_BYTES, found
from . import vectors as V
from .retrieval import dot

CONFIRMED, POSSIBLE, MARGIN, CLUSTER = 0.52, 0.42, 0.03, 0.48


def best_matches(detections: DataFrame, references: DataFrame) -> DataFrame:
    """(det_id, person_id, best, margin): each person's best reference counts, and the margin is the
    best person's lead over the second. Balls of references that cannot hold one of the two are not
    looked at (``vectors.best_two``)."""
    return judged(V.best_two(*_sides(detections, references)))


def _sides(detections: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    d = unit_vectors(detections, "det_vector").select(F.col("det_id").alias("id"), F.col("det_vector").alias("v"))
    return d, unit_vectors(references, "ref_vector").select(F.col("person_id").alias("tag"), F.col("ref_vector").alias("v"))


def judged(two: DataFrame) -> DataFrame:
    """(det_id, person_id, best, margin) from the two best persons (id, tag, sim) of each face."""
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "tag")
    ranked = two.select("id", "tag", "sim", F.lead("sim").over(order).alias("second"), F.row_number().over(order).alias("r"))
    return ranked.filter("r = 1").select(F.col("id").alias("det_id"), F.col("tag").alias("person_id"), F.col("sim").alias("best"), F.when(F.coalesce("second", F.lit(-1.0)) < 0, 1.0).otherwise(F.col("sim") - F.col("second")).alias("margin"))


def unit_vectors(rows: DataFrame, name: str) -> DataFrame:
    """``name`` scaled to length 1; vectors shorter than 1e-6 (and null ones) have no direction and go."""
    norm = F.sqrt(dot(F.col(name), F.col(name)))
    # the norm is bound by a lambda, as a column of its own would be put in again for each component;
    # filters may be put together and see rows that go
    scaled = F.transform(F.array(norm), lambda n: F.transform(F.col(name).cast("array<double>"), lambda x: F.try_divide(x, n)))
    return rows.filter(norm >= 1e-6).withColumn(name, F.element_at(scaled, 1))


def graded(best: Column, margin: Column, confirmed: float = CONFIRMED, possible: float = POSSIBLE, lead: float = MARGIN) -> Column:
    return F.when((best >= confirmed) & (margin >= lead), "CONFIRMED").when(best >= possible, "POSSIBLE").otherwise("UNKNOWN")


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a < b and inner product of at least ``threshold`` of ``vectors`` (id, v), without comparing all pairs."""
    return V.similar_pairs(vectors, threshold)


def similar_links(vectors: DataFrame, threshold: float) -> DataFrame:
    """Of ``similar_pairs`` enough to link the same rows (``vectors.similar_links``): their components are the same."""
    return V.similar_links(vectors, threshold)


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component): smallest reachable node, by large-star and small-star steps in turn until no
    edge moves; checkpointed each round. Rounds grow with the logarithm of a path's length; it raises,
    and returns nothing unfinished, if ``rounds`` are not enough."""
    # a node whose only edge leads to itself is its own component
    alone = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    stars = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct().checkpoint()
    state = _state(stars)
    for _ in range(rounds):
        both = stars.union(stars.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u")
        large = both.join(low, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        stars = small.filter("a <> b").distinct().checkpoint()
        before, state = state, _state(stars)
        if before == state:
            break
    else:
        raise RuntimeError(f"components: edges still move after {rounds} rounds")
    found = stars.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return alone.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def propagate(detections: DataFrame, references: DataFrame, confirmed: float, lead: float, rounds: int | None = None) -> DataFrame:
    """(det_id, person_id): confirmed detections become references until none is new. All of a round
    are judged against the same references, so the result has no order to depend on. A round compares the
    faces that are still open with those that the round before has confirmed, and nothing else: of all
    earlier references the two best persons of each face are kept, which is all that a later judgement can
    need (a person below them counts again only with a new reference). Every round but the last takes
    detections away, so it ends; with ``rounds`` it raises where these are not enough."""
    open_, known = _sides(detections, references)
    open_ = open_.checkpoint()
    state, found, done = V.best_two(open_, known).checkpoint(), [], 0
    while True:
        m = judged(state)
        new = m.filter((F.col("best") >= confirmed) & (F.col("margin") >= lead)).select("det_id", "person_id").checkpoint()
        if new.isEmpty():
            break
        if rounds is not None and done >= rounds:
            raise RuntimeError(f"propagate: detections are still confirmed after {rounds} rounds")
        done += 1
        # all that is carried on is checkpointed, so that a long chain of rounds does not grow the plan
        found.append(new)
        ids = new.withColumnRenamed("det_id", "id")
        fresh = open_.join(ids, "id").select(F.col("person_id").alias("tag"), "v")
        open_ = open_.join(ids, "id", "left_anti").checkpoint()
        state = V.two_best(state.join(ids, "id", "left_anti").unionByName(V.best_two(open_, fresh))).checkpoint()
    return reduce(DataFrame.unionByName, found, m.filter(F.lit(False)).select("det_id", "person_id"))


def best_per_person(faces: DataFrame) -> DataFrame:
    """(person_id, det_id) of the best face by quality, then confidence, then id."""
    order = Window.partitionBy("person_id").orderBy(F.desc("quality"), F.desc("confidence"), "det_id")
    return faces.withColumn("r", F.row_number().over(order)).filter("r = 1").select("person_id", "det_id")


def merge_links(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """On conflict the larger confidence and confirmation stay."""
    return old.unionByName(new).groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.max("is_confirmed").alias("is_confirmed"))


def merge_person(links: DataFrame, source: int, target: int, keys: list[str]) -> DataFrame:
    """All links of ``source`` go over to ``target``."""
    moved = links.withColumn("person_id", F.when(F.col("person_id") == source, F.lit(target).cast(links.schema["person_id"].dataType)).otherwise(F.col("person_id")))
    return moved.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.max("is_confirmed").alias("is_confirmed"))


def merge_names(persons: DataFrame) -> DataFrame:
    """(person_id, kept_id): of equal names (trimmed, case aside) the smallest id is kept."""
    order = Window.partitionBy(F.lower(F.trim("name")))
    return persons.select("person_id", F.min("person_id").over(order).alias("kept_id"))


def text_mentions(persons: DataFrame, files: DataFrame, shortest: int = 3, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(person_id, file_id): a person's whole name, or one of ``aliases`` (if there is that column), as
    successive words of a file's name and text. Names under ``shortest`` characters are not searched. All
    names are found in one pass over the texts, as long as they have ``most_bytes`` at most (counted first);
    beyond, names and texts are joined on the word of a name that the fewest files have, and names of more
    words are then held against the files that have it."""
    from ..functions.text import tokens

    text = F.concat_ws(" ", *[c for c in ("filename", "extracted_text") if c in files.columns])
    padded = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    every = F.array(F.col("name"))
    if "aliases" in persons.columns:
        every = F.concat(every, F.coalesce(F.col("aliases"), F.array().cast("array<string>")))
    names = persons.select("person_id", F.explode(every).alias("name")).filter(F.length(F.trim("name")) >= shortest)
    names = names.select("person_id", tokens(F.col("name")).alias("parts")).filter(F.size("parts") > 0).distinct()
    phrases = names.select(padded(F.col("parts")).alias("phrase")).distinct()
    if (phrases.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0) <= most_bytes:
        known = sorted(r["phrase"] for r in phrases.collect())  # within the bound
        numbered = names.join(phrases.sparkSession.createDataFrame(list(enumerate(known)), "n int, phrase string"), padded(F.col("parts")) == F.col("phrase"))
        met = files.select("file_id", F.explode(found(padded(tokens(text)), known)).alias("n"))
        return met.join(numbered, "n").select("person_id", "file_id").distinct()
    words = files.select("file_id", F.explode(F.array_distinct(tokens(text))).alias("word"))
    parts = names.select(F.explode("parts").alias("word")).distinct()
    spread = words.join(parts, "word").groupBy("word").agg(F.count("*").alias("n"))
    each = names.select("person_id", "parts", F.explode(F.array_distinct("parts")).alias("word")).join(spread, "word", "left")
    rarest = each.groupBy("person_id", "parts").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("rare"))
    met = words.join(rarest.select("person_id", "parts", F.col("rare.word").alias("word")), "word").select("person_id", "file_id", "parts")
    whole = met.filter(F.size("parts") == 1).select("person_id", "file_id")
    longer = met.filter(F.size("parts") > 1).join(files.select("file_id", padded(tokens(text)).alias("text")), "file_id")
    return whole.union(longer.filter(F.contains("text", padded(F.col("parts")))).select("person_id", "file_id")).distinct()


def suppress_overlaps(boxes: DataFrame, iou: float = 0.35, ios: float = 0.50) -> DataFrame:
    """Greedy non-maximum suppression within each image: (image_id, det_id) that stay. Sequential by
    nature, so an image's boxes (few) go to one Pandas call; a step takes the best box that is left and
    drops all that it overlaps at once, so there are as many steps as boxes that stay. A box without area,
    or of unknown place, overlaps nothing."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["confidence", "det_id"], ascending=[False, True])
        x, y, w, h = (pdf[c].to_numpy(np.float64) for c in ("x", "y", "w", "h"))
        right, below, area = x + w, y + h, w * h
        left, kept = np.arange(len(pdf)), []
        while len(left):
            k, left = left[0], left[1:]
            kept.append(k)
            wide = np.minimum(right[left], right[k]) - np.maximum(x[left], x[k])
            high = np.minimum(below[left], below[k]) - np.maximum(y[left], y[k])
            inner = np.maximum(0.0, wide) * np.maximum(0.0, high)
            least = np.minimum(area[left], area[k])
            over = (inner >= iou * (area[left] + area[k] - inner)) | (inner >= ios * least)
            left = left[~(over & (least > 0))]
        return pdf.iloc[kept][["image_id", "det_id"]]

    return boxes.groupBy("image_id").applyInPandas(run, "image_id long, det_id long")
