"""Search end to end: from a sentence to ranked, masked rows, as one lazy plan.

    sentence -> Plan -> branches (persons, images, concepts, full text, expansions, dense vectors)
             -> union by file -> file rows -> roles, dates, categories -> fusion -> hiding, masking -> top k

The sentence decides on the driver which branches are built at all; everything else is DataFrame
operators, so filters reach the scans and the branches share them. The weights of the branches follow
the sentence's intent. Branches return at most their own limits (45 by text, 25 images, 50 concepts, 20 for
each expansion), which are parameters of ``Limits``; they are top-k operators over all rows that can be in
the result: what the sentence and the options rule out (extension, size, formats, category, hidden rows,
files that are gone) is ruled out below every limit, so a limit never leaves a narrow search without rows.

Text and all expansions are scored together: with an index (``operators.postings``) from its blocks, else in
two scans of the files (statistics, then scores), however many expansions there are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import snippet
from ..operators import catalogue as C
from ..operators import governance as G
from ..operators import people as P
from ..operators import retrieval as R
from ..operators import understanding as U
from ..operators.postings import TextIndex
from .planner import Plan, parse

#: Score from which a result is shown.
LEAST = 0.05
#: Digits of a score that count for the order.
DIGITS = 5
KINDS = ("lexical", "ocr", "dense", "image", "person")


@dataclass(frozen=True)
class Limits:
    text: int = 45
    expansion: int = 20
    expansions: int = 5
    images: int = 25
    concepts: int = 50
    dense: int = 45
    dense_least: float = 0.25
    image_least: float = 0.18
    #: Only the newest images are looked at (all of them if null).
    image_pool: int | None = None


@dataclass(frozen=True)
class Library:
    """What is searched. ``files`` has file_id, path, filename, extension, size_bytes, modified_at,
    extracted_text, privacy_state and may have capture_date, ocr_text, category_v4, document_type, file_type;
    ``text_vectors`` and ``image_vectors`` have file_id and vector; ``understanding`` as in ``operators.understanding``."""

    files: DataFrame
    understanding: DataFrame | None = None
    text_vectors: DataFrame | None = None
    image_vectors: DataFrame | None = None
    people: P.People | None = None
    #: Over ``contents(files)``; without one the texts are scanned.
    index: TextIndex | None = None
    #: (file_id) of the files that are still there; all, if not given.
    existing: DataFrame | None = None


@dataclass(frozen=True)
class Options:
    now: date
    category: str | None = None
    formats: tuple[str, ...] = ()
    sort_by: str = "relevance"
    limit: int = 45
    authenticated: bool = False
    protected: str = "mask"
    hide_names: bool = True
    compat_norm: bool = False
    #: Branches that are left out, for ablations: of persons, images, concepts, text, expansions, dense, filename, roles.
    without: frozenset[str] = frozenset()
    limits: Limits = field(default_factory=Limits)


def known_names(people: P.People | None, text: str) -> dict[str, str]:
    """Names and aliases that stand in a sentence, to the person's name. The join is of the sentence's
    few word runs with all names; only what matches comes to the driver."""
    if people is None:
        return {}
    words = text.lower().replace("'s", "").split()
    runs = [" ".join(words[a:b]) for a in range(len(words)) for b in range(a + 1, min(len(words), a + 4) + 1)]
    if not runs:
        return {}
    spark = people.persons.sparkSession
    found = P.find_persons(people, spark.createDataFrame([(r,) for r in runs], "wanted string"))
    named = found.join(people.persons.filter(~F.col("is_cluster")).select("person_id", "name"), "person_id")
    return {r.wanted: r["name"] for r in named.collect()}


def contents(files: DataFrame) -> DataFrame:
    """(file_id, content): what full-text search reads of a file, as an index of it must hold."""
    parts = ["filename", "extracted_text", *(["ocr_text"] if "ocr_text" in files.columns else [])]
    return files.select("file_id", F.concat_ws("\n", *parts).alias("content"))


def admitted(lib: Library, plan: Plan, o: Options) -> DataFrame:
    """The files that may be in the result: every filter of the sentence and of the options, before any limit."""
    rows = G.visible(lib.files, o.authenticated, o.protected)
    if plan.extension:
        rows = rows.filter(F.lower("path").endswith("." + plan.extension))
    if plan.size:
        rows = rows.filter(F.col("size_bytes") > plan.size[1] if plan.size[0] == "gt" else F.col("size_bytes") < plan.size[1])
    if o.category and o.category.strip().upper() != "ALL":
        rows = rows.filter(user_category(o.category, rows.columns))
    if o.formats:
        wanted = [f.lower().lstrip(".") for f in o.formats]
        rows = rows.filter(F.regexp_replace(F.lower("extension"), r"^\.+", "").isin(wanted))
    return rows if lib.existing is None else rows.join(lib.existing.select("file_id"), "file_id", "left_semi")


def text_hits(lib: Library, rows: DataFrame, queries: list[tuple[str, int]], narrowed: str | None) -> DataFrame | None:
    """(file_id, asked, bm25): the best full-text hits among ``rows`` of each (text, limit), ``asked`` its place in
    the list; null without words. Statistics are those of all files."""
    asked = [(k, *R.query_terms(text), limit) for k, (text, limit) in enumerate(queries)]
    asked = [x for x in asked if x[1] or x[2]]
    if not asked:
        return None
    kept = rows.filter(C.in_category(F.col("extension"), narrowed)) if narrowed else rows
    if lib.index is not None:
        found = [lib.index.search(whole, prefixes, limit, keep=kept.select("file_id")).select(F.col("id").alias("file_id"), F.lit(k).alias("asked"), F.col("score").alias("bm25")) for k, whole, prefixes, limit in asked]
        return reduce(DataFrame.unionByName, found)
    scores = R.bm25_each(contents(lib.files), "file_id", "content", [(whole, prefixes) for _, whole, prefixes, _ in asked]).withColumnRenamed("id", "file_id")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "file_id"))
    limits = F.element_at(F.array(*[F.lit(x[3]) for x in asked]), F.col("query") + 1)
    places = F.element_at(F.array(*[F.lit(x[0]) for x in asked]), F.col("query") + 1)
    ranked = scores.join(kept.select("file_id"), "file_id", "left_semi").withColumn("_r", best)
    most = max(x[3] for x in asked)
    return ranked.filter((F.col("_r") <= most) & (F.col("_r") <= limits)).select("file_id", places.alias("asked"), F.col("score").alias("bm25"))


def branches(lib: Library, rows: DataFrame, plan: Plan, o: Options, text_query: list[float] | None, image_query: list[float] | None) -> list[DataFrame]:
    """(file_id and some of KINDS, reason) of every branch that the plan asks for, among ``rows`` of the files."""
    out: list[DataFrame] = []
    say = lambda df, reason: df.withColumn("reason", reason if isinstance(reason, Column) else F.lit(reason))
    ids = rows.select("file_id")
    ocr = F.col("ocr_text").isNotNull() & (F.col("ocr_text") != "") if "ocr_text" in rows.columns else F.lit(False)
    if "persons" not in o.without and plan.persons and lib.people is not None:
        wanted = lib.people.persons.sparkSession.createDataFrame([(p,) for p in plan.persons], "wanted string")
        who = P.find_persons(lib.people, wanted).select("person_id", "wanted")  # the sentence's few persons
        hits = lib.people.links.join(F.broadcast(who), "person_id").join(ids, "file_id", "left_semi")
        out.append(say(hits.groupBy("file_id", "wanted").agg(F.max("confidence").alias("person")), F.concat(F.lit("Person match: "), "wanted")))
    if o.category:
        look = o.category.strip().upper() == "IMAGE"
    else:
        look = "image" in plan.file_types if plan.file_types else (plan.visual or not plan.academic)
    if "images" not in o.without and look and lib.image_vectors is not None and image_query is not None:
        images = rows.filter(C.in_category(F.col("extension"), "image"))
        if o.limits.image_pool:
            images = images.orderBy(F.desc("modified_at"), "file_id").limit(o.limits.image_pool)
        pool = lib.image_vectors.join(images.select("file_id"), "file_id", "left_semi")
        found = R.knn(pool, image_query, o.limits.images, "file_id", "vector", o.limits.image_least)
        out.append(say(found.select(F.col("id").alias("file_id"), R.image_norm(F.col("score")).alias("image")), "Visual match"))
    if "concepts" not in o.without and lib.understanding is not None:
        known = lib.understanding.join(ids, "file_id", "left_semi")
        out.append(U.concept_hits(known, plan.text, o.limits.concepts).select("file_id", F.lit(None).cast("string").alias("reason")))
    asked = [(plan.text, o.limits.text)] if "text" not in o.without else [("", 0)]
    if "expansions" not in o.without:
        asked += [(term, o.limits.expansion) for term in plan.expansions[: o.limits.expansions]]
    hits = text_hits(lib, rows, asked, o.category or plan.target)
    if hits is not None:
        reasons = F.element_at(F.array(F.lit("Lexical FTS match"), *[F.lit(f"Matched term '{t}'") for t, _ in asked[1:]]), F.col("asked") + 1)
        credit = F.when(F.col("asked") == 0, R.bm25_norm(F.col("bm25"), o.compat_norm)).otherwise(0.7)
        read = hits.join(rows.select("file_id", ocr.alias("_ocr")), "file_id")
        out.append(read.select("file_id", credit.alias("lexical"), F.when(F.col("_ocr"), credit).otherwise(0.0).alias("ocr"), reasons.alias("reason")))
    if "dense" not in o.without and lib.text_vectors is not None and text_query is not None:
        pool = lib.text_vectors.join(ids, "file_id", "left_semi")
        found = R.knn(pool, text_query, o.limits.dense, "file_id", "vector", o.limits.dense_least)
        out.append(say(found.select(F.col("id").alias("file_id"), F.col("score").alias("dense")), "Semantic similarity"))
    return out


def united(found: list[DataFrame], files: DataFrame) -> DataFrame:
    """One row a file: the best score of each kind, and the distinct reasons."""
    if not found:
        return files.limit(0).select("file_id", *[F.lit(0.0).alias(k) for k in KINDS], F.array().cast("array<string>").alias("reasons"))
    wide = [b.select("file_id", *[(F.col(k) if k in b.columns else F.lit(0.0)).alias(k) for k in KINDS], "reason") for b in found]
    both = reduce(DataFrame.unionByName, wide).groupBy("file_id")
    return both.agg(*[F.max(k).alias(k) for k in KINDS], F.array_sort(F.collect_set("reason")).alias("reasons"))


def date_score(plan: Plan, files: DataFrame) -> Column:
    """1 for a match, -1 for none, 0 where the sentence has no date or the file none. The capture date
    counts before the time of change."""
    if plan.when is None:
        return F.lit(0)
    changed = F.to_date(F.timestamp_seconds(F.when(F.col("modified_at") > 1e11, F.col("modified_at") / 1000).otherwise(F.col("modified_at"))))
    day = F.coalesce(F.col("capture_date"), changed) if "capture_date" in files.columns else changed
    return F.when(day.isNull(), 0).when(plan.when.predicate(day), 1).otherwise(-1)


def category_score(plan: Plan, columns: list[str]) -> Column:
    """1 where a document type of the sentence is in the file's type or name, .8 where one of its categories is
    in the file's own, else 0."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))) if c in columns else F.lit("")
    name, kind, category = low("filename"), low("document_type"), low("category_v4")
    score = F.lit(0.0)
    for target in plan.categories:
        score = F.when(category.contains(target.lower()) | name.contains(target.lower()), 0.8).otherwise(score)
    for target in plan.document_types:
        score = F.when(kind.contains(target.lower()) | name.contains(target.lower()), 1.0).otherwise(score)
    return score


def user_category(category: str, columns: list[str]) -> Column:
    """A category chosen by the user: by extension, or by words in the file's type or category."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))) if c in columns else F.lit("")
    wanted = category.strip().lower()
    one = wanted.removesuffix("s")
    by_words = reduce(lambda a, b: a | b, [low("file_type").contains(w) for w in V.TYPE_WORDS.get(one, [])], F.lit(False))
    return C.in_category(F.col("extension"), one) & F.lit(one.capitalize() in V.FILTER_CATEGORY) | low("file_type").contains(wanted) | low("category").contains(wanted) | by_words


def sorted_by(rows: DataFrame, how: str) -> list[Column]:
    """Sort modes of a result list; relevance goes by the score in ``DIGITS`` digits, as it is shown, then path."""
    modes = {"date_desc": [F.desc("modified_at")], "date_asc": [F.asc("modified_at")], "size_desc": [F.desc("size_bytes")], "size_asc": [F.asc("size_bytes")], "name": [F.lower("filename").asc()], "name_desc": [F.lower("filename").desc()]}
    return [*modes.get(how.lower(), [F.desc(F.round("score", DIGITS))]), F.asc("_order_path")]


def scored(lib: Library, plan: Plan, o: Options, text_query: list[float] | None = None, image_query: list[float] | None = None) -> DataFrame:
    """All candidates with their scores, before the result's own limit."""
    files = admitted(lib, plan, o)
    found = united(branches(lib, files, plan, o, text_query, image_query), files).join(files, "file_id")
    name = R.filename_score(F.col("filename"), F.col("extracted_text"), plan.text, list(plan.expansions)) if "filename" not in o.without else F.lit(0.0)
    found = found.withColumn("filename_score", name)
    if lib.understanding is not None and "roles" not in o.without:
        known = U.evidence(lib.understanding).select(*[F.col(c).alias(c if c == "file_id" else f"_ev_{c}") for c in ("file_id", "document_type", "description", "subjects", "clothing", "objects", "attributes", "actions", "scene", "bound")])
        own = known.toDF(*[c.removeprefix("_ev_") for c in known.columns])
        roles = U.evaluated(found.select("file_id").join(own, "file_id", "left"), plan.roles).select("file_id", F.col("document_type").isNotNull().alias("analysed"), "coordination", "contradiction", "role_score")
        found = found.join(roles, "file_id")
    else:
        found = found.withColumns({"analysed": F.lit(False), "coordination": F.lit(0.0), "contradiction": F.lit(0.0), "role_score": F.lit(0.0)})
    c = F.col
    base = R.fused(plan.intent, c("image"), c("lexical"), c("dense"), c("filename_score"))
    if "filename" in o.without:  # the other weights share what the name's weight leaves
        weights = V.INTENT_WEIGHTS[plan.intent]
        base = base * (sum(weights) / sum(weights[:3]))
    denied = c("analysed") & (c("image") > 0) & (c("coordination") < 0.25) & F.lit(plan.visual)
    score = R.contradiction_damping(R.role_blend(base, c("role_score"), c("coordination"), denied), c("contradiction"))
    score = R.person_fusion(score, c("person"), bool(plan.persons))
    found = found.withColumns({"date_score": date_score(plan, files), "category_score": category_score(plan, found.columns)})
    return found.withColumn("score", R.boosted(score, c("date_score"), c("category_score") > 0))


def search(lib: Library, sentence: str, o: Options, text_query: list[float] | None = None, image_query: list[float] | None = None) -> DataFrame:
    """The ranked list for a sentence: (rank, file_id, path, filename, extension, size_bytes, score, badge,
    explanation, snippet and the scores of the branches); hidden rows are out, protected ones masked."""
    plan = parse(sentence, o.now, known_names(lib.people, sentence))
    rows = scored(lib, plan, o, text_query, image_query)
    if sentence.strip() != "*":
        rows = rows.filter(F.col("score") > LEAST)
    rows = rows.withColumn("_order_path", F.col("path"))
    best = rows.orderBy(*sorted_by(rows, o.sort_by)).limit(o.limit)
    first = next(iter(R.query_terms(plan.text)[1] or R.query_terms(plan.text)[0]), None)
    shown = best.withColumns({
        "badge": F.format_string("Relevance Score: %.2f", "score"),
        "explanation": F.when(F.size("reasons") > 0, R.explanation(F.col("reasons"))).otherwise("Matching file content"),
        "snippet": snippet(F.col("extracted_text"), first) if first else F.lit(""),
    })
    masked = G.masked(shown, o.authenticated, o.hide_names)
    columns = ["file_id", "path", "filename", "extension", "size_bytes", "score", "badge", "explanation", "snippet", *KINDS, "filename_score", "role_score", "date_score", "category_score", "privacy_state"]
    place = F.row_number().over(Window.orderBy(*sorted_by(rows, o.sort_by)))  # over the limit's rows
    return masked.withColumn("rank", place).select("rank", *columns)


def ablations(lib: Library, sentence: str, o: Options, text_query: list[float] | None = None, image_query: list[float] | None = None) -> dict[str, DataFrame]:
    """Result lists with more and more of the engine: file names only, text, + images, + dense vectors, all;
    and all but the file names."""
    every = frozenset(("persons", "images", "concepts", "text", "expansions", "dense", "filename", "roles"))
    runs = {"text": every - {"text"}, "text_images": every - {"text", "images"}, "text_images_dense": every - {"text", "images", "dense"}, "full": frozenset(), "no_filename": frozenset({"filename"})}
    found = {name: search(lib, sentence, replace(o, without=left), text_query, image_query) for name, left in runs.items()}
    words = [w for w in re.findall(r"[^\W_]+", sentence.lower()) if len(w) > 1]
    names = lib.files.filter(U.like_tokens(["filename"], words)).orderBy("path").limit(o.limit) if words else lib.files.limit(0)
    return {"filename": names.select("file_id", "path")} | found
