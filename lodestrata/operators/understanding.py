"""What was understood of a file (objects, people, colours ...): evidence by role, its evaluation against
the roles of a query, concept search, searchable terms, and the sink.

Understanding records have document_type, title, event_name and description as strings, the LISTS as
arrays of strings, and ``attributes`` as a map. ``lists`` reads them from JSON text or comma-separated
text. Null lists are empty.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import ambient, tokens

LISTS = ["dates", "times", "locations", "organizations", "people", "objects", "entities", "semantic_tags", "visual_concepts", "activities", "colors", "relationships", "important_text"]
#: What concept search looks into.
FIELDS = ["title", "event_name", "document_type", "objects", "semantic_tags", "visual_concepts", "description", "important_text"]
#: A file's understanding is one for each of these.
VERSION = ["file_id", "model", "prompt_schema_version"]


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _any(found: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, found) if found else F.lit(False)


def lists(text: Column) -> Column:
    """A list from JSON, else from text with commas; entries trimmed, empty ones dropped."""
    parsed = F.coalesce(F.from_json(text, "array<string>"), F.split(text, ","))
    return F.filter(F.transform(_list(parsed), lambda x: F.trim(x)), lambda x: x != "")


def evidence(du: DataFrame) -> DataFrame:
    """(file_id, document_type, description, subjects, clothing, objects, attributes, actions, scene,
    relationships, bound): ``bound`` maps a noun to the attributes that stand before it in a phrase."""
    c = {n: _list(F.col(n)) for n in ("people", "entities", "objects", "colors", "activities", "visual_concepts", "semantic_tags", "locations", "relationships")}
    garment = "|".join(map(re.escape, V.GARMENTS))
    dressed = lambda x: F.lower(x).rlike(rf"\b({garment})\b")
    description = F.trim(F.coalesce("description", F.lit("")))
    phrases = F.transform(F.concat(c["objects"], F.array(description)), lambda p: F.filter(F.split(F.lower(p), r"\s+"), lambda w: w != ""))
    marks = F.concat(c["colors"], F.array(*[F.lit(a) for a in V.MATERIALS]))

    def pairs(words: Column, mark: Column) -> Column:
        noun = lambda i: F.regexp_replace(F.get(words, i + 1), r"^[.,;:()]+|[.,;:()]+$", "")
        at = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: F.get(words, i).contains(F.lower(mark)) & (F.length(noun(i)) > 2))
        return F.transform(at, lambda i: F.struct(noun(i).alias("noun"), mark.alias("mark")))

    found = F.flatten(F.transform(phrases, lambda w: F.flatten(F.transform(marks, lambda m: pairs(w, m)))))
    rows = du.select(
        "file_id",
        F.trim(F.coalesce("document_type", F.lit(""))).alias("document_type"),
        description.alias("description"),
        F.concat(c["people"], F.array_except(c["entities"], c["people"])).alias("subjects"),
        F.filter(c["objects"], dressed).alias("clothing"),
        F.filter(c["objects"], lambda x: ~dressed(x)).alias("objects"),
        F.array_distinct(F.concat(c["colors"], c["visual_concepts"])).alias("attributes"),
        c["activities"].alias("actions"),
        F.concat(c["locations"], F.filter(c["semantic_tags"], lambda t: t.isin(V.SCENE_TAGS))).alias("scene"),
        c["relationships"].alias("relationships"),
        found.alias("_pairs"),
    )
    bound = F.map_from_entries(F.transform(F.array_distinct(F.transform("_pairs", lambda p: p["noun"])), lambda n: F.struct(n, F.transform(F.filter("_pairs", lambda p: p["noun"] == n), lambda p: p["mark"]))))
    return rows.withColumn("bound", bound).drop("_pairs")


def evaluated(rows: DataFrame, roles) -> DataFrame:
    """Rows of ``evidence`` (left-joined: null where a file has none) with the scores of the query's roles:
    one of {0, .2, .4, 1} for each role, coordination = mean^2, contradiction, and the roles' score.
    Files without evidence score 0 everywhere: they are unknown, not wrong."""
    known = F.col("document_type").isNotNull()
    text = lambda part, *more: F.lower(F.array_join(F.concat(_list(F.col(part)), F.array(*more, F.col("description"))), " "))
    word = lambda t, w: t.rlike(rf"\b{re.escape(w)}\b")
    some = lambda t, words: _any([word(t, w) for w in words])
    one = lambda hit: F.when(hit, 1.0).otherwise(0.0)
    people, dress, marks = text("subjects", F.col("document_type")), text("clothing"), text("attributes")

    subject = F.lit(1.0)
    if roles.subjects:
        forms = [s for q in roles.subjects for s in V.SUBJECT_SYNONYMS.get(q, [q])]
        stand_in = _any([people.contains(w) for w in V.STAND_IN_WORDS]) if {"guy", "man", "person"} & set(roles.subjects) else F.lit(False)
        subject = F.when(some(people, forms), 1.0).when(stand_in, V.STAND_IN).otherwise(0.0)
    clothing = one(some(dress, [s for q in roles.clothing for s in V.CLOTHING_SYNONYMS.get(q, [q])])) if roles.clothing else F.lit(1.0)
    plain = {part: one(some(text(part), getattr(roles, part))) if getattr(roles, part) else F.lit(1.0) for part in ("objects", "actions", "scene")}

    attribute = tied = F.lit(1.0)
    if roles.attributes:
        general = some(marks, roles.attributes)
        if roles.bound:
            # the last pair that says anything decides: bound gives 1, an attribute of something else .2
            attribute, tied = F.lit(0.0), F.lit(0.0)
            for mark, target in roles.bound:
                forms = V.CLOTHING_SYNONYMS.get(target, [target])
                near = _any([marks.rlike(rf"\b{re.escape(mark)}\s+{re.escape(t)}\b") | marks.rlike(rf"(in|wearing)\s+a?\s*{re.escape(mark)}\s+{re.escape(t)}") | F.coalesce(F.array_contains(F.try_element_at("bound", F.lit(t)), mark), F.lit(False)) for t in forms])
                attribute, tied = F.when(near, 1.0).when(general, V.ELSEWHERE).otherwise(attribute), F.when(near, 1.0).when(general, 0.0).otherwise(tied)
        else:
            attribute = tied = one(general)

    against = [F.lit(0.0)]
    if roles.clothing and roles.subjects:
        against.append(F.when((F.size("subjects") == 0) & (F.size("clothing") == 0), V.NOBODY).otherwise(0.0))
    if roles.bound:
        worn = _any([some(dress, V.CLOTHING_SYNONYMS.get(t, [t])) for _, t in roles.bound])
        against.append(F.when((F.size("clothing") > 0) & worn & (tied == 0.0), V.UNBOUND).otherwise(0.0))
    if {"dress", "gown"} & set(roles.clothing):
        against.append(F.when(_any([dress.contains(w) for w in V.COSTUMES]), V.COSTUME).otherwise(0.0))
    contradiction = F.greatest(*against) if len(against) > 1 else against[0]

    active = [s for s, asked in ((subject, roles.subjects), (clothing, roles.clothing), (plain["objects"], roles.objects), (plain["actions"], roles.actions), (plain["scene"], roles.scene), (tied if roles.bound else attribute, roles.attributes)) if asked]
    scores = {"subject_match": subject, "attribute_match": attribute, "clothing_match": clothing, "object_match": plain["objects"], "action_match": plain["actions"], "scene_match": plain["scene"], "bound_match": tied, "contradiction": contradiction}
    zero = lambda c: F.when(known, c).otherwise(0.0)
    rows = rows.withColumns({n: zero(s) for n, s in scores.items()})
    mean = reduce(lambda a, b: a + b, active) / len(active) if active else F.lit(1.0)
    rows = rows.withColumn("_mean", zero(mean)).withColumn("coordination", F.col("_mean") * F.col("_mean"))
    score = F.col("coordination") * F.col("_mean") * F.greatest(F.lit(0.0), 1 - V.AGAINST * F.col("contradiction"))
    return rows.withColumns({"relationship_match": zero(one(F.col("bound_match") > 0)), "role_score": F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 4)}).drop("_mean")


def searchable_terms(du: DataFrame) -> Column:
    """All entries of the lists, the words of title and event name, lower case, distinct, sorted."""
    entries = [_list(F.col(n)) for n in LISTS if n != "relationships" and n in du.columns]
    words = [F.split(F.coalesce(n, F.lit("")), r"\s+") for n in ("title", "event_name")]
    every = F.transform(F.flatten(F.array(*entries, *words)), lambda x: F.lower(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: x != "")))


def concept_tiers(du: DataFrame) -> DataFrame:
    """(file_id, core, secondary, terms): objects and tags are core; visual concepts are secondary where
    ambient words are in them, else core; terms are all of these and their words of two letters or more."""
    objects, tags, concepts = (F.transform(_list(F.col(n)), F.lower) for n in ("objects", "semantic_tags", "visual_concepts"))
    core = F.array_sort(F.array_distinct(F.concat(objects, tags, F.filter(concepts, lambda c: ~ambient(c)))))
    secondary = F.array_sort(F.array_distinct(F.filter(concepts, ambient)))
    every = F.concat(core, secondary)
    words = F.filter(F.flatten(F.transform(every, lambda c: F.split(c, r"\s+"))), lambda w: F.length(w) >= 2)
    return du.select("file_id", core.alias("core"), secondary.alias("secondary"), F.array_sort(F.array_distinct(F.concat(every, words))).alias("terms"))


def concept_words(query: str) -> list[str]:
    """The words of a sentence that concept search looks for: not short, not stop words, but known short names."""
    words = [w for w in re.sub(r"[^\w\s]|_", " ", query.lower()).split()]
    kept = [w for w in words if (len(w) > 2 and w not in V.STOP_WORDS) or w in V.SHORT_NAMES]
    return list(dict.fromkeys(kept or [w for w in words if w not in ("a", "an", "the")]))


def concept_hits(du: DataFrame, query: str, limit: int = 50, key: str = "file_id") -> DataFrame:
    """(key, hits): records with whole words of the query in any of FIELDS, most first, larger keys first.
    All records are counted before the limit."""
    words = concept_words(query)
    if not words:
        return du.limit(0).select(key, F.lit(0).alias("hits"))
    kinds = dict(du.dtypes)
    whole = F.concat_ws(" ", *[F.array_join(_list(F.col(n)), " ") if kinds[n].startswith("array") else F.col(n) for n in FIELDS if n in kinds])
    hits = F.size(F.array_intersect(tokens(whole), F.array(*[F.lit(w) for w in words])))
    return du.select(key, hits.alias("hits")).filter("hits > 0").orderBy(F.desc("hits"), F.desc(key)).limit(limit)


def like_tokens(columns: list[str], words: list[str]) -> Column:
    """Some word is a substring of some column, case aside."""
    return _any([F.lower(F.coalesce(F.col(c), F.lit(""))).contains(w.lower()) for c in columns for w in words])


def match_count(columns: list[str], words: list[str]) -> Column:
    """How many of the words are substrings of some column."""
    return reduce(lambda a, b: a + b, [like_tokens(columns, [w]).cast("int") for w in words], F.lit(0))


def store(du: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: of records for one file, model and prompt version the newest (largest updated_at) stays."""
    both = du.select(du.columns).unionByName(new.select(du.columns))
    newest = both.groupBy(*VERSION).agg(F.max_by(F.struct(*[c for c in du.columns if c not in VERSION]), "updated_at").alias("r"))
    return newest.select(*VERSION, "r.*").select(du.columns)


def index_content(files: DataFrame, du: DataFrame) -> DataFrame:
    """(file_id, filename, content): what full-text search sees: native text, OCR text, terms and description."""
    enriched = du.withColumn("_terms", F.array_join(searchable_terms(du), " ")).select("file_id", "_terms", "description")
    ocr = F.col("ocr_text") if "ocr_text" in files.columns else F.lit(None).cast("string")
    joined = files.withColumn("_ocr", ocr).join(enriched, "file_id", "left")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return joined.select("file_id", "filename", F.trim(F.concat_ws("\n", empty(F.col("extracted_text")), empty(F.col("_ocr")), empty(F.col("_terms")), empty(F.col("description")))).alias("content"))



#: Fields of an analyser's answer: texts, and lists of texts.
ANSWER_TEXTS = ["document_type", "title", "event_name", "description"]
ANSWER_LISTS = ["dates", "times", "locations", "organizations", "people", "objects", "entities", "semantic_tags", "visual_concepts", "activities", "colors", "relationships", "important_text"]


def _answer_text(v: Column) -> Column:
    return F.nullif(F.trim(F.try_variant_get(v, "$", "string")), F.lit(""))


def _answer_list(answer: Column, name: str) -> Column:
    """A list field as trimmed texts: numbers are texts, blank ones and objects go; a lone text is a list of one."""
    value = F.try_variant_get(answer, f"$.{name}", "variant")
    kind = F.schema_of_variant(value)
    each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda e: F.when(~F.schema_of_variant(e).rlike("^(ARRAY|OBJECT|VOID|BOOLEAN)"), _answer_text(e)))
    return F.when(kind.startswith("ARRAY"), F.array_compact(each)).when(kind == "STRING", F.array_compact(F.array(_answer_text(value)))).otherwise(F.array().cast("array<string>"))


def answered(rows: DataFrame, raw: str = "raw_response") -> DataFrame:
    """``rows`` with the fields of an analyser's JSON in ``raw``, whatever types it gave them: ``document_type`` (lower
    case, 'document' if missing), ``title``, ``event_name``, ``description``, the lists, ``attributes`` (the texts
    of an object's fields) and ``confidence`` (1 if missing). JSON inside a fence or between other words is
    recovered; what is no JSON object gives ``is_json`` false and the values of an empty answer. Columns with
    these names are replaced."""
    text = F.col(raw)
    ticks = "`" * 3
    tries = [text, F.regexp_extract(text, rf"(?s){ticks}(?:json)?\s*(\{{.*?\}})\s*{ticks}", 1), F.regexp_extract(text, r"(?s)(\{.*\})", 1)]
    objects = [F.try_parse_json(t) for t in tries]
    answer = F.coalesce(*[F.when(F.schema_of_variant(o).startswith("OBJECT"), o) for o in objects])
    met = rows.withColumn("_answer", answer)
    a = F.col("_answer")
    field = lambda n: _answer_text(F.try_variant_get(a, f"$.{n}", "variant"))
    made = {n: field(n) for n in ANSWER_TEXTS} | {n: _answer_list(a, n) for n in ANSWER_LISTS}
    made["document_type"] = F.coalesce(F.lower(made["document_type"]), F.lit("document"))
    made["description"] = F.coalesce(made["description"], F.lit(""))
    made["attributes"] = F.coalesce(F.try_variant_get(a, "$.attributes", "map<string,string>"), F.create_map().cast("map<string,string>"))
    made["confidence"] = F.coalesce(F.try_variant_get(a, "$.confidence", "double"), F.lit(1.0))
    made["is_json"] = a.isNotNull()
    return met.withColumns(made).drop("_answer")
