"""Queries of search, roles and understanding over a library derived from the test tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import governance as G
from ..operators import retrieval as R
from ..operators import understanding as U
from ..sources.views import FILES_SQL, files, table
from . import search as S
from .catalogue import _COS, _Q, _TOK, _in
from .people import _STATE, people
from .people import _WITH as _PEOPLE
from .planner import decompose_roles, parse
from .registry import query

NOW = date(2026, 10, 7)


def _pick(column: str, step: int, words: list[str]) -> str:
    """An expression that both dialects read."""
    cases = " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(words))
    return f"CASE CAST(floor({column} / {step}) AS BIGINT) % {len(words)} {cases} END"


#: Scalars of the derived understanding records.
_PICKS = {
    "p1": _pick("file_id", 1, ["man", "woman", "dog", "", "spider-man character"]),
    "o1": _pick("file_id", 2, ["red shirt", "wooden table", "blue dress", "brown t-shirt", "superhero suit", "laptop"]),
    "o2": _pick("file_id", 3, ["umbrella", "green jacket", "cooked rice", "red car"]),
    "c1": _pick("file_id", 1, ["red", "brown", "blue"]),
    "a1": _pick("file_id", 5, ["wearing", "sitting", "holding"]),
    "v1": _pick("file_id", 2, ["vintage chair", "portrait", "warm light"]),
    "t1": _pick("file_id", 4, ["outdoor", "screen", "kitchen"]),
    "l1": _pick("file_id", 7, ["beach", "street", "park"]),
    "d1": _pick("file_id", 3, ["invoice", "photograph", "certificate", "notes"]),
}
_ARRAYS = {"people": ["p1"], "entities": ["p1", "t1"], "objects": ["o1", "o2"], "colors": ["c1"], "activities": ["a1"], "visual_concepts": ["v1"], "semantic_tags": ["t1"], "locations": ["l1"]}
_DU_SQL = f"""picked AS (SELECT file_id, {', '.join(f'{v} AS {k}' for k, v in _PICKS.items())} FROM files WHERE file_id % 3 <> 2),
    du AS (SELECT file_id, d1 AS document_type, 'A ' || v1 || ' of ' || l1 AS title, 'A ' || c1 || ' ' || o2 || ' near ' || l1 AS description, {', '.join(f"list_filter([{', '.join(v)}], lambda x: x <> '') AS {k}" for k, v in _ARRAYS.items())} FROM picked)"""


def understanding(spark, sf):
    p = files(spark, sf).filter("file_id % 3 <> 2").select("file_id", *[F.expr(v).alias(k) for k, v in _PICKS.items()])
    lists = {k: F.filter(F.array(*v), lambda x: x != "") for k, v in _ARRAYS.items()}
    none = {"relationships": F.array().cast("array<string>"), "important_text": F.array().cast("array<string>"), "event_name": F.lit(None).cast("string")}
    return p.select("file_id", F.col("d1").alias("document_type"), F.concat(F.lit("A "), "v1", F.lit(" of "), "l1").alias("title"), F.concat(F.lit("A "), "c1", F.lit(" "), "o2", F.lit(" near "), "l1").alias("description"), *[c.alias(n) for n, c in (lists | none).items()])


def library(spark, sf) -> S.Library:
    f = files(spark, sf).withColumns({"privacy_state": F.expr(_STATE), "ocr_text": F.when(F.col("file_id") % 6 == 0, F.concat(F.lit("scan of "), "lang")), "document_type": F.expr(_PICKS["d1"]), "category_v4": F.when(F.col("file_id") % 4 == 1, "Personal Photos").otherwise("Education"), "file_type": F.lit(None).cast("string")})
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("file_id"), F.col("embedding").alias("vector"))
    return S.Library(f, understanding(spark, sf), v, v, people(spark, sf))


_LIB_SQL = f"""{_PEOPLE}, lib AS (SELECT *, {_STATE} AS privacy_state, CASE WHEN file_id % 6 = 0 THEN 'scan of ' || lang END AS ocr_text, {_PICKS['d1']} AS document_type, CASE WHEN file_id % 4 = 1 THEN 'Personal Photos' ELSE 'Education' END AS category_v4 FROM files), {_DU_SQL},
    content AS (SELECT file_id, extension, {_TOK.format("concat_ws(chr(10), filename, extracted_text, ocr_text)")} AS t FROM lib)"""


# ---------------------------------------------------------------- roles

_ANY = "(" + "|".join(V.GARMENTS) + ")"


def _sql_roles(roles) -> str:
    """CTE ``roles``(file_id, subject, clothing, objects, actions, scene, attribute, bound, contradiction, coordination, role_score)."""
    word = lambda t, words: f"regexp_matches({t}, '\\b({'|'.join(words)})\\b')"
    one = lambda c: f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END::DOUBLE"
    dress = [c for q in roles.clothing for c in V.CLOTHING_SYNONYMS.get(q, [q])]
    parts = {"subject": "1.0::DOUBLE", "clothing": one(word("dress_t", dress)) if roles.clothing else "1.0::DOUBLE"}
    if roles.subjects:
        forms = [s for q in roles.subjects for s in V.SUBJECT_SYNONYMS.get(q, [q])]
        stand = "(contains(people_t, 'character') OR contains(people_t, 'hero') OR contains(people_t, 'illustration'))" if {"guy", "man", "person"} & set(roles.subjects) else "false"
        parts["subject"] = f"CASE WHEN {word('people_t', forms)} THEN 1.0 WHEN {stand} THEN 0.4 ELSE 0.0 END::DOUBLE"
    for part in ("objects", "actions", "scene"):
        parts[part] = one(word(f"{part}_t", getattr(roles, part))) if getattr(roles, part) else "1.0::DOUBLE"
    attribute = bound = "1.0::DOUBLE"
    if roles.attributes:
        general = word("marks_t", roles.attributes)
        attribute = bound = "0.0::DOUBLE"
        for mark, target in roles.bound:
            forms = "|".join(V.CLOTHING_SYNONYMS.get(target, [target]))
            known = f"(list_contains(colors, '{mark}') OR '{mark}' IN {_in(V.MATERIALS)})"
            near = f"(regexp_matches(marks_t, '\\b{mark}\\s+({forms})\\b') OR regexp_matches(marks_t, '(in|wearing)\\s+a?\\s*{mark}\\s+({forms})') OR ({known} AND len(list_filter(phrases, lambda p: regexp_matches(p, '(^|\\s)\\S*{mark}\\S*\\s+[.,;:()]*({forms})[.,;:()]*(\\s|$)'))) > 0))"
            attribute, bound = f"CASE WHEN {near} THEN 1.0 WHEN {general} THEN 0.2 ELSE {attribute} END::DOUBLE", f"CASE WHEN {near} THEN 1.0 WHEN {general} THEN 0.0 ELSE {bound} END::DOUBLE"
        if not roles.bound:
            attribute = bound = one(general)
    parts |= {"attribute": attribute, "bound": bound}
    against = ["0.0::DOUBLE"]
    if roles.clothing and roles.subjects:
        against.append("CASE WHEN len(subjects) = 0 AND len(worn) = 0 THEN 0.7 ELSE 0.0 END::DOUBLE")
    if roles.bound:
        worn = [c for _, t in roles.bound for c in V.CLOTHING_SYNONYMS.get(t, [t])]
        against.append(f"CASE WHEN len(worn) > 0 AND {word('dress_t', worn)} AND bound = 0 THEN 0.65 ELSE 0.0 END::DOUBLE")
    if {"dress", "gown"} & set(roles.clothing):
        against.append("CASE WHEN contains(dress_t, 'superhero suit') OR contains(dress_t, 'costume') OR contains(dress_t, 'spider-man suit') OR contains(dress_t, 'vulture suit') THEN 0.6 ELSE 0.0 END::DOUBLE")
    active = [n for n, asked in (("subject", roles.subjects), ("clothing", roles.clothing), ("objects", roles.objects), ("actions", roles.actions), ("scene", roles.scene), ("bound" if roles.bound else "attribute", roles.attributes)) if asked]
    mean = f"(({' + '.join(f'r.{a}' for a in active)}) / {len(active)}.0::DOUBLE)" if active else "1.0::DOUBLE"
    return f"""ev AS (SELECT file_id, colors, list_concat(people, list_filter(entities, lambda x: NOT list_contains(people, x))) AS subjects, list_filter(objects, lambda x: regexp_matches(lower(x), '\\b{_ANY}\\b')) AS worn, list_filter(objects, lambda x: NOT regexp_matches(lower(x), '\\b{_ANY}\\b')) AS things,
        activities, list_concat(locations, list_filter(semantic_tags, lambda x: x IN {_in(V.SCENE_TAGS)})) AS places, list_concat(colors, visual_concepts) AS marks, document_type, description, list_transform(list_concat(objects, [description]), lambda x: lower(x)) AS phrases FROM du),
    texts AS (SELECT *, lower(array_to_string(list_concat(subjects, [document_type, description]), ' ')) AS people_t, lower(array_to_string(list_concat(worn, [description]), ' ')) AS dress_t, lower(array_to_string(list_concat(things, [description]), ' ')) AS objects_t,
        lower(array_to_string(list_concat(activities, [description]), ' ')) AS actions_t, lower(array_to_string(list_concat(places, [description]), ' ')) AS scene_t, lower(array_to_string(list_concat(marks, [description]), ' ')) AS marks_t FROM ev),
    r AS (SELECT file_id, subjects, worn, dress_t, {', '.join(f'{v} AS {k}' for k, v in parts.items())} FROM texts), against AS (SELECT *, greatest({', '.join(against)}) AS contradiction FROM r),
    roles AS (SELECT r.file_id, r.subject, r.clothing, r.objects, r.actions, r.scene, r.attribute, r.bound, r.contradiction, {mean} * {mean} AS coordination, round_even(least(1.0, {mean} * {mean} * {mean} * (1 - 0.75::DOUBLE * r.contradiction)), 4) AS role_score FROM against r)"""


def _roles(name: str, sentence: str):
    roles = decompose_roles(sentence)

    def run(spark, sf):
        rows = U.evaluated(U.evidence(understanding(spark, sf)), roles)
        names = {"subject": "subject_match", "clothing": "clothing_match", "object": "object_match", "action": "action_match", "place": "scene_match", "attribute": "attribute_match", "bound_match": "bound_match", "contradiction": "contradiction"}
        return rows.select("file_id", *[F.col(c).alias(n) for n, c in names.items()], F.round("coordination", 6).alias("coordination"), F.round("role_score", 4).alias("role_score"))

    run.__name__ = f"r12_roles_{name}"
    return query(f"WITH {FILES_SQL}, {_DU_SQL}, {_sql_roles(roles)} SELECT file_id, subject, clothing, objects AS object, actions AS action, scene AS place, attribute, bound AS bound_match, contradiction, round(coordination, 6) AS coordination, role_score FROM roles")(run)


_roles("bound", "a man wearing red shirt holding umbrella in the park")
_roles("dress", "woman in blue dress at the beach")
_roles("animal", "dog sitting in the street")
_roles("loose", "vintage portrait")


@query(f"WITH {FILES_SQL}, {_DU_SQL}, {_sql_roles(decompose_roles('man'))} SELECT file_id, array_to_string(subjects, '|') AS subjects, array_to_string(worn, '|') AS clothing, array_to_string(things, '|') AS objects, array_to_string(places, '|') AS scene FROM ev")
def p11_evidence(spark, sf):
    e = U.evidence(understanding(spark, sf))
    return e.select("file_id", *[F.array_join(c, "|").alias(c) for c in ("subjects", "clothing", "objects", "scene")])


_TERMS = "list_sort(list_distinct(list_filter(list_transform(list_concat(list_concat(list_concat(locations, people), list_concat(objects, entities)), list_concat(list_concat(semantic_tags, visual_concepts), list_concat(list_concat(activities, colors), string_split(title, ' ')))), lambda x: lower(trim(x))), lambda x: x <> '')))"


@query(f"WITH {FILES_SQL}, {_DU_SQL} SELECT file_id, array_to_string({_TERMS}, '|') AS terms FROM du")
def p10_searchable_terms(spark, sf):
    du = understanding(spark, sf)
    return du.select("file_id", F.array_join(U.searchable_terms(du), "|").alias("terms"))


_SQL_AMBIENT = " OR ".join(f"contains(x, '{w}')" for w in V.AMBIENT)


@query(f"""WITH {FILES_SQL}, {_DU_SQL}, c AS (SELECT file_id, list_sort(list_distinct(list_concat(list_concat(objects, semantic_tags), list_filter(visual_concepts, lambda x: NOT ({_SQL_AMBIENT}))))) AS core, list_sort(list_distinct(list_filter(visual_concepts, lambda x: {_SQL_AMBIENT}))) AS secondary FROM du)
    SELECT file_id, array_to_string(core, '|') AS core, array_to_string(secondary, '|') AS secondary, array_to_string(list_sort(list_distinct(list_concat(list_concat(core, secondary), list_filter(flatten(list_transform(list_concat(core, secondary), lambda x: string_split(x, ' '))), lambda w: length(w) >= 2)))), '|') AS terms FROM c""")
def p9_tiers(spark, sf):
    t = U.concept_tiers(understanding(spark, sf))
    return t.select("file_id", *[F.array_join(c, "|").alias(c) for c in ("core", "secondary", "terms")])


def _sql_concepts(sentence: str, limit: int, table_: str = "du") -> str:
    whole = "concat_ws(' ', title, document_type, array_to_string(objects, ' '), array_to_string(semantic_tags, ' '), array_to_string(visual_concepts, ' '), description)"
    words = U.concept_words(sentence)
    return f"(SELECT file_id, len(list_intersect({_TOK.format(whole)}, {words}))::INTEGER AS hits FROM {table_} WHERE len(list_intersect({_TOK.format(whole)}, {words})) > 0 ORDER BY 2 DESC, 1 DESC LIMIT {limit})"


@query(f"WITH {FILES_SQL}, {_DU_SQL} SELECT * FROM {_sql_concepts('a red shirt at the beach or an invoice', 60)}")
def r10_concept_hits(spark, sf):
    return U.concept_hits(understanding(spark, sf), "a red shirt at the beach or an invoice", 60)


@query(f"WITH {FILES_SQL}, {_DU_SQL}, t AS (SELECT file_id, lower(concat_ws(chr(1), title, description, document_type)) AS x FROM du) SELECT file_id, (contains(x, 'beach')::INTEGER + contains(x, 'red')::INTEGER + contains(x, 'voice')::INTEGER) AS matches FROM t WHERE contains(x, 'beach') OR contains(x, 'red') OR contains(x, 'voice')")
def f19_a11_like_tokens(spark, sf):
    columns, words = ["title", "description", "document_type"], ["BEACH", "red", "voice"]
    du = understanding(spark, sf)
    return du.filter(U.like_tokens(columns, words)).select("file_id", U.match_count(columns, words).alias("matches"))


@query(f"{_LIB_SQL} SELECT l.file_id, l.filename, trim(concat_ws(chr(10), extracted_text, coalesce(ocr_text, ''), coalesce(array_to_string({_TERMS}, ' '), ''), coalesce(description, '')), ' ') AS content FROM lib l LEFT JOIN du USING (file_id)")
def s13_s17_index_content(spark, sf):
    lib = library(spark, sf)
    return U.index_content(lib.files, lib.understanding)


# ---------------------------------------------------------------- search


def _sql_bm25_of(name: str, whole: list[str], prefixes: list[str], limit: int, category: str | None) -> str:
    tf = [f"len(list_filter(t, lambda x: x = '{w}'))" for w in whole] + [f"len(list_filter(t, lambda x: starts_with(x, '{p}')))" for p in prefixes]
    n = range(len(tf))
    stats = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in n)
    score = " + ".join(f"ln(1 + (n - df{k} + 0.5::DOUBLE) / (df{k} + 0.5::DOUBLE)) * tf{k} * 2.2::DOUBLE / (tf{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for k in n)
    kept = " AND file_id IN (SELECT file_id FROM kept)" + (f" AND lower(extension) IN {_in(V.FILTER_CATEGORY[category])}" if category else "")
    return f"{name}_c AS (SELECT file_id, extension, len(t) AS dl, {', '.join(f'{x} AS tf{k}' for k, x in enumerate(tf))} FROM content), {name}_s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {stats} FROM {name}_c), {name} AS (SELECT file_id, {score} AS bm25 FROM {name}_c, {name}_s WHERE {' AND '.join(f'tf{k} > 0' for k in n)}{kept} ORDER BY 2 DESC, 1 LIMIT {limit})"


def _sql_search(sentence: str, o: S.Options, persons: dict[str, str], limits: S.Limits = S.Limits()) -> str:
    plan = parse(sentence, o.now, persons)
    extra = f" AND lower(extension) IN {_in(V.FILTER_CATEGORY[o.category.capitalize()])}" if o.category else ""
    extra += f" AND ends_with(lower(path), '.{plan.extension}')" if plan.extension else ""
    extra += f" AND size_bytes {'>' if plan.size[0] == 'gt' else '<'} {plan.size[1]}" if plan.size else ""
    extra += f" AND ltrim(lower(extension), '.') IN {_in([f.lower().lstrip('.') for f in o.formats])}" if o.formats else ""
    # all filters stand below the branches' limits
    ctes, found = [f"kept AS (SELECT file_id FROM lib WHERE privacy_state <> 'HIDDEN'{extra})", "known AS (SELECT * FROM du WHERE file_id IN (SELECT file_id FROM kept))"], []
    narrowed = o.category.capitalize() if o.category else plan.target
    row = lambda why, **k: "SELECT file_id, " + ", ".join(f"{k.get(n, '0.0')}::DOUBLE AS {n}" for n in S.KINDS) + f", {why} AS reason"
    norm = "bm25 / (1 + bm25)"
    for k, text in enumerate([plan.text, *plan.expansions[: limits.expansions]]):
        whole, prefixes = R.query_terms(text)
        if whole or prefixes:
            ctes.append(_sql_bm25_of(f"b{k}", whole, prefixes, limits.expansion if k else limits.text, narrowed))
            credit = "0.7" if k else norm
            why = f"'Matched term ''{text}'''" if k else "'Lexical FTS match'"
            found.append(f"{row(why, lexical=credit, ocr=f'CASE WHEN ocr_text IS NOT NULL THEN {credit} ELSE 0.0 END')} FROM b{k} JOIN lib USING (file_id)")
    look = o.category.upper() == "IMAGE" if o.category else "image" in plan.file_types if plan.file_types else (plan.visual or not plan.academic)
    if look:
        cosine = _COS.format("embedding", str(_Q))
        ctes.append(f"im AS (SELECT vec_id AS file_id, {cosine} AS s FROM embeddings WHERE vec_id IN (SELECT file_id FROM lib WHERE lower(extension) IN {_in(V.FILTER_CATEGORY['Image'])}) AND vec_id IN (SELECT file_id FROM kept) AND {cosine} >= {limits.image_least} ORDER BY 2 DESC, 1 LIMIT {limits.images})")
        found.append(f"{row("'Visual match'", image='least(1.0::DOUBLE, greatest(0.0::DOUBLE, (s - 0.18::DOUBLE) / 0.16::DOUBLE))')} FROM im")
    cosine = _COS.format("embedding", str(_Q[::-1]))
    ctes.append(f"de AS (SELECT vec_id AS file_id, {cosine} AS s FROM embeddings WHERE vec_id IN (SELECT file_id FROM kept) AND {cosine} >= {limits.dense_least} ORDER BY 2 DESC, 1 LIMIT {limits.dense})")
    found.append(f"{row("'Semantic similarity'", dense='s')} FROM de")
    if U.concept_words(plan.text):
        found.append(f"{row('NULL')} FROM {_sql_concepts(plan.text, limits.concepts, 'known')}")
    if plan.persons:
        ctes.append(f"who AS (SELECT min(person_id) AS person_id FROM (SELECT person_id, lower(name) AS k FROM persons UNION ALL SELECT person_id, lower(alias) FROM aliases) WHERE k = '{plan.persons[0].lower()}')")
        who = f"'Person match: {plan.persons[0]}'"
        found.append(f"{row(who, person='max(confidence)')} FROM links WHERE person_id = (SELECT person_id FROM who) AND file_id IN (SELECT file_id FROM kept) GROUP BY file_id")
    ctes.append(f"cand AS (SELECT file_id, {', '.join(f'max({n}) AS {n}' for n in S.KINDS)}, list_sort(list(DISTINCT reason) FILTER (reason IS NOT NULL)) AS reasons FROM ({' UNION ALL '.join(found)}) GROUP BY 1)")
    ctes.append(_sql_roles(plan.roles))
    words = [w for w in plan.text.lower().split() if len(w) > 1]
    own = "trim(regexp_replace(lower(filename), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
    some = lambda t: " OR ".join(f"contains({t}, '{e}')" for e in plan.expansions) or "false"
    named = f"CASE WHEN contains({own}, '{' '.join(plan.text.lower().split())}') THEN 1.0 WHEN {' AND '.join(f'''contains({own}, '{w}')''' for w in words) or 'false'} THEN 0.95 WHEN {some(own)} THEN 0.8 WHEN {some('lower(extracted_text)')} THEN 0.4 ELSE 0.0 END::DOUBLE"
    w = V.INTENT_WEIGHTS[plan.intent]
    day = "CAST(make_timestamp(CAST(modified_at * 1000000 AS BIGINT)) AS DATE)"
    dated = "0"
    if plan.when is not None:
        hit = f"{day} BETWEEN DATE '{plan.when.start}' AND DATE '{plan.when.end}'" if plan.when.start else f"month({day}) = {plan.when.month}" + (f" AND day({day}) = {plan.when.day}" if plan.when.day else "")
        dated = f"CASE WHEN {hit} THEN 1 ELSE -1 END"
    kinds = f"WHEN contains(lower(document_type), '{plan.document_types[0].lower()}') OR contains(lower(filename), '{plan.document_types[0].lower()}') THEN 1.0" if plan.document_types else ""
    cats = f"WHEN contains(lower(category_v4), '{plan.categories[0].lower()}') OR contains(lower(filename), '{plan.categories[0].lower()}') THEN 0.8" if plan.categories else ""
    category = f"CASE {kinds} {cats} ELSE 0.0 END::DOUBLE" if kinds or cats else "0.0::DOUBLE"
    ctes.append(f"""j AS (SELECT l.*, c.lexical, c.dense, c.image, c.person, c.reasons, {named} AS filename_score, coalesce(coordination, 0) AS coordination, coalesce(contradiction, 0) AS contradiction, coalesce(role_score, 0) AS role_score, roles.file_id IS NOT NULL AS analysed, {dated} AS date_score, {category} AS category_score
        FROM cand c JOIN lib l ON l.file_id = c.file_id LEFT JOIN roles ON roles.file_id = c.file_id WHERE l.file_id IN (SELECT file_id FROM kept)),
    s0 AS (SELECT *, {w[0]}::DOUBLE * image + {w[1]}::DOUBLE * lexical + {w[2]}::DOUBLE * dense + {w[3]}::DOUBLE * filename_score AS base FROM j),
    s1 AS (SELECT *, CASE WHEN role_score > 0.05 AND coordination >= 0.25 THEN 0.35::DOUBLE * coordination * role_score + (1 - 0.35::DOUBLE * coordination) * base WHEN analysed AND image > 0 AND coordination < 0.25 AND {str(plan.visual).lower()} THEN base * 0.85::DOUBLE ELSE base END * greatest(0.15::DOUBLE, 1 - 0.6::DOUBLE * contradiction) AS x1 FROM s0),
    s2 AS (SELECT *, {'CASE WHEN person > 0 THEN 0.55::DOUBLE * person + 0.45::DOUBLE * x1 ELSE x1 * 0.4::DOUBLE END' if plan.persons else 'x1'} AS x2 FROM s1),
    s3 AS (SELECT *, CASE WHEN date_score > 0 THEN least(1.0::DOUBLE, x2 * 1.35::DOUBLE) WHEN date_score < 0 THEN x2 * 0.4::DOUBLE ELSE x2 END AS x3 FROM s2),
    s4 AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN category_score > 0 THEN least(1.0::DOUBLE, x3 * 1.25::DOUBLE) ELSE x3 END)) AS score FROM s3)""")
    order = {"relevance": "score DESC", "size_desc": "size_bytes DESC", "name": "lower(filename)"}[o.sort_by]
    protected = "CASE WHEN privacy_state = 'PROTECTED' THEN '{0}' ELSE {1} END"
    return f"""{_LIB_SQL}, {', '.join(ctes)} SELECT file_id, {protected.format('[PROTECTED PATH]', 'path')} AS path, CASE WHEN privacy_state = 'PROTECTED' THEN 'Protected File' || extension ELSE filename END AS filename, round(score, 5) AS score, round(role_score, 4) AS role_score, round(lexical, 5) AS lexical, round(image, 5) AS image, date_score, category_score, format('Relevance Score: {{:.2f}}', score) AS badge,
            CASE WHEN privacy_state = 'PROTECTED' THEN 'Protected content matched search criteria' WHEN len(reasons) > 0 THEN array_to_string(reasons[1:3], ' · ') ELSE 'Matching file content' END AS explanation
        FROM s4 WHERE score > 0.05 AND privacy_state <> 'HIDDEN' ORDER BY {order}, s4.path LIMIT {o.limit}"""


def _search(name: str, sentence: str, persons: dict[str, str] | None = None, **options):
    o = S.Options(NOW, **options)

    def run(spark, sf):
        found = S.search(library(spark, sf), sentence, o, _Q[::-1], _Q)
        return found.select("file_id", "path", "filename", F.round("score", 5).alias("score"), F.round("role_score", 4).alias("role_score"), F.round("lexical", 5).alias("lexical"), F.round("image", 5).alias("image"), "date_score", "category_score", "badge", "explanation")

    run.__name__ = f"q_search_{name}"
    return query(_sql_search(sentence, o, persons or {}))(run)


_search("academic", "please find the os")
_search("visual", "photo of a man wearing red shirt in the park")
_search("general", "show me the and from november 2023")
_search("person", "certificate with customer#000000011", {"customer#000000011": "Customer#000000011"})
_search("filtered", "doc ext:pdf size:>1KB", category="document", sort_by="size_desc", limit=30)


@query(f"""{_PEOPLE}, shown AS (SELECT file_id FROM governed WHERE privacy_state <> 'HIDDEN'), l AS (SELECT DISTINCT person_id, file_id FROM links WHERE file_id IN (SELECT file_id FROM shown)) SELECT p.person_id, count(l.file_id) AS file_count, coalesce(sum(l.file_id), 0)::BIGINT AS checksum FROM persons p LEFT JOIN l USING (person_id) GROUP BY 1""")
def g4_profiles(spark, sf):
    p = people(spark, sf)
    found = G.profiles(p.persons, p.links, library(spark, sf).files, False)
    return found.select("person_id", "file_count", F.aggregate("file_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))


@query(f"""{_LIB_SQL} SELECT file_id, privacy_state = 'PROTECTED' AS is_locked, CASE WHEN privacy_state = 'PROTECTED' THEN '[PROTECTED]' ELSE extracted_text END AS extracted_text, CASE WHEN privacy_state <> 'PROTECTED' THEN description END AS description FROM lib LEFT JOIN du USING (file_id) WHERE privacy_state <> 'HIDDEN'""")
def g3_file_details(spark, sf):
    lib = library(spark, sf)
    return G.file_details(lib.files, lib.understanding, False).select("file_id", "is_locked", "extracted_text", F.col("understanding.description").alias("description"))


@query(f"{_LIB_SQL} SELECT file_id, size_bytes, CASE WHEN privacy_state = 'PROTECTED' THEN 'Protected File' || extension ELSE filename END AS filename FROM lib WHERE file_id % 5 <> 2 AND privacy_state <> 'HIDDEN' ORDER BY size_bytes DESC, file_id LIMIT 15")
def g5_o10_top_files(spark, sf):
    """The largest files that are there, hidden ones out and protected ones masked."""
    f = library(spark, sf).files
    there = f.join(f.filter("file_id % 5 <> 2").select("file_id"), "file_id", "left_semi")
    return R.top(G.masked(G.visible(there, False), False), 15, "size_bytes", "file_id").select("file_id", "size_bytes", "filename")


@query(f"""{_LIB_SQL}, changes AS (SELECT file_id, 'hidden' AS privacy_state, CAST(NULL AS VARCHAR) AS sensitivity_class, true AS manual_override FROM lib WHERE file_id % 4 = 0 AND file_id % 12 <> 0 UNION ALL SELECT file_id, 'normal', 'NONE', true FROM lib WHERE file_id % 6 = 0), old AS (SELECT file_id, privacy_state, 'OLD' AS sensitivity_class, false AS manual_override FROM lib WHERE file_id % 8 <> 1)
    SELECT file_id, coalesce(upper(c.privacy_state), o.privacy_state) AS privacy_state, coalesce(c.sensitivity_class, o.sensitivity_class) AS sensitivity_class, coalesce(c.manual_override, o.manual_override) AS manual_override FROM old o FULL JOIN changes c USING (file_id)""")
def g6_privacy_upsert(spark, sf):
    f = library(spark, sf).files
    old = f.filter("file_id % 8 <> 1").select("file_id", "privacy_state", F.lit("OLD").alias("sensitivity_class"), F.lit(False).alias("manual_override"))
    one = f.filter("file_id % 4 = 0").select("file_id", F.lit("hidden").alias("privacy_state"), F.lit(None).cast("string").alias("sensitivity_class"), F.lit(True).alias("manual_override"), F.lit(1).alias("updated_at"))
    two = f.filter("file_id % 6 = 0").select("file_id", F.lit("normal").alias("privacy_state"), F.lit("NONE").alias("sensitivity_class"), F.lit(True).alias("manual_override"), F.lit(2).alias("updated_at"))
    return G.upsert_privacy(old, one.unionByName(two))
