"""Queries of the person operators over persons, aliases, faces and links derived from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import people as P
from ..sources.views import FILES_SQL, files, table
from .catalogue import _shared, E
from .registry import query

_STATE = "CASE WHEN file_id % 11 = 0 THEN 'HIDDEN' WHEN file_id % 13 = 0 THEN 'PROTECTED' ELSE 'NORMAL' END"
_TYPES = ["face", "ocr", "filename", "entity"]
_WITH = f"""WITH {FILES_SQL}, governed AS (SELECT *, {_STATE} AS privacy_state FROM files),
    persons AS (SELECT c_custkey AS person_id, c_name AS name, c_custkey % 5 = 0 AS is_cluster, c_mktsegment AS notes, CAST(NULL AS BIGINT) AS avatar_file_id FROM customer),
    aliases AS (SELECT c_custkey AS person_id, 'C' || c_custkey AS alias FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'Z' || (c_custkey % 7) FROM customer WHERE c_custkey % 6 = 0),
    detections AS (SELECT o_orderkey AS det_id, o_orderkey % 97 AS file_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS person_id, round(o_totalprice / 1000000, 6) AS confidence, (o_orderkey % 100) / 100.0::DOUBLE AS quality,
        CASE WHEN o_orderkey % 8 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS match_confidence, [(o_orderkey % 7 - 3)::DOUBLE, (o_orderkey % 5 - 2)::DOUBLE] AS vector FROM orders),
    refs AS (SELECT c_custkey AS person_id, c_custkey % 97 AS source_file_id, [(c_custkey % 7 - 3)::DOUBLE, (c_custkey % 5 - 2)::DOUBLE] AS vector FROM customer WHERE c_custkey % 50 = 1 OR c_custkey % 50 = 5),
    links AS (SELECT o_custkey AS person_id, o_orderkey % 97 AS file_id, list_extract({_TYPES}, CAST(o_orderkey % 4 + 1 AS BIGINT)) AS link_type, max(round(o_totalprice / 1000000, 6)) AS confidence, bool_or(o_orderstatus = 'F') AS is_confirmed FROM orders GROUP BY 1, 2, 3)"""


def governed(spark, sf):
    return files(spark, sf).withColumn("privacy_state", F.expr(_STATE))


def people(spark, sf) -> P.People:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    persons = c.select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 5 == 0).alias("is_cluster"), F.col("c_mktsegment").alias("notes"), F.lit(None).cast("long").alias("avatar_file_id"))
    aliases = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("person_id"), F.concat(F.lit("C"), "c_custkey").alias("alias")).union(c.filter("c_custkey % 6 = 0").select("c_custkey", F.concat(F.lit("Z"), F.col("c_custkey") % 7)))
    vector = lambda k: F.array((F.col(k) % 7 - 3).cast("double"), (F.col(k) % 5 - 2).cast("double"))
    confidence = F.round(F.col("o_totalprice") / 1000000, 6)
    detections = o.select(
        F.col("o_orderkey").alias("det_id"),
        (F.col("o_orderkey") % 97).alias("file_id"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("person_id"),
        confidence.alias("confidence"),
        (F.col("o_orderkey") % 100 / 100.0).alias("quality"),
        F.when(F.col("o_orderkey") % 8 == 0, 0.0).otherwise(1.0).alias("match_confidence"),
        vector("o_orderkey").alias("vector"),
    )
    references = c.filter("c_custkey % 50 in (1, 5)").select(F.col("c_custkey").alias("person_id"), (F.col("c_custkey") % 97).alias("source_file_id"), vector("c_custkey").alias("vector"), F.lit(True).alias("is_reference"))
    kind = F.element_at(F.array(*[F.lit(x) for x in _TYPES]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    links = o.groupBy(F.col("o_custkey").alias("person_id"), (F.col("o_orderkey") % 97).alias("file_id"), kind.alias("link_type")).agg(F.max(confidence).alias("confidence"), F.max(F.col("o_orderstatus") == "F").alias("is_confirmed"))
    return P.People(persons, aliases, detections, references, links.withColumn("notes", F.lit("")))


_BEST = "(SELECT person_id, max_by(det_id, (quality, confidence, -det_id)) AS primary_det_id FROM detections WHERE person_id IS NOT NULL GROUP BY 1)"
_LISTED = f"""listed AS (SELECT p.person_id, p.name, p.is_cluster, count(DISTINCT v.file_id) FILTER (link_type = 'face') AS n_photos, count(DISTINCT v.file_id) FILTER (link_type <> 'face') AS n_documents, count(DISTINCT v.file_id) AS n_files
    FROM persons p LEFT JOIN (SELECT l.* FROM links l JOIN governed g USING (file_id) WHERE g.privacy_state <> 'HIDDEN') v USING (person_id) GROUP BY 1, 2, 3)"""


@query(f"{_WITH}, {_LISTED} SELECT listed.*, array_to_string(coalesce(a.names, []), '|') AS aliases, primary_det_id FROM listed LEFT JOIN (SELECT person_id, list_sort(list(DISTINCT alias)) AS names FROM aliases GROUP BY 1) a USING (person_id) LEFT JOIN {_BEST} b USING (person_id)")
def j4_person_list(spark, sf):
    """Persons with counts of visible photographs and documents, aliases and best face."""
    return P.list_persons(people(spark, sf), governed(spark, sf)).withColumn("aliases", F.array_join("aliases", "|"))


@query(f"{_WITH}, {_LISTED} SELECT person_id, name, is_cluster FROM listed ORDER BY is_cluster, lower(name), person_id LIMIT 40")
def o7_person_order(spark, sf):
    return P.list_persons(people(spark, sf), governed(spark, sf)).orderBy(*P.list_order()).limit(40).select("person_id", "name", "is_cluster")


_WANTED = "SELECT DISTINCT ' ' || upper(c_name) || ' ' AS wanted FROM customer WHERE c_custkey % 4 = 0 UNION SELECT 'z' || (c_custkey % 9) FROM customer UNION SELECT 'nobody ' || c_mktsegment FROM customer"


@query(f"{_WITH}, w AS ({_WANTED}), n AS (SELECT person_id, lower(name) AS k FROM persons UNION ALL SELECT person_id, lower(alias) FROM aliases) SELECT wanted, min(person_id) AS person_id FROM w JOIN n ON lower(trim(wanted)) = k GROUP BY 1")
def j5_find_persons(spark, sf):
    c = table(spark, sf, "customer")
    wanted = c.filter("c_custkey % 4 = 0").select(F.concat(F.lit(" "), F.upper("c_name"), F.lit(" ")).alias("wanted"))
    wanted = wanted.union(c.select(F.concat(F.lit("z"), F.col("c_custkey") % 9))).union(c.select(F.concat(F.lit("nobody "), "c_mktsegment")))
    return P.find_persons(people(spark, sf), wanted)


_FACES = "faces AS (SELECT d.*, p.name AS person_name, p.is_cluster, l.is_confirmed AS link_confirmed FROM detections d LEFT JOIN persons p USING (person_id) LEFT JOIN links l ON l.person_id = d.person_id AND l.file_id = d.file_id AND l.link_type = 'face')"


@query(f"{_WITH}, {_FACES} SELECT det_id, file_id, person_id, person_name, is_cluster, link_confirmed FROM faces")
def j6_j7_file_faces(spark, sf):
    return P.file_faces(people(spark, sf)).select("det_id", "file_id", "person_id", "person_name", "is_cluster", "link_confirmed")


@query(f"{_WITH}, {_FACES} SELECT det_id, path, privacy_state, person_id, is_cluster, link_confirmed FROM faces JOIN governed USING (file_id) WHERE person_id IS NULL OR is_cluster OR NOT link_confirmed")
def f16_review_queue(spark, sf):
    return P.review_queue(people(spark, sf), governed(spark, sf)).select("det_id", "path", "privacy_state", "person_id", "is_cluster", "link_confirmed")


@query(f"{_WITH}, {_FACES} SELECT det_id FROM faces JOIN governed USING (file_id) WHERE person_id IS NULL OR is_cluster OR NOT link_confirmed ORDER BY CASE WHEN person_id IS NULL THEN 0 ELSE 1 END, quality DESC, confidence DESC, det_id DESC LIMIT 150")
def o8_review_order(spark, sf):
    return P.review_queue(people(spark, sf), governed(spark, sf)).orderBy(*P.review_order()).limit(150).select("det_id")


@query(f"{_WITH} SELECT det_id, filename FROM detections JOIN governed USING (file_id) WHERE person_id IS NULL")
def j6_unassigned_faces(spark, sf):
    return P.unassigned_faces(people(spark, sf), governed(spark, sf)).select("det_id", "filename")


@query(f"{_WITH} SELECT person_id, name, source_file_id, vector[1] AS x, vector[2] AS y FROM refs JOIN persons USING (person_id) WHERE NOT is_cluster")
def j8_known_references(spark, sf):
    return P.known_references(people(spark, sf)).select("person_id", "name", "source_file_id", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"))


@query(f"{_WITH} SELECT person_id, file_id, link_type, confidence, is_confirmed, path FROM links JOIN governed USING (file_id) WHERE privacy_state <> 'HIDDEN'")
def j9_person_files(spark, sf):
    return P.person_files(people(spark, sf), governed(spark, sf)).select("person_id", "file_id", "link_type", "confidence", "is_confirmed", "path")


@query(f"{_WITH} SELECT file_id, person_id, name, link_type, confidence FROM links JOIN persons USING (person_id)")
def j9_file_persons(spark, sf):
    return P.file_persons(people(spark, sf)).select("file_id", "person_id", "name", "link_type", "confidence")


_UNIT = "[{0}[1] / sqrt({0}[1] * {0}[1] + {0}[2] * {0}[2]), {0}[2] / sqrt({0}[1] * {0}[1] + {0}[2] * {0}[2])]"
_GUESS = f"""open AS (SELECT det_id, {_UNIT.format('vector')} AS v FROM detections WHERE person_id IS NULL AND match_confidence > 0 AND (vector[1] <> 0 OR vector[2] <> 0)),
    known AS (SELECT person_id, {_UNIT.format('vector')} AS v FROM refs JOIN persons USING (person_id) WHERE NOT is_cluster AND (vector[1] <> 0 OR vector[2] <> 0)),
    sims AS (SELECT det_id, person_id, max(o.v[1] * k.v[1] + o.v[2] * k.v[2]) AS sim FROM open o, known k GROUP BY 1, 2)"""


@query(f"{_WITH}, {_GUESS} SELECT det_id, round(max(sim), 3) AS similarity FROM sims GROUP BY 1 HAVING max(sim) >= 0.42")
def r23_suggestions(spark, sf):
    """Of persons that are equally near (the vectors are few) any may stand, so only the similarity is compared."""
    return P.suggestions(people(spark, sf)).select("det_id", "similarity")


_FACE_LINKS = "SELECT person_id, file_id, 'face' AS link_type, max(confidence) AS confidence, true AS is_confirmed FROM detections WHERE person_id IS NOT NULL GROUP BY 1, 2"


@query(f"{_WITH} SELECT person_id, file_id, link_type, confidence, is_confirmed FROM links WHERE link_type <> 'face' UNION ALL {_FACE_LINKS}")
def r26_rebuild_links(spark, sf):
    return P.rebuild_links(people(spark, sf)).links.select("person_id", "file_id", "link_type", "confidence", "is_confirmed")


@query(f"{_WITH}, f AS (SELECT file_id FROM files WHERE file_id % 3 <> 0) SELECT det_id FROM detections WHERE file_id IN (SELECT file_id FROM f)")
def j12_faces_of_files(spark, sf):
    """Faces of files that are still there."""
    return P.drop_missing_files(people(spark, sf), files(spark, sf).filter("file_id % 3 <> 0")).detections.select("det_id")


@query(f"""{_WITH}, asked AS (SELECT trim(name) AS name, lower(trim(name)) AS k FROM (SELECT '  ' || upper(c_name) AS name FROM customer WHERE c_custkey % 20 = 0 UNION ALL SELECT upper(c_name) FROM customer WHERE c_custkey % 20 = 1 UNION ALL SELECT 'New ' || c_mktsegment FROM customer)),
    own AS (SELECT lower(trim(name)) AS k, min(person_id) AS person_id FROM persons WHERE NOT is_cluster GROUP BY 1), fresh AS (SELECT k, min(name) AS name FROM asked WHERE k NOT IN (SELECT k FROM own) GROUP BY 1)
    SELECT person_id, name FROM persons UNION ALL SELECT (SELECT max(person_id) FROM persons) + row_number() OVER (ORDER BY k), name FROM fresh""")
def e_create_persons(spark, sf):
    """Requests for persons there are, for names of clusters, and for new names, several of each."""
    c = table(spark, sf, "customer")
    names = c.filter("c_custkey % 20 = 0").select(F.concat(F.lit("  "), F.upper("c_name")).alias("name")).union(c.filter("c_custkey % 20 = 1").select(F.upper("c_name"))).union(c.select(F.concat(F.lit("New "), "c_mktsegment")))
    new = names.select("name", F.array().cast("array<string>").alias("aliases"), F.lit("").alias("notes"), F.lit(None).cast("long").alias("avatar_file_id"), F.lit(False).alias("is_cluster"))
    return P.create_persons(people(spark, sf), new).persons.select("person_id", "name")


_PAIRS = "pairs AS (SELECT person_id AS source, person_id - 1 AS target FROM persons WHERE person_id % 10 = 7)"


@query(f"""{_WITH}, {_PAIRS}, moved AS (SELECT coalesce(target, person_id) AS person_id, file_id, link_type, confidence, is_confirmed FROM links LEFT JOIN pairs ON source = person_id)
    SELECT person_id, file_id, link_type, max(confidence) AS confidence, bool_or(is_confirmed) AS is_confirmed FROM moved GROUP BY 1, 2, 3""")
def e_merge_links(spark, sf):
    return _merged(spark, sf).links.select("person_id", "file_id", "link_type", "confidence", "is_confirmed")


def _merged(spark, sf) -> P.People:
    p = people(spark, sf)
    return P.merge_persons(p, p.persons.filter("person_id % 10 = 7").select(F.col("person_id").alias("source"), (F.col("person_id") - 1).alias("target")))


_CHAINS = """pairs AS (SELECT person_id AS source, CASE person_id % 10 WHEN 2 THEN person_id + 1 ELSE person_id - 1 END AS target FROM persons WHERE person_id % 10 IN (2, 3, 6, 7, 8)),
    steps AS (SELECT * FROM pairs WHERE target IN (SELECT person_id FROM persons)), walk(source, reached) AS (SELECT source, target FROM steps UNION SELECT w.source, s.target FROM walk w JOIN steps s ON s.source = w.reached),
    roots AS (SELECT * FROM (SELECT source, coalesce(min(reached) FILTER (reached NOT IN (SELECT source FROM steps)), min(reached)) AS target FROM walk GROUP BY 1) WHERE source <> target)"""


@query(f"""{_WITH.replace('WITH', 'WITH RECURSIVE', 1)}, {_CHAINS}, moved AS (SELECT coalesce(target, person_id) AS person_id, file_id, link_type, confidence, is_confirmed FROM links LEFT JOIN roots ON source = person_id)
    SELECT person_id, file_id, link_type, max(confidence) AS confidence, bool_or(is_confirmed) AS is_confirmed FROM moved GROUP BY 1, 2, 3""")
def e_merge_chains(spark, sf):
    """Chains of three merges and cycles of two: every link ends at a person that stays."""
    p = people(spark, sf)
    asked = p.persons.filter("person_id % 10 in (2, 3, 6, 7, 8)").select(F.col("person_id").alias("source"), F.when(F.col("person_id") % 10 == 2, F.col("person_id") + 1).otherwise(F.col("person_id") - 1).alias("target"))
    return P.merge_persons(p, asked).links.select("person_id", "file_id", "link_type", "confidence", "is_confirmed")


@query(f"{_WITH}, {_PAIRS} SELECT DISTINCT coalesce(target, person_id) AS person_id, alias FROM aliases LEFT JOIN pairs ON source = person_id UNION SELECT target, name FROM persons JOIN pairs ON source = person_id")
def e_merge_aliases(spark, sf):
    return _merged(spark, sf).aliases


@query(f"{_WITH} SELECT det_id, CASE WHEN person_id % 9 <> 0 THEN person_id END AS person_id FROM detections")
def e_delete_persons(spark, sf):
    p = people(spark, sf)
    return P.delete_persons(p, p.persons.filter("person_id % 9 = 0")).detections.select("det_id", "person_id")


@query(f"{_WITH} SELECT person_id, CASE WHEN person_id % 8 = 0 THEN 'Renamed ' || person_id ELSE name END AS name, CASE WHEN person_id % 8 = 0 THEN false ELSE is_cluster END AS is_cluster, notes FROM persons")
def e_update_persons(spark, sf):
    p = people(spark, sf)
    changes = p.persons.filter("person_id % 8 = 0").select("person_id", F.concat(F.lit("  Renamed "), "person_id", F.lit(" ")).alias("name"), F.lit(False).alias("is_cluster"), F.lit(None).cast("string").alias("notes"))
    return P.update_persons(p, changes).persons.select("person_id", "name", "is_cluster", "notes")


@query(f"{_WITH} SELECT DISTINCT person_id, alias FROM aliases WHERE NOT (person_id % 9 = 0 AND alias = 'C' || person_id) UNION SELECT person_id, 'nick' FROM persons WHERE person_id % 4 = 0")
def e_aliases(spark, sf):
    p = people(spark, sf)
    some = p.persons.filter("person_id % 9 = 0").select("person_id", F.concat(F.lit(" C"), "person_id").alias("alias"))
    more = p.persons.filter("person_id % 4 = 0").select("person_id", F.explode(F.array(F.lit(" nick "), F.lit("nick"), F.lit(" "))).alias("alias"))
    return P.add_aliases(P.remove_aliases(p, some), more).aliases


@query(f"{_WITH}, l AS (SELECT CASE WHEN person_id = 11 AND file_id IN (3, 5, 7, 8, 13) THEN (SELECT max(person_id) + 1 FROM persons) ELSE person_id END AS person_id, file_id, link_type FROM links) SELECT DISTINCT person_id, file_id, link_type FROM l")
def e_split_person(spark, sf):
    return P.split_person(people(spark, sf), 11, "Somebody Else", file_ids=[3, 5, 7, 8, 13]).links.select("person_id", "file_id", "link_type")


@query(f"""{_WITH}, asked AS (SELECT person_id, CASE WHEN person_id % 3 = 0 THEN 'Named ' || person_id ELSE 'Customer#' || lpad(CAST(person_id + 1 AS VARCHAR), 9, '0') END AS name FROM persons WHERE is_cluster AND person_id % 10 = 0)
    , own AS (SELECT lower(trim(name)) AS k, min(person_id) AS target FROM persons WHERE NOT is_cluster GROUP BY 1), met AS (SELECT a.*, target FROM asked a LEFT JOIN own ON k = lower(a.name))
    SELECT person_id, coalesce(m.name, p.name) AS name, CASE WHEN m.name IS NULL THEN is_cluster ELSE false END AS is_cluster FROM persons p LEFT JOIN met m USING (person_id) WHERE target IS NULL""")
def e_name_clusters(spark, sf):
    p = people(spark, sf)
    k = F.col("person_id")
    asked = p.persons.filter("is_cluster and person_id % 10 = 0").select("person_id", F.when(k % 3 == 0, F.concat(F.lit("Named "), k)).otherwise(F.concat(F.lit(" Customer#"), F.lpad((k + 1).cast("string"), 9, "0"))).alias("name"))
    return P.name_clusters(p, asked).persons.select("person_id", "name", "is_cluster")


@query(f"""{_WITH}, asked AS (SELECT det_id, file_id, person_id, 1 + det_id % 100 AS target FROM detections WHERE det_id % 6 = 0), new AS (SELECT target AS person_id, file_id, 'face' AS link_type, 0.9::DOUBLE AS confidence, true AS is_confirmed FROM asked)
    SELECT person_id, file_id, link_type, max(confidence) AS confidence, bool_or(is_confirmed) AS is_confirmed FROM (SELECT person_id, file_id, link_type, confidence, is_confirmed FROM links UNION ALL SELECT * FROM new) GROUP BY 1, 2, 3""")
def e_assign_faces(spark, sf):
    p = people(spark, sf)
    asked = p.detections.filter("det_id % 6 = 0").select("det_id", (F.col("det_id") % 100 + 1).alias("person_id"), F.lit(0.9).alias("match_confidence"))
    return P.assign_faces(p, asked).links.select("person_id", "file_id", "link_type", "confidence", "is_confirmed")


@query(f"""{_WITH}, left_over AS (SELECT det_id, file_id, CASE WHEN det_id % 5 <> 1 THEN person_id END AS person_id FROM detections), gone AS (SELECT DISTINCT person_id, file_id FROM detections WHERE det_id % 5 = 1 AND person_id IS NOT NULL EXCEPT SELECT person_id, file_id FROM left_over)
    SELECT l.person_id, l.file_id, link_type FROM links l LEFT JOIN gone g ON g.person_id = l.person_id AND g.file_id = l.file_id AND link_type = 'face' WHERE g.person_id IS NULL""")
def e_reject_faces(spark, sf):
    p = people(spark, sf)
    return P.reject_faces(p, p.detections.filter("det_id % 5 = 1").select("det_id")).links.select("person_id", "file_id", "link_type")


@query(f"{_WITH} SELECT det_id, person_id, CASE WHEN det_id % 7 = 3 THEN 1.0 ELSE match_confidence END::DOUBLE AS match_confidence FROM detections WHERE person_id IS NOT NULL")
def e_confirm_faces(spark, sf):
    """Faces that have a person; those without one depend on the suggestion (tested by example)."""
    p = people(spark, sf)
    asked = p.detections.filter("det_id % 7 = 3 and person_id is not null").select("det_id", F.lit(None).cast("long").alias("person_id"))
    return P.confirm_faces(p, asked).detections.filter("det_id % 4 <> 0").select("det_id", "person_id", "match_confidence")


@query(f"""{_WITH}, made AS (SELECT 'Face ' || det_id AS name, lower('Face ' || det_id) AS k FROM detections WHERE det_id % 97 = 5) SELECT (SELECT max(person_id) FROM persons) + row_number() OVER (ORDER BY k) AS person_id, name FROM made""")
def e_create_from_detections(spark, sf):
    p = people(spark, sf)
    new = p.detections.filter("det_id % 97 = 5").select("det_id", F.concat(F.lit("Face "), "det_id").alias("name"), F.lit("").alias("notes"))
    made = P.create_from_detections(p, new)
    return made.persons.filter("name like 'Face %'").select("person_id", "name")


# ---------------------------------------------------------------- geometry

_BOXES = """boxes AS (SELECT l_orderkey * 10 + l_linenumber AS det_id, l_suppkey AS file_id, l_quantity * 2 AS w, l_quantity * (0.4 + l_discount * 20) AS h, (l_partkey % 3) * 900.0::DOUBLE AS image_w, 700.0::DOUBLE AS image_h, l_partkey % 50 + 0.5 AS x, l_suppkey % 40 + 0.25 AS y,
    10.0::DOUBLE AS right_eye_x, 20.0 + l_tax * 100 AS right_eye_y, 10.0 + l_quantity / 5 AS left_eye_x, 20.0::DOUBLE AS left_eye_y, 22.0 + l_discount * 300 AS nose_y, 40.0::DOUBLE AS right_mouth_y, 41.0::DOUBLE AS left_mouth_y, l_tax * 100 AS sharpness, l_discount * 10 AS confidence FROM lineitem)"""


def boxes(spark, sf):
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    cols = {
        "det_id": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "file_id": F.col("l_suppkey"), "w": q * 2, "h": q * (F.lit(0.4) + d * 20), "image_w": (F.col("l_partkey") % 3) * 900.0, "image_h": F.lit(700.0), "x": F.col("l_partkey") % 50 + 0.5, "y": F.col("l_suppkey") % 40 + 0.25,
        "right_eye_x": F.lit(10.0), "right_eye_y": F.lit(20.0) + t * 100, "left_eye_x": F.lit(10.0) + q / 5, "left_eye_y": F.lit(20.0), "nose_y": F.lit(22.0) + d * 300, "right_mouth_y": F.lit(40.0), "left_mouth_y": F.lit(41.0), "sharpness": t * 100, "confidence": d * 10,
    }
    return table(spark, sf, "lineitem").select(*[c.alias(n) for n, c in cols.items()])


@query(f"""WITH {_BOXES} SELECT det_id FROM boxes WHERE w >= 28 AND h >= 28 AND h / w BETWEEN 0.55 AND 2.0 AND image_w > 0 AND w * h / (image_w * image_h) >= 0.00015 AND sqrt((left_eye_x - right_eye_x) ** 2 + (left_eye_y - right_eye_y) ** 2) >= 5.0
    AND nose_y BETWEEN (right_eye_y + left_eye_y) / 2 - 8 AND (right_mouth_y + left_mouth_y) / 2 + 12 AND sharpness >= 2.0""")
def f13_face_geometry(spark, sf):
    return boxes(spark, sf).filter("image_w > 0").filter(P.usable_face()).select("det_id")


@query(f"WITH {_BOXES} SELECT det_id, round(0.40::DOUBLE * confidence + 0.35::DOUBLE * least(1.0::DOUBLE, sharpness / 120.0::DOUBLE) + 0.25::DOUBLE * least(1.0::DOUBLE, least(w, h) / 112.0::DOUBLE) + 1e-9, 3) AS quality FROM boxes")
def p16_face_quality(spark, sf):
    c = F.col
    return boxes(spark, sf).select("det_id", P.face_quality(c("confidence") + 2.5e-9, c("sharpness"), c("w"), c("h")).alias("quality"))


@query(f"WITH {_BOXES} SELECT det_id, {', '.join(f'CASE WHEN image_w > 0 THEN round({c} / {of}, 4) END AS norm_{c}' for c, of in (('x', 'image_w'), ('y', 'image_h'), ('w', 'image_w'), ('h', 'image_h')))} FROM boxes")
def p13_normal_boxes(spark, sf):
    return P.normal_boxes(boxes(spark, sf)).select("det_id", "norm_x", "norm_y", "norm_w", "norm_h")


@query(f"WITH {_BOXES} SELECT file_id, max_by(det_id, (w * h, -det_id)) AS det_id FROM boxes GROUP BY 1")
def e_dominant_faces(spark, sf):
    return P.dominant_faces(boxes(spark, sf))


@query("""WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) >= 0.4), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    reach(node, other) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM reach r JOIN u ON u.a = r.other), g AS (SELECT node, min(other) AS component FROM reach GROUP BY 1), s AS (SELECT component, count(*) AS n, min(node) AS lead FROM g GROUP BY 1 HAVING count(*) >= 2)
    SELECT 'Unknown Person ' || (row_number() OVER (ORDER BY lead) + (SELECT count(*) FROM customer WHERE c_custkey % 5 = 0)) AS name, n AS n_faces, lead % 97 AS avatar_file_id FROM s""")
def r25_cluster_persons(spark, sf):
    """Clusters of similar faces become persons with a number for a name."""
    _shared(spark)
    p = people(spark, sf)
    v = table(spark, sf, "embeddings")
    faces = v.select(F.col("vec_id").alias("det_id"), (F.col("vec_id") % 97).alias("file_id"), F.lit(None).cast("long").alias("person_id"), F.lit(1.0).alias("confidence"), F.lit(1.0).alias("quality"), F.lit(1.0).alias("match_confidence"), F.col("embedding").cast("array<double>").alias("vector"))
    groups = E.components(E.similar_links(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 0.4)).select(F.col("node").alias("det_id"), "component")
    made = P.cluster_persons(P.People(p.persons, p.aliases, faces, p.references, p.links), groups)
    sizes = made.detections.filter("person_id is not null").groupBy("person_id").agg(F.count("*").alias("n_faces"))
    return made.persons.filter("name like 'Unknown Person %'").join(sizes, "person_id").select("name", "n_faces", "avatar_file_id")
