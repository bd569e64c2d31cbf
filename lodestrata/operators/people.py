"""Persons, their aliases, faces and links: changes as merges of tables, look-ups as joins.

Tables: ``persons`` (person_id, name, is_cluster, notes, avatar_file_id), ``aliases`` (person_id, alias),
``detections`` (det_id, file_id, person_id, confidence, quality, match_confidence, vector), ``references``
(person_id, source_file_id, vector, is_reference), ``links`` (person_id, file_id, link_type, confidence,
is_confirmed, notes). A change takes a table of requests, so a thousand of them cost one pass, and gives
the new tables; nothing is changed in place. Of requests that collide the smallest id or the first
name wins, as stated at each. Null keys match nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.views import checkpoints
from .entities import POSSIBLE, best_matches

LINK = ["person_id", "file_id", "link_type"]
DOCUMENT_LINKS = ["ocr", "filename", "entity"]
#: Quality from which a confirmed face becomes a reference of its person.
REFERENCE_QUALITY = 0.40


def name_key(name: Column) -> Column:
    return F.lower(F.trim(name))


@dataclass(frozen=True)
class People:
    persons: DataFrame
    aliases: DataFrame
    detections: DataFrame
    references: DataFrame
    links: DataFrame


# ---------------------------------------------------------------- look-ups


def best_faces(detections: DataFrame) -> DataFrame:
    """(person_id, primary_det_id): best by quality, then confidence, then smallest id."""
    best = F.max_by("det_id", F.struct("quality", "confidence", -F.col("det_id")))
    return detections.filter("person_id is not null").groupBy("person_id").agg(best.alias("primary_det_id"))


def visible_links(links: DataFrame, files: DataFrame, private: bool) -> DataFrame:
    """Links whose file is not hidden (all of them in the private scope); links of no file go."""
    shown = files if private else files.filter(F.col("privacy_state") != "HIDDEN")
    return links.join(shown.select("file_id"), "file_id", "left_semi")


def list_persons(p: People, files: DataFrame, clusters: bool = True, private: bool = False) -> DataFrame:
    """(person_id, name, is_cluster, n_photos, n_documents, n_files, aliases, primary_det_id)."""
    shown = visible_links(p.links, files, private)
    kind = F.col("link_type")
    counts = shown.groupBy("person_id").agg(
        F.count_distinct(F.when(kind == "face", F.col("file_id"))).alias("n_photos"),
        F.count_distinct(F.when(kind.isin(DOCUMENT_LINKS), F.col("file_id"))).alias("n_documents"),
        F.count_distinct("file_id").alias("n_files"),
    )
    names = p.aliases.groupBy("person_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    rows = p.persons if clusters else p.persons.filter(~F.col("is_cluster"))
    joined = rows.join(counts, "person_id", "left").join(names, "person_id", "left").join(best_faces(p.detections), "person_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_photos", "n_documents", "n_files")]
    return joined.select("person_id", "name", "is_cluster", *zero, F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "primary_det_id")


def list_order() -> list[Column]:
    """Named persons before clusters, names without regard to case, then id."""
    return [F.col("is_cluster").asc(), F.lower("name").asc(), F.col("person_id").asc()]


def find_persons(p: People, wanted: DataFrame) -> DataFrame:
    """(wanted, person_id): the smallest id that has ``wanted(wanted)`` as name or alias, case and outer
    blanks aside. Both kinds of name are one column, so this is an equi-join, not an OR."""
    named = p.persons.select("person_id", "name").union(p.aliases.select("person_id", "alias")).select("person_id", F.lower("name").alias("_key"))
    asked = wanted.select("wanted", name_key(F.col("wanted")).alias("_key")).distinct()
    return asked.join(named, "_key").groupBy("wanted").agg(F.min("person_id").alias("person_id"))


def person_files(p: People, files: DataFrame, private: bool = False) -> DataFrame:
    """Every person's files with the link; order by ``person_file_order``."""
    shown = files if private else files.filter(F.col("privacy_state") != "HIDDEN")
    return p.links.select(*LINK, "confidence", "is_confirmed").join(shown, "file_id")


def person_file_order() -> list[Column]:
    return [F.desc("is_confirmed"), F.desc("confidence"), F.desc("file_id")]


def file_persons(p: People) -> DataFrame:
    return p.links.select(*LINK, "confidence", "is_confirmed").join(p.persons.select("person_id", "name", "is_cluster"), "person_id")


def known_references(p: People) -> DataFrame:
    """References of persons with a name; those of clusters suggest nobody."""
    return p.references.join(p.persons.filter(~F.col("is_cluster")).select("person_id", "name"), "person_id")


def file_faces(p: People) -> DataFrame:
    """Detections with their person and whether the face link of this person and file is confirmed."""
    face = p.links.filter("link_type = 'face'").select("person_id", "file_id", F.col("is_confirmed").alias("link_confirmed"))
    persons = p.persons.select("person_id", F.col("name").alias("person_name"), "is_cluster")
    return p.detections.join(persons, "person_id", "left").join(face, ["person_id", "file_id"], "left")


def review_queue(p: People, files: DataFrame) -> DataFrame:
    """Faces to look at: without a person, of a cluster, or with an unconfirmed link; order by ``review_order``."""
    rows = file_faces(p).join(files.select("file_id", "filename", "path", "privacy_state"), "file_id")
    return rows.filter(F.col("person_id").isNull() | F.col("is_cluster") | ~F.col("link_confirmed"))


def review_order() -> list[Column]:
    """Faces without a person first, then the best ones."""
    return [F.when(F.col("person_id").isNull(), 0).otherwise(1), F.desc("quality"), F.desc("confidence"), F.desc("det_id")]


def unassigned_faces(p: People, files: DataFrame) -> DataFrame:
    return p.detections.filter("person_id is null").join(files.select("file_id", "filename", "path"), "file_id")


def suggestions(p: People, possible: float = POSSIBLE) -> DataFrame:
    """(det_id, person_id, similarity): the best named person of faces without one, from ``possible`` on;
    faces that were rejected (match confidence 0) get none."""
    open_ = p.detections.filter(F.col("person_id").isNull() & (F.coalesce("match_confidence", F.lit(1.0)) > 0))
    known = known_references(p).select("person_id", F.col("vector").alias("ref_vector"))
    found = best_matches(open_.select("det_id", F.col("vector").alias("det_vector")), known)
    return found.filter(F.col("best") >= possible).select("det_id", "person_id", F.round("best", 3).alias("similarity"))


# ---------------------------------------------------------------- changes


def merged_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """On conflict the larger confidence and confirmation stay, and the newer notes unless they are empty."""
    both = links.select(*LINK, "confidence", "is_confirmed", "notes", F.lit(0).alias("_new")).unionByName(new.select(*LINK, "confidence", "is_confirmed", "notes", F.lit(1).alias("_new")))
    notes = F.max_by("notes", F.when(F.coalesce(F.col("notes"), F.lit("")) != "", F.col("_new")).otherwise(-1))
    return both.groupBy(*LINK).agg(F.max("confidence").alias("confidence"), F.max("is_confirmed").alias("is_confirmed"), notes.alias("notes"))


def create_persons(p: People, new: DataFrame) -> People:
    """``new``(name, aliases, notes, avatar_file_id, is_cluster). A name that a person has (trimmed, case
    aside) is that person: notes are appended, a missing avatar is filled, aliases are added. Other
    names get ids after the largest, in the order of the names; clusters always get new ids."""
    own = p.persons.filter(~F.col("is_cluster")).groupBy(name_key(F.col("name")).alias("_key")).agg(F.min("person_id").alias("person_id"))
    asked = new.withColumn("_key", F.when(~F.col("is_cluster"), name_key(F.col("name"))))
    known = asked.join(own, "_key", "left")
    top = p.persons.agg(F.coalesce(F.max("person_id"), F.lit(0)).alias("top"))
    fresh = known.filter("person_id is null").withColumn("_one", F.coalesce("_key", F.concat(F.lit("cluster "), F.col("name"))))
    named = fresh.select("_one").distinct().withColumn("_n", F.row_number().over(Window.orderBy("_one")))  # the requests only
    fresh = fresh.join(named, "_one").join(F.broadcast(top)).withColumn("person_id", (F.col("top") + F.col("_n")).cast(p.persons.schema["person_id"].dataType))
    whole = known.filter("person_id is not null").unionByName(fresh.select(known.columns))
    first = whole.groupBy("person_id").agg(F.min(F.trim("name")).alias("name"), F.max("is_cluster").alias("is_cluster"), F.array_join(F.array_sort(F.collect_set(F.when(F.trim("notes") != "", F.col("notes")))), "\n").alias("notes"), F.min("avatar_file_id").alias("avatar_file_id"))
    both = p.persons.alias("o").join(first.alias("n"), "person_id", "full")
    notes = F.concat_ws("\n", F.when(F.coalesce("o.notes", F.lit("")) != "", F.col("o.notes")), F.when(F.coalesce("n.notes", F.lit("")) != "", F.col("n.notes")))
    persons = both.select("person_id", F.coalesce("o.name", "n.name").alias("name"), F.coalesce("o.is_cluster", "n.is_cluster").alias("is_cluster"), notes.alias("notes"), F.coalesce("o.avatar_file_id", "n.avatar_file_id").alias("avatar_file_id"))
    more = whole.select("person_id", F.explode("aliases").alias("alias"), F.col("name").alias("_own"))
    more = more.filter(name_key(F.col("alias")) != name_key(F.col("_own"))).select("person_id", "alias")
    return replace(p, persons=persons, aliases=add_aliases(p, more).aliases)


def add_aliases(p: People, new: DataFrame) -> People:
    clean = new.select("person_id", F.trim("alias").alias("alias")).filter("alias <> ''")
    return replace(p, aliases=p.aliases.select("person_id", "alias").unionByName(clean).distinct())


def remove_aliases(p: People, gone: DataFrame) -> People:
    return replace(p, aliases=p.aliases.join(gone.select("person_id", F.trim("alias").alias("alias")), ["person_id", "alias"], "left_anti"))


def update_persons(p: People, changes: DataFrame) -> People:
    """Non-null values of ``changes`` (person_id and any of name, notes, avatar_file_id, is_cluster) are taken over."""
    names = [c for c in changes.columns if c != "person_id"]
    joined = p.persons.alias("o").join(changes.alias("n"), "person_id", "left")
    value = lambda c: F.trim(f"n.{c}") if c == "name" else F.col(f"n.{c}")
    return replace(p, persons=joined.select("person_id", *[F.coalesce(value(c), f"o.{c}").alias(c) if c in names else F.col(f"o.{c}") for c in p.persons.columns if c != "person_id"]))


def delete_persons(p: People, gone: DataFrame) -> People:
    """Identity, aliases, references and links go; faces stay without a person, files stay."""
    keep = lambda t: t.join(gone.select("person_id"), "person_id", "left_anti")
    marked = p.detections.join(gone.select("person_id", F.lit(True).alias("_gone")).distinct(), "person_id", "left")
    freed = marked.withColumn("person_id", F.when(F.col("_gone").isNull(), F.col("person_id"))).select(p.detections.columns)
    return People(keep(p.persons), keep(p.aliases), freed, keep(p.references), keep(p.links))


def merge_roots(pairs: DataFrame) -> DataFrame:
    """(source, target) with every target a person that stays. A source with several targets takes the smallest.
    Chains are followed to their end by pointer jumping, in as many rounds as the logarithm of the number of
    pairs at most; of a cycle the smallest id stays, and all that leads into it goes there."""
    checkpoints(pairs.sparkSession)
    step = pairs.filter("source <> target").groupBy("source").agg(F.min("target").alias("target")).checkpoint()
    sources = step.select(F.col("source").alias("target"), F.lit(True).alias("_on"))
    # low: the smallest id that the pointer has passed, both ends included
    jump = step.select("source", "target", F.least("source", "target").alias("low"))
    for _ in range(step.count().bit_length()):
        ahead = jump.select(F.col("source").alias("target"), F.col("target").alias("_t"), F.col("low").alias("_l"))
        jump = jump.join(ahead, "target", "left").select("source", F.coalesce("_t", "target").alias("target"), F.least("low", F.coalesce("_l", "low")).alias("low")).checkpoint()
        if jump.join(sources, "target", "left_semi").isEmpty():  # all pointers stand on persons that stay
            break
    # a pointer that stands on a source now is in a cycle, which that source's own pointer has passed whole
    cycle = jump.select(F.col("source").alias("target"), F.col("low").alias("_c"))
    return jump.join(cycle, "target", "left").select("source", F.coalesce("_c", "target").alias("target")).filter("source <> target")


def merge_persons(p: People, pairs: DataFrame) -> People:
    """``pairs``(source, target): aliases, references, faces and links go over, the source's name becomes
    an alias, and the source goes. Chains and cycles are resolved first (``merge_roots``), so nothing is left
    with a person that is gone; targets that are no persons are left alone with their sources."""
    known = p.persons.select(F.col("person_id").alias("target"))
    pairs = merge_roots(pairs.select("source", "target").join(known, "target", "left_semi"))
    kind = p.persons.schema["person_id"].dataType

    def moved(t: DataFrame) -> DataFrame:
        met = t.join(pairs.withColumnRenamed("source", "person_id"), "person_id", "left")
        return met.withColumn("person_id", F.coalesce("target", "person_id").cast(kind)).select(t.columns)

    named = p.persons.join(pairs.withColumnRenamed("source", "person_id"), "person_id").select(F.col("target").cast(kind).alias("person_id"), F.col("name").alias("alias"))
    aliases = moved(p.aliases).unionByName(named).distinct()
    persons = p.persons.join(pairs.select(F.col("source").alias("person_id")), "person_id", "left_anti")
    links = moved(p.links)
    return People(persons, aliases, moved(p.detections), moved(p.references), merged_links(links.limit(0), links))


def split_person(p: People, person_id: int, name: str, det_ids: list[int] = (), file_ids: list[int] = ()) -> People:
    """The stated faces and file links of a person go to the (new or known) person called ``name``."""
    spark = p.persons.sparkSession
    made = create_persons(p, spark.createDataFrame([(name, [], "", None, False)], "name string, aliases array<string>, notes string, avatar_file_id long, is_cluster boolean"))
    found = F.broadcast(find_persons(made, spark.createDataFrame([(name,)], "wanted string")).select(F.col("person_id").alias("_to")))  # one row

    def moved(t: DataFrame, picked: Column) -> DataFrame:
        return t.join(found).withColumn("person_id", F.when((F.col("person_id") == person_id) & picked, F.col("_to")).otherwise(F.col("person_id"))).select(t.columns)

    links = moved(p.links, F.col("file_id").isin(list(file_ids)))
    return replace(made, detections=moved(p.detections, F.col("det_id").isin(list(det_ids))), links=merged_links(links.limit(0), links))


def name_clusters(p: People, names: DataFrame) -> People:
    """``names``(person_id, name): a cluster takes the name, or merges into the person that has it."""
    asked = names.select("person_id", F.trim("name").alias("_name"), name_key(F.col("name")).alias("_key"))
    own = p.persons.filter(~F.col("is_cluster")).groupBy(name_key(F.col("name")).alias("_key")).agg(F.min("person_id").alias("target"))
    met = asked.join(own, "_key", "left").filter("target is null or target <> person_id")
    fresh = met.filter("target is null").select("person_id", F.col("_name").alias("name"), F.lit(False).alias("is_cluster"))
    named = update_persons(p, fresh)
    merged = merge_persons(named, met.filter("target is not null").select(F.col("person_id").alias("source"), "target"))
    return replace(merged, aliases=p.aliases)  # a cluster's label is no alias


def _assigned(p: People, changes: DataFrame) -> DataFrame:
    """Detections with the person and match confidence of ``changes``(det_id, to_person, to_confidence)."""
    met = p.detections.join(changes.dropDuplicates(["det_id"]), "det_id", "left")
    hit = F.col("to_confidence").isNotNull()
    return met.withColumn("person_id", F.when(hit, F.col("to_person")).otherwise(F.col("person_id"))).withColumn("match_confidence", F.when(hit, F.col("to_confidence")).otherwise(F.col("match_confidence"))).select(p.detections.columns)


def assign_faces(p: People, assigned: DataFrame, notes: str = "Manual face assignment") -> People:
    """``assigned``(det_id, person_id, match_confidence): one face each; its file gets a confirmed link."""
    kind = p.detections.schema["person_id"].dataType
    changes = assigned.select("det_id", F.col("person_id").cast(kind).alias("to_person"), F.col("match_confidence").cast("double").alias("to_confidence"))
    new = p.detections.select("det_id", "file_id").join(changes, "det_id").select(F.col("to_person").alias("person_id"), "file_id", F.lit("face").alias("link_type"), F.col("to_confidence").alias("confidence"), F.lit(True).alias("is_confirmed"), F.lit(notes).alias("notes"))
    return replace(p, detections=_assigned(p, changes), links=merged_links(p.links, new))


def add_references(p: People, chosen: DataFrame) -> People:
    """``chosen``(det_id, person_id): the faces' vectors become references of the persons."""
    rows = p.detections.select("det_id", F.col("file_id").alias("source_file_id"), "vector").join(chosen.select("det_id", "person_id"), "det_id").filter("vector is not null")
    new = rows.select("person_id", "source_file_id", "vector", F.lit(True).alias("is_reference"))
    return replace(p, references=p.references.select(new.columns).unionByName(new))


def confirm_faces(p: People, confirmed: DataFrame) -> People:
    """``confirmed``(det_id, person_id or null): the given person, else the face's own, else the suggested
    one; faces with none stay as they are. Good faces of named persons become references."""
    asked = confirmed.select("det_id", F.col("person_id").alias("_given"))
    guess = suggestions(p).select("det_id", F.col("person_id").alias("_guess"))
    rows = p.detections.join(asked, "det_id").join(guess, "det_id", "left").withColumn("person_id", F.coalesce("_given", "person_id", "_guess")).filter("person_id is not null")
    done = assign_faces(p, rows.select("det_id", "person_id", F.lit(1.0).alias("match_confidence")), "Confirmed match")
    named = p.persons.filter(~F.col("is_cluster")).select("person_id")
    good = rows.filter(F.coalesce("quality", F.lit(0.0)) >= REFERENCE_QUALITY).join(named, "person_id", "left_semi")
    return replace(done, references=add_references(p, good).references)


def reject_faces(p: People, rejected: DataFrame) -> People:
    """``rejected``(det_id): the faces lose their person for good (match confidence 0, no suggestion); a
    face link goes when no other face of the person is in the file."""
    kind = p.detections.schema["person_id"].dataType
    left = _assigned(p, rejected.select("det_id", F.lit(None).cast(kind).alias("to_person"), F.lit(0.0).alias("to_confidence")))
    before = p.detections.join(rejected.select("det_id"), "det_id", "left_semi").filter("person_id is not null").select("person_id", "file_id").distinct()
    bare = before.join(left.select("person_id", "file_id"), ["person_id", "file_id"], "left_anti").withColumn("link_type", F.lit("face"))
    return replace(p, detections=left, links=p.links.join(bare, LINK, "left_anti"))


def create_from_detections(p: People, new: DataFrame) -> People:
    """``new``(det_id, name, notes): a person each, with the face as reference and the file as avatar."""
    rows = new.join(p.detections.select("det_id", F.col("file_id").alias("avatar_file_id")), "det_id")
    made = create_persons(p, rows.select("name", F.array().cast("array<string>").alias("aliases"), "notes", "avatar_file_id", F.lit(False).alias("is_cluster")))
    ids = find_persons(made, rows.select(F.col("name").alias("wanted")))
    chosen = rows.join(ids, F.col("name") == F.col("wanted")).select("det_id", "person_id", F.lit(1.0).alias("match_confidence"))
    return assign_faces(add_references(made, chosen), chosen)


def dominant_faces(detections: DataFrame) -> DataFrame:
    """(file_id, det_id): the largest face of a photograph, the smallest id among equals."""
    return detections.groupBy("file_id").agg(F.max_by("det_id", F.struct(F.col("w") * F.col("h"), -F.col("det_id"))).alias("det_id"))


def rebuild_links(p: People) -> People:
    """Face links anew from the faces that have a person; other links stay."""
    made = p.detections.filter("person_id is not null").groupBy("person_id", "file_id").agg(F.max("confidence").alias("confidence"))
    new = made.select("person_id", "file_id", F.lit("face").alias("link_type"), "confidence", F.lit(True).alias("is_confirmed"), F.lit("Rebuilt from face detections").alias("notes"))
    return replace(p, links=merged_links(p.links.filter("link_type <> 'face'"), new))


def drop_missing_files(p: People, listing: DataFrame) -> People:
    """Faces and face links of files that are not in ``listing``(file_id) any more go."""
    there = listing.select("file_id")
    faces = p.links.filter("link_type = 'face'").join(there, "file_id", "left_semi")
    return replace(p, detections=p.detections.join(there, "file_id", "left_semi"), links=p.links.filter("link_type <> 'face'").unionByName(faces.select(p.links.columns)))


def cluster_persons(p: People, groups: DataFrame, least: int = 2, confidence: float = 0.48) -> People:
    """``groups``(det_id, component) of faces without a person: components of ``least`` faces or more
    become clusters 'Unknown Person n', numbered after those there are, by their smallest face."""
    sized = groups.groupBy("component").agg(F.count("*").alias("n"), F.min("det_id").alias("lead")).filter(F.col("n") >= least)
    have = p.persons.agg(F.count_if("is_cluster").alias("have"), F.coalesce(F.max("person_id"), F.lit(0)).alias("top"))
    place = F.row_number().over(Window.orderBy("lead"))  # a row for each new cluster
    numbered = sized.withColumn("_n", place).join(F.broadcast(have))
    kind = p.persons.schema["person_id"].dataType
    named = numbered.select("component", "lead", (F.col("top") + F.col("_n")).cast(kind).alias("person_id"), F.concat(F.lit("Unknown Person "), (F.col("have") + F.col("_n")).cast("string")).alias("name"))
    avatars = p.detections.select(F.col("det_id").alias("lead"), F.col("file_id").alias("avatar_file_id"))
    persons = named.join(avatars, "lead", "left").select("person_id", "name", F.lit(True).alias("is_cluster"), F.lit("").alias("notes"), "avatar_file_id")
    members = groups.join(named.select("component", "person_id"), "component").select("det_id", "person_id", F.lit(confidence).alias("match_confidence"))
    grown = replace(p, persons=p.persons.select(persons.columns).unionByName(persons))
    return assign_faces(add_references(grown, members), members)


# ---------------------------------------------------------------- geometry


def usable_face(d: str = "") -> Column:
    """Filters of a detection: size, shape, share of the image, eyes, nose between eyes and mouth, sharpness.
    Columns (of struct ``d`` or bare): w, h, image_w, image_h, right_eye_x ... left_mouth_y, sharpness."""
    c = lambda n: F.col(f"{d}.{n}" if d else n)
    ratio = F.when(c("w") > 0, c("h") / c("w")).otherwise(0.0)
    eyes = F.hypot(c("left_eye_x") - c("right_eye_x"), c("left_eye_y") - c("right_eye_y"))
    eye_line, mouth_line = (c("right_eye_y") + c("left_eye_y")) / 2, (c("right_mouth_y") + c("left_mouth_y")) / 2
    return (
        (c("w") >= 28)
        & (c("h") >= 28)
        & ratio.between(0.55, 2.0)
        & (c("w") * c("h") / (c("image_w") * c("image_h")) >= 0.00015)
        & (eyes >= 5.0)
        & c("nose_y").between(eye_line - 8.0, mouth_line + 12.0)
        & (c("sharpness") >= 2.0)
    )


def face_quality(confidence: Column, sharpness: Column, width: Column, height: Column) -> Column:
    """Confidence, sharpness and size as one number."""
    one = F.lit(1.0)
    return F.round(0.40 * confidence + 0.35 * F.least(one, sharpness / 120.0) + 0.25 * F.least(one, F.least(width, height) / 112.0), 3)


def normal_boxes(rows: DataFrame) -> DataFrame:
    """norm_x, norm_y, norm_w, norm_h as shares of the image, null where its size is not known."""
    sized = (F.col("image_w") > 0) & (F.col("image_h") > 0)
    share = lambda c, of: F.when(sized, F.round(F.col(c) / F.col(of), 4))
    return rows.withColumns({"norm_x": share("x", "image_w"), "norm_y": share("y", "image_h"), "norm_w": share("w", "image_w"), "norm_h": share("h", "image_h")})
