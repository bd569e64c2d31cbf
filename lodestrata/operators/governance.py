"""Sensitivity classes, policies, row hiding and column masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import vocabulary as V


#: Fixed words that more than one rule looks for.
CONTEXT_WORDS = ["passport", "republic of india", "card", "identity"]
WORDS = list(dict.fromkeys([*V.ID_WORDS, *V.BANKING_WORDS, *V.CONFIDENTIAL_WORDS, *CONTEXT_WORDS]))


def sensitivity(text: Column, name: Column, places: Column | None = None) -> Column:
    """ID_DOCUMENT, BANKING_FINANCE, CONFIDENTIAL or NONE; the first that holds. ``places`` are those of WORDS in
    name and text, if they are known already; else all words are looked for in one pass."""
    t = F.coalesce(text, F.lit(""))
    at = word_places(text, name) if places is None else places
    p = {k: t.rlike(v) for k, v in V.SENSITIVE_PATTERNS.items()}
    some = lambda words: P.among(at, WORDS, words)
    passport = p["passport"] & (some(["passport", "republic of india"]) > 0)
    ids = p["aadhaar"] | p["pan"] | p["voter"] | passport | ((some(V.ID_WORDS) > 0) & (some(["card", "identity"]) > 0))
    bank = some(V.BANKING_WORDS)
    return F.when(ids, "ID_DOCUMENT").when(p["card"] | p["ifsc"] | (p["account"] & (bank >= 1)) | (bank >= 3), "BANKING_FINANCE").when(some(V.CONFIDENTIAL_WORDS) > 0, "CONFIDENTIAL").otherwise("NONE")


def word_places(text: Column, name: Column) -> Column:
    return P.found(F.concat_ws(" ", F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))), WORDS)


def confidence(kind: Column) -> Column:
    return F.when(kind == "ID_DOCUMENT", 0.95).when(kind == "BANKING_FINANCE", 0.90).when(kind == "CONFIDENTIAL", 0.85).otherwise(0.0)


def state(kind: Column, protect: tuple[str, ...] = ("ID_DOCUMENT", "BANKING_FINANCE", "CONFIDENTIAL")) -> Column:
    return F.when(kind.isin(list(protect)), "PROTECTED").otherwise("NORMAL")


def apply_policy(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """``files`` has privacy_state as classified; a manual override wins."""
    o = overrides.select("file_id", F.col("privacy_state").alias("_manual"))
    return files.join(o, "file_id", "left").withColumn("privacy_state", F.coalesce("_manual", "privacy_state")).drop("_manual")


def visible(files: DataFrame, authenticated: bool, protected: str = "mask") -> DataFrame:
    """Hidden rows only for the authenticated; protected ones go too where the setting is 'hide'."""
    if authenticated:
        return files
    rows = files.filter(F.col("privacy_state") != "HIDDEN")
    return rows.filter(F.col("privacy_state") != "PROTECTED") if protected == "hide" else rows


MASK = "[PROTECTED]"


def masked(files: DataFrame, authenticated: bool, names: bool = True, metadata: bool = False) -> DataFrame:
    """Columns of protected rows replaced: texts, snippets and evidence always, names and paths with
    ``names``, entities and faces with ``metadata``; sizes and ids stay."""
    if authenticated:
        return files
    guarded = F.col("privacy_state") == "PROTECTED"
    cover = {c: F.lit(MASK) for c in ("extracted_text", "snippet", "ocr_text")}
    cover |= {c: F.lit("Protected content matched search criteria") for c in ("explanation", "match_evidence")}
    if names:
        cover |= {"filename": F.concat(F.lit("Protected File"), "extension"), "path": F.lit("[PROTECTED PATH]")}
    present = {c: F.when(guarded, v).otherwise(F.col(c)) for c, v in cover.items() if c in files.columns}
    if metadata:
        present |= {c: F.when(guarded, F.array().cast(files.schema[c].dataType)).otherwise(F.col(c)) for c in ("entities", "detected_faces", "reasons") if c in files.columns}
    return files.withColumns(present)


def flagged(files: DataFrame, authenticated: bool) -> DataFrame:
    """is_hidden, is_protected and is_locked: what a list shows beside a row."""
    state = F.col("privacy_state")
    return files.withColumns({"is_hidden": state == "HIDDEN", "is_protected": state == "PROTECTED", "is_locked": (state == "PROTECTED") & F.lit(not authenticated)})


def file_details(files: DataFrame, understanding: DataFrame, authenticated: bool, names: bool = True) -> DataFrame:
    """Files with their understanding: hidden files are not there, protected ones are masked and locked
    and keep their understanding to themselves."""
    known = understanding.select("file_id", F.struct(*[c for c in understanding.columns if c != "file_id"]).alias("understanding"))
    rows = flagged(visible(files, authenticated), authenticated).join(known, "file_id", "left")
    rows = rows.withColumn("understanding", F.when(~F.col("is_locked"), F.col("understanding")))
    return masked(rows, authenticated, names)


def profiles(persons: DataFrame, links: DataFrame, files: DataFrame, authenticated: bool) -> DataFrame:
    """(person_id, file_ids, file_count): hidden files are neither listed nor counted."""
    shown = visible(files, authenticated).select("file_id")
    listed = links.select("person_id", "file_id").distinct().join(shown, "file_id").groupBy("person_id").agg(F.array_sort(F.collect_list("file_id")).alias("file_ids"))
    none = F.array().cast(listed.schema["file_ids"].dataType)
    return persons.select("person_id").join(listed, "person_id", "left").withColumn("file_ids", F.coalesce("file_ids", none)).withColumn("file_count", F.size("file_ids").cast("long"))


def upsert_privacy(states: DataFrame, changes: DataFrame) -> DataFrame:
    """(file_id, privacy_state, sensitivity_class, manual_override): a change replaces state and override;
    a null class keeps the old one. Of several changes to a file the largest updated_at counts."""
    latest = changes.groupBy("file_id").agg(F.max_by(F.struct("privacy_state", "sensitivity_class", "manual_override"), "updated_at").alias("n"))
    both = states.alias("o").join(latest, "file_id", "full")
    return both.select("file_id", F.coalesce(F.upper("n.privacy_state"), "o.privacy_state").alias("privacy_state"), F.coalesce("n.sensitivity_class", "o.sensitivity_class").alias("sensitivity_class"), F.coalesce("n.manual_override", "o.manual_override").alias("manual_override"))


def synchronised(files: DataFrame, states: DataFrame) -> DataFrame:
    """``files`` with the states of the privacy table; files without one keep theirs."""
    s = states.select("file_id", F.col("privacy_state").alias("_state"), F.col("sensitivity_class").alias("_class"))
    joined = files.join(s, "file_id", "left").withColumn("privacy_state", F.coalesce("_state", "privacy_state", F.lit("NORMAL")))
    if "sensitivity_class" in files.columns:
        joined = joined.withColumn("sensitivity_class", F.coalesce("_class", "sensitivity_class"))
    return joined.select(files.columns)
