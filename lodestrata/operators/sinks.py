"""Sinks of the catalogue as merges: each takes the table as it is and a batch of changes and gives the
new table. Keys are unique in a result; of several changes to a key the largest ``order`` counts.
``sources.tables`` stores the results as versions, ``streaming.events.ingest`` applies them to streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count

PAGE, VECTOR, JOB = ["file_id", "page_number", "chunk_index"], ["entity_type", "entity_id", "model_name"], ["file_path"]
#: Tables whose rows belong to a file and go with it, with the column that names it.
OF_A_FILE = {"search": "file_id", "pages": "file_id", "vectors": "entity_id", "media": "file_id", "understanding": "file_id", "detections": "file_id", "links": "file_id"}


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, that with the largest ``order`` (then the largest other values)."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r")) if rest else rows.distinct()
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(rows.columns)


def merged(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert: changed keys take the change, others stay. ``changes`` may lack columns of the table;
    these keep their old values, or are null in new rows."""
    new = latest(changes, keys, order)
    both = table.alias("o").join(new.alias("n"), keys, "full")
    there = F.col(f"n.{order}").isNotNull()
    value = lambda c: F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")
    return both.select(*[F.col(c) if c in keys else value(c).alias(c) for c in table.columns])


def without(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(keys).distinct(), keys, "left_anti")


def store_texts(files: DataFrame, texts: DataFrame) -> DataFrame:
    """``texts``(file_id, extracted_text, ocr_text, at): texts are taken over and the files count as indexed."""
    new = latest(texts, ["file_id"], "at").select("file_id", F.col("extracted_text").alias("_text"), F.col("ocr_text").alias("_ocr"), F.lit(True).alias("_new"))
    joined = files.join(new, "file_id", "left")
    fresh = F.col("_new").isNotNull()
    return joined.withColumns({"extracted_text": F.when(fresh, F.col("_text")).otherwise(F.col("extracted_text")), "ocr_text": F.when(fresh, F.col("_ocr")).otherwise(F.col("ocr_text")), "status": F.when(fresh, "indexed").otherwise(F.col("status"))}).select(files.columns)


def store_pages(pages: DataFrame, new: DataFrame) -> DataFrame:
    """Pages or chunks (text, ocr_text, at) with the number of their words."""
    counted = new.withColumn("word_count", word_count(F.concat_ws(" ", "text", "ocr_text")))
    return merged(pages, counted, PAGE, "at")


def page_order() -> list[Column]:
    return [F.asc("page_number"), F.asc("chunk_index")]


def store_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors of entities by model, with their dimension; kept as they come, as queries normalise."""
    return merged(vectors, new.withColumn("dimension", F.size("vector")), VECTOR, "at")


def delete_vectors(vectors: DataFrame, entity_type: str, ids: DataFrame) -> DataFrame:
    gone = ids.select(F.lit(entity_type).alias("entity_type"), F.col("entity_id"))
    return without(vectors, gone, ["entity_type", "entity_id"])


def store_media(media: DataFrame, new: DataFrame) -> DataFrame:
    return merged(media, new, ["file_id"], "at")


def store_jobs(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Stage, status and error by path; retry counts stay."""
    return merged(jobs, new, JOB, "updated_at")


def pending(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin("pending", "in_progress"))


def failed(files: DataFrame) -> DataFrame:
    return files.filter(F.col("status") == "failed")


def store_values(values: DataFrame, new: DataFrame, keys: list[str] = ["key"], order: str = "at") -> DataFrame:  # noqa: B006
    """Settings, cached translations and the like: the last value of a key."""
    return merged(values, new, keys, order)


def translation_key(query: Column, model: Column, language: Column) -> Column:
    """Cache key of a translated query; blanks and case at its ends do not count."""
    return F.sha2(F.concat_ws("|", F.lower(F.trim(query)), model, language), 256)


def translated(queries: DataFrame, cache: DataFrame, model: str, language: str) -> DataFrame:
    """``queries``(query) with cached translations; what the cache lacks stays as it is."""
    keyed = queries.withColumn("cache_key", translation_key(F.col("query"), F.lit(model), F.lit(language)))
    found = keyed.join(cache.select("cache_key", "translated_text"), "cache_key", "left")
    return found.withColumns({"was_translated": F.col("translated_text").isNotNull(), "translated_text": F.coalesce("translated_text", "query")}).drop("cache_key")


def add_folders(folders: DataFrame, new: DataFrame) -> DataFrame:
    """New paths enter once; known ones stay as they are."""
    fresh = without(new, folders, ["path"]).dropDuplicates(["path"])
    return folders.unionByName(fresh.select(folders.columns))


def touch_folders(folders: DataFrame, scanned: DataFrame) -> DataFrame:
    """``scanned``(folder_id, last_scanned_at)."""
    new = scanned.groupBy("folder_id").agg(F.max("last_scanned_at").alias("_at"))
    return folders.join(new, "folder_id", "left").withColumn("last_scanned_at", F.coalesce("_at", "last_scanned_at")).select(folders.columns)


def remove_folders(folders: DataFrame, files: DataFrame, search: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(folders, files, search) without the folders, their files, and what full-text search has of these."""
    lost = files.join(gone.select("folder_id").distinct(), "folder_id", "left_semi").select("file_id")
    return without(folders, gone, ["folder_id"]), without(files, lost, ["file_id"]), without(search, lost, ["file_id"])


def reconcile_all(files: DataFrame, listing: DataFrame, tables: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Files that are not in ``listing``(path) go, and their rows in all ``tables`` (named as in OF_A_FILE)."""
    gone = files.join(listing.select("path").distinct(), "path", "left_anti").select("file_id")
    kept = {n: t.join(gone.withColumnRenamed("file_id", OF_A_FILE[n]), OF_A_FILE[n], "left_anti") for n, t in tables.items()}
    return without(files, gone, ["file_id"]), kept


def understanding_of(records: DataFrame, by: str = "file_id") -> DataFrame:
    """The newest record (largest id) of each file, or of each content hash: what saves a second analysis."""
    rest = [c for c in records.columns if c != by]
    newest = records.filter(F.col(by).isNotNull()).groupBy(by).agg(F.max_by(F.struct(*rest), "id").alias("r"))
    return newest.select(by, "r.*").select(records.columns)


def identities(found: DataFrame, hashes: bool = False) -> DataFrame:
    """(path, size_bytes, modified_at, content_hash): a file's identity, the hash only if asked for (so that
    the contents are not read otherwise)."""
    digest = F.sha2("content", 256) if hashes else F.lit(None).cast("string")
    return found.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").cast("double").alias("modified_at"), digest.alias("content_hash"))
