"""Derived columns, filters, merges and roll-ups over the file catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import any_of


def _case(ext: Column, table: dict[str, list[str]], other: str) -> Column:
    out = None
    for label, exts in table.items():
        hit = F.lower(ext).isin(exts)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(other)


def video_label(name: Column, size: Column) -> Column:
    tag = F.regexp_extract(name, rf"(?i)\b({V.MOVIE_TAGS})\b", 1)
    return F.when((size >= V.MOVIE_BYTES) | (tag != ""), F.concat(F.lit("Movie ("), F.when(tag != "", F.upper(tag)).otherwise("HD"), F.lit(")"))).otherwise("Video Clip")


def type_label(ext: Column, name: Column, size: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in V.FILE_LABELS.items() for x in kv])
    plain = F.coalesce(F.try_element_at(known, F.lower(ext)), F.concat(F.upper(F.regexp_replace(ext, r"^\.+", "")), F.lit(" File")))
    return F.when(F.lower(ext).isin(V.VIDEO), video_label(name, size)).otherwise(plain)


def category(ext: Column) -> Column:
    return _case(ext, V.EXT_CATEGORY, "Other")


def in_category(ext: Column, name: str) -> Column:
    exts = V.FILTER_CATEGORY.get(name.capitalize())
    return F.lit(True) if exts is None else F.lower(ext).isin(exts)


def category_counts(files: DataFrame) -> DataFrame:
    """Files per filter category; a file may count in two."""
    member = F.filter(F.array(*[F.when(in_category(F.col("extension"), c), F.lit(c)) for c in V.FILTER_CATEGORY]), lambda x: x.isNotNull())
    return files.select(F.explode(member).alias("category")).groupBy("category").agg(F.count("*").alias("n_files"))


def taxonomy(text: Column, ext: Column, sensitivity: Column) -> tuple[Column, Column]:
    """(category, document type) by the first rule that holds."""
    has = lambda *w: reduce(lambda a, b: a | b, [text.contains(x) for x in w])
    ids = F.when(has("aadhaar", "uidai"), "Aadhaar Card").when(has("pan", "income tax"), "PAN Card").when(has("passport"), "Passport").when(has("voter", "election"), "Voter ID").when(has("driving", "licence", "license"), "Driving License").otherwise("Identity Document")
    bank = F.when(has("statement"), "Bank Statement").when(has("salary", "payslip"), "Salary Slip").when(has("tax", "itr"), "Tax Return").otherwise("Financial Record")
    rules = [
        (sensitivity == "ID_DOCUMENT", F.lit("IDs & Documents"), ids),
        (sensitivity == "BANKING_FINANCE", F.lit("Banking & Finance"), bank),
        (F.lower(ext).isin(V.IMAGES), F.lit("Personal Photos"), F.lit("Photo")),
        (any_of(text, V.EDUCATION_WORDS), F.lit("Education"), F.lit("Academic Document")),
        (any_of(text, V.WORK_WORDS), F.lit("Work"), F.lit("Work Document")),
        (any_of(text, V.TRAVEL_WORDS), F.lit("Travel"), F.lit("Travel Document")),
        (F.lower(ext).isin(".pdf", ".docx", ".doc", ".txt", ".md"), F.lit("IDs & Documents"), F.lit("Document")),
    ]
    cat, kind = F, F
    for hit, c, k in rules:
        cat, kind = cat.when(hit, c), kind.when(hit, k)
    return cat.otherwise("Other"), kind.otherwise(F.upper(F.regexp_replace(ext, r"\.", "")))


def storage_totals(files: DataFrame, is_protected: Column) -> DataFrame:
    """One pass: files and bytes overall, protected, and in all but the first copy of each content."""
    first = files.groupBy("content_hash").agg(F.min("file_id").alias("first_id"))
    marked = files.join(first, "content_hash").withColumns({"p": is_protected, "d": F.col("file_id") != F.col("first_id")})
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("size_bytes"))), F.lit(0)).cast("long")
    return marked.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("bytes"), F.count_if("p").alias("n_protected"), total(F.col("p")).alias("protected_bytes"), F.count_if("d").alias("n_duplicates"), total(F.col("d")).alias("duplicate_bytes"))


def storage_by_category(files: DataFrame) -> DataFrame:
    """Two levels: per extension, then per category; empty categories do not appear."""
    per_ext = files.groupBy("extension").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"))
    return per_ext.groupBy(category(F.col("extension")).alias("category")).agg(F.sum("n").alias("n_files"), F.sum("b").alias("bytes"))


def folder_sizes(folders: DataFrame, files: DataFrame) -> DataFrame:
    sums = files.groupBy("folder_id").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("bytes"))
    return folders.join(sums, "folder_id", "left").select("folder_id", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def fast_path(listing: DataFrame, catalogue: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Listed files that must be read: new, changed in size or time, or without a hash."""
    known = catalogue.select("path", F.col("size_bytes").alias("k_size"), F.col("modified_at").alias("k_time"), "content_hash")
    same = (listing["path"] == known["path"]) & (listing["size_bytes"] == F.col("k_size")) & (F.abs(listing["modified_at"] - F.col("k_time")) < tolerance) & F.col("content_hash").isNotNull()
    return listing.join(known, same, "left_anti")


def upsert(catalogue: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """Merge: rows of ``changes`` replace or join those of ``catalogue``; status tells unchanged rows
    (same size and time keep 'indexed') from those to read again."""
    c, n = catalogue.alias("c"), changes.alias("n")
    joined = c.join(n, F.col(f"c.{key}") == F.col(f"n.{key}"), "full")
    same = F.col(f"n.{key}").isNull() | ((F.col("n.size_bytes") == F.col("c.size_bytes")) & (F.col("n.modified_at") == F.col("c.modified_at")))
    pick = lambda x: F.coalesce(F.col(f"n.{x}"), F.col(f"c.{x}")).alias(x)
    return joined.select(pick(key), pick("size_bytes"), pick("modified_at"), F.when(F.coalesce(same, F.lit(False)), "indexed").otherwise("pending_extraction").alias("status"))


def reconcile(catalogue: DataFrame, listing: DataFrame, key: str = "path") -> DataFrame:
    """Catalogue rows whose file still exists."""
    return catalogue.join(listing.select(key), key, "left_semi")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows win; of new rows with one key, one enters."""
    return old.unionByName(new.join(old, keys, "left_anti").dropDuplicates(keys))


def partial_update(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Only non-null values of ``changes`` are taken over."""
    names = [c for c in changes.columns if c != key]
    joined = rows.alias("r").join(changes.alias("u"), F.col(f"r.{key}") == F.col(f"u.{key}"), "left")
    return joined.select(*[F.coalesce(f"u.{c}", f"r.{c}").alias(c) if c in names else F.col(f"r.{c}") for c in rows.columns])


HISTORY = ["query_plan_summary", "result_count", "execution_time_ms", "searched_at"]


def history_distinct(history: DataFrame) -> DataFrame:
    """One row a sentence that is not blank: the last id, and the largest of what HISTORY names and there is."""
    rest = [F.max(c).alias(c) for c in HISTORY if c in history.columns]
    return history.filter(F.trim("query_text") != "").groupBy("query_text").agg(F.max("id").alias("last_id"), *rest)


#: Orders of file lists: recent ones, videos by size, and the lists of the user interface.
ORDERS = {
    "recent": [("modified_at", False)], "oldest": [("modified_at", True)], "size": [("size_bytes", False)], "smallest": [("size_bytes", True)],
    "az": [("filename", True)], "za": [("filename", False)], "relevance": [("score", False)],
}


def ordered(files: DataFrame, how: str, limit: int | None = None, tie: str = "file_id") -> DataFrame:
    """Files in one of ORDERS (names without regard to case), ties by ``tie``."""
    kinds = dict(files.dtypes)
    key = lambda c: F.lower(c) if kinds[c] == "string" else F.col(c)
    rows = files.orderBy(*[key(c).asc() if up else key(c).desc() for c, up in ORDERS[how]], tie)
    return rows if limit is None else rows.limit(limit)


def videos(files: DataFrame, how: str = "size", limit: int = 20) -> DataFrame:
    return ordered(files.filter(F.lower("extension").isin(V.VIDEO)), how, limit)


def shown(files: DataFrame, gallery: bool = False, category_: str | None = None, formats: list[str] = ()) -> DataFrame:
    """The filters of a list: images only, one category, some formats."""
    keep = F.lit(True)
    if gallery:
        keep = keep & in_category(F.col("extension"), "image")
    if category_ and category_.upper() != "ALL":
        keep = keep & in_category(F.col("extension"), category_)
    if formats:
        keep = keep & F.regexp_replace(F.lower("extension"), r"^\.+", "").isin([f.lower().lstrip(".") for f in formats])
    return files.filter(keep)


def api_rows(files: DataFrame) -> DataFrame:
    """Rows without nulls: empty text, zero numbers, NORMAL for the state."""
    fill = {"string": F.lit(""), "bigint": F.lit(0), "int": F.lit(0), "double": F.lit(0.0)}
    cols = {c: F.coalesce(F.col(c), F.lit("NORMAL") if c == "privacy_state" else fill[k].cast(k)) for c, k in files.dtypes if k in fill}
    return files.withColumns(cols)


def history_without_repeats(history: DataFrame, by: str = "owner") -> DataFrame:
    """Blank queries go, and those equal to the one right before (per owner, so the window is dealt out)."""
    filled = history.filter(F.trim("query_text") != "")
    last = F.lag("query_text").over(Window.partitionBy(by).orderBy("id"))
    return filled.withColumn("_last", last).filter(F.col("_last").isNull() | (F.col("_last") != F.col("query_text"))).drop("_last")


def ignored(path: Column) -> Column:
    """Paths a watcher leaves out: by a folder, the extension (what follows the last dot of a name, that
    of ``x.txt~`` being ``.txt~``), or a temporary or hidden name."""
    parts = F.split(path, r"[/\\]")
    name = F.element_at(parts, -1)
    suffix = F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))
    return F.arrays_overlap(parts, F.array(*[F.lit(x) for x in V.IGNORED_FOLDERS])) | suffix.isin(V.IGNORED_EXTENSIONS) | name.startswith("~$") | name.startswith(".")
