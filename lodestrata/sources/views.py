"""Inputs: the catalogue of files and the other logical tables, derived from the Parquet tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = [".pdf", ".docx", ".txt", ".jpg", ".png", ".mp4", ".mp3", ".xlsx", ".pptx", ".py"]


def checkpoints(spark: SparkSession) -> None:
    """Checkpoints go where the cluster says; only in local mode, where that is unset, to a folder of our own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestrata-"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(x) for x in EXTENSIONS]), (F.col("doc_id") % 10 + 1).cast("int"))
    d = d.select(F.col("doc_id").alias("file_id"), F.substring("source", 4, 9).cast("int").alias("folder_id"), ext.alias("extension"), "source", F.col("n_chars").alias("size_bytes"), F.col("text").alias("extracted_text"), "lang")
    return d.withColumns({"filename": F.concat(F.lit("doc_"), "file_id", "extension"), "modified_at": 1700000000.0 + 3600.0 * F.col("file_id"), "content_hash": F.sha2("extracted_text", 256)}).withColumn("path", F.concat(F.lit("/"), "source", F.lit("/"), "filename"))


FILES_SQL = f"""files AS (SELECT *, '/' || source || '/' || filename AS path FROM (SELECT doc_id AS file_id, CAST(substr(source, 4) AS INTEGER) AS folder_id, source,
    list_extract({EXTENSIONS}, CAST(doc_id % 10 + 1 AS BIGINT)) AS extension, n_chars AS size_bytes, text AS extracted_text, lang,
    'doc_' || doc_id || list_extract({EXTENSIONS}, CAST(doc_id % 10 + 1 AS BIGINT)) AS filename, 1700000000.0::DOUBLE + 3600.0::DOUBLE * doc_id AS modified_at, sha256(text) AS content_hash FROM documents))"""


def read_files(spark: SparkSession, folder: str | list[str], pattern: str | None = None) -> DataFrame:
    """Recursive scan: (path, modificationTime, length, content), database files left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder).filter(~F.lower("path").rlike(r"\.(db|sqlite[^/]*)$"))


def decoded(content) -> object:
    """UTF-8 text; what is not valid UTF-8 reads as Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def docx_text(files_: DataFrame) -> DataFrame:
    """(path, text): non-blank paragraphs of .docx contents, joined by line feeds; unreadable files give null."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    def paragraphs(data: bytes) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                root = ElementTree.fromstring(z.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
        space = re.match(r"\{.*\}", root.tag).group(0) if root.tag.startswith("{") else ""
        lines = ("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))
        return "\n".join(x for x in lines if x.strip())

    def run(batches):
        for pdf in batches:
            yield pdf[["path"]].assign(text=[paragraphs(bytes(c)) for c in pdf["content"]])

    return files_.select("path", "content").mapInPandas(run, "path string, text string")
