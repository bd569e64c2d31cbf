"""Queries of sinks, look-ups, list orders, indexes, images and sessions over tables derived from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as C
from ..operators import duplicates as D
from ..operators import extensions as X
from ..operators import metrics as M
from ..operators import retrieval as R
from ..operators import sinks as K
from ..sources.views import FILES_SQL, files, table
from ..streaming import events as S
from .catalogue import _PREFIX, _Q, _TERMS, _TOK, _sql_bm25
from .catalogue import _COS as COS
from .registry import query
from .searches import _LIB_SQL, library

_WITH = f"WITH {FILES_SQL}"


@query(f"{_WITH} SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'text ' || (2 - file_id % 2) ELSE extracted_text END AS extracted_text, CASE WHEN file_id % 3 = 0 THEN 'indexed' ELSE 'pending_extraction' END AS status FROM files")
def s13_text_sink(spark, sf):
    """Two texts for some files; the later one stays."""
    f = files(spark, sf).withColumns({"ocr_text": F.lit(None).cast("string"), "status": F.lit("pending_extraction")})
    some = f.filter("file_id % 3 = 0")
    text = lambda n, at: some.select("file_id", F.lit(f"text {n}").alias("extracted_text"), F.lit("o").alias("ocr_text"), F.when(F.col("file_id") % 2 == 0, at).otherwise(-at).alias("at"))
    return K.store_texts(f, text(1, 1).unionByName(text(2, 2))).select("file_id", "extracted_text", "status")


_PAGES = "old AS (SELECT conv_id AS file_id, turn AS page_number, 0 AS chunk_index, text FROM conversations), new AS (SELECT conv_id AS file_id, turn + 1 AS page_number, 0 AS chunk_index, role || ' ' || text AS text FROM conversations WHERE turn % 2 = 0)"
_COUNT = "len(list_filter(string_split_regex(trim({0}), '\\s+'), lambda x: x <> ''))::INTEGER"


@query(f"WITH {_PAGES} SELECT coalesce(n.file_id, o.file_id) AS file_id, coalesce(n.page_number, o.page_number) AS page_number, coalesce(n.text, o.text) AS text, CASE WHEN n.text IS NOT NULL THEN {_COUNT.format('n.text')} ELSE -1 END AS word_count FROM old o FULL JOIN new n ON o.file_id = n.file_id AND o.page_number = n.page_number")
def s14_page_sink(spark, sf):
    c = table(spark, sf, "conversations")
    page = lambda rows, shift, text, at: rows.select(F.col("conv_id").alias("file_id"), (F.col("turn") + shift).alias("page_number"), F.lit(0).alias("chunk_index"), text.alias("text"), F.lit(None).cast("string").alias("ocr_text"), F.lit(at).alias("at"))
    old = page(c, 0, F.col("text"), 0).withColumn("word_count", F.lit(-1))
    return K.store_pages(old, page(c.filter("turn % 2 = 0"), 1, F.concat_ws(" ", "role", "text"), 1)).select("file_id", "page_number", "text", "word_count")


_VECTORS = "v AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'file' ELSE 'image' END AS entity_type, vec_id // 2 AS entity_id, label AS model_no, embedding[1]::DOUBLE AS x FROM embeddings)"


def vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.when(F.col("vec_id") % 2 == 0, "file").otherwise("image").alias("entity_type"), F.expr("vec_id div 2").alias("entity_id"), F.concat(F.lit("m"), "label").alias("model_name"), F.col("embedding").alias("vector"), F.size("embedding").alias("dimension"), F.lit(0).alias("at"))


@query(f"WITH {_VECTORS} SELECT entity_type, entity_id, 'm' || model_no AS model_name, CASE WHEN entity_id % 3 = 0 THEN 7.0 ELSE x END::DOUBLE AS x, CASE WHEN entity_id % 3 = 0 THEN 2 ELSE 64 END AS dimension FROM v UNION ALL SELECT DISTINCT entity_type, entity_id, 'new', 7.0::DOUBLE, 2 FROM v WHERE entity_id % 5 = 0")
def s15_vector_upsert(spark, sf):
    v = vectors(spark, sf)
    two = F.array(F.lit(7.0), F.lit(1.0)).cast("array<float>")
    new = v.filter("entity_id % 3 = 0").unionByName(v.filter("entity_id % 5 = 0").withColumn("model_name", F.lit("new"))).withColumns({"vector": two, "at": F.lit(1)}).drop("dimension")
    return K.store_vectors(v, new).select("entity_type", "entity_id", "model_name", F.col("vector")[0].cast("double").alias("x"), "dimension")


@query(f"WITH {_VECTORS} SELECT entity_type, entity_id FROM v WHERE NOT (entity_type = 'file' AND entity_id % 4 = 1)")
def s16_vector_delete(spark, sf):
    v = vectors(spark, sf)
    return K.delete_vectors(v, "file", v.filter("entity_id % 4 = 1").select("entity_id")).select("entity_type", "entity_id")


@query("""WITH m AS (SELECT o_custkey AS file_id, max_by(o_orderpriority, o_orderkey) AS codec FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1), o AS (SELECT c_custkey AS file_id, c_mktsegment AS codec, 25 AS fps FROM customer WHERE c_custkey % 3 = 0)
    SELECT coalesce(m.file_id, o.file_id) AS file_id, coalesce(m.codec, o.codec) AS codec, o.fps FROM o FULL JOIN m ON o.file_id = m.file_id""")
def s18_media_sink(spark, sf):
    """Changes without all columns: what they lack stays, and is null for new files."""
    old = table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("file_id"), F.col("c_mktsegment").alias("codec"), F.lit(25).alias("fps"), F.lit(0).cast("long").alias("at"))
    new = table(spark, sf, "orders").filter("o_custkey % 2 = 0").select(F.col("o_custkey").alias("file_id"), F.col("o_orderpriority").alias("codec"), F.col("o_orderkey").cast("long").alias("at"))
    return K.store_media(old, new).select("file_id", "codec", "fps")


@query("WITH j AS (SELECT 'f' || user_id AS file_path, max_by(event_type, (ts, event_type)) AS stage FROM events GROUP BY 1) SELECT file_path, stage, 3 AS retry_count FROM j WHERE stage IN ('error', 'view')")
def s19_f15_pending_jobs(spark, sf):
    """The last stage of every job; those that are to go on."""
    e = table(spark, sf, "events")
    path = F.concat(F.lit("f"), "user_id")
    jobs = e.select(path.alias("file_path")).distinct().withColumns({"stage": F.lit("discovered"), "status": F.lit("done"), "retry_count": F.lit(3), "updated_at": F.lit("2000-01-01").cast("timestamp")})
    status = F.when(F.col("event_type") == "error", "pending").when(F.col("event_type") == "view", "in_progress").otherwise("done")
    new = e.select(path.alias("file_path"), F.col("event_type").alias("stage"), status.alias("status"), F.col("ts").alias("updated_at"))
    return K.pending(K.store_jobs(jobs, new)).select("file_path", "stage", "retry_count")


@query("SELECT event_type AS key, max_by(value, (ts, value)) AS value FROM events GROUP BY 1 UNION ALL SELECT 'other', 1.5")
def s23_settings(spark, sf):
    e = table(spark, sf, "events")
    old = spark.createDataFrame([("other", 1.5), ("view", -1.0)], "key string, value double").withColumn("at", F.lit("2000-01-01").cast("timestamp"))
    return K.store_values(old, e.select(F.col("event_type").alias("key"), "value", F.col("ts").alias("at"))).select("key", "value")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'kunde ' || c_custkey ELSE c_name END AS translated_text, c_custkey % 2 = 0 AS was_translated FROM customer")
def qk_translation_cache(spark, sf):
    c = table(spark, sf, "customer")
    cache = c.filter("c_custkey % 2 = 0").select(K.translation_key(F.upper("c_name"), F.lit("m1"), F.lit("en")).alias("cache_key"), F.concat(F.lit("kunde "), "c_custkey").alias("translated_text"))
    return K.translated(c.select("c_custkey", F.col("c_name").alias("query")), cache, "m1", "en").select("c_custkey", "translated_text", "was_translated")


@query(f"{_WITH}, f AS (SELECT folder_id, '/' || source AS path, NULL::DOUBLE AS at FROM files GROUP BY 1, 2) SELECT path, CASE WHEN folder_id % 3 = 0 THEN 9.0 END::DOUBLE AS last_scanned_at FROM f UNION ALL SELECT DISTINCT '/new' || (folder_id % 4), NULL::DOUBLE FROM f")
def s21_folders(spark, sf):
    f = files(spark, sf).select("folder_id", F.concat(F.lit("/"), "source").alias("path")).distinct().withColumn("last_scanned_at", F.lit(None).cast("double"))
    new = f.withColumn("path", F.concat(F.lit("/new"), F.col("folder_id") % 4)).union(f).withColumn("folder_id", F.lit(-1))
    scanned = f.filter("folder_id % 3 = 0").select("folder_id", F.explode(F.array(F.lit(5.0), F.lit(9.0))).alias("last_scanned_at"))
    return K.touch_folders(K.add_folders(f, new), scanned).select("path", "last_scanned_at")


@query(f"{_WITH} SELECT file_id, 'file' AS kind FROM files WHERE folder_id % 4 <> 1 UNION ALL SELECT file_id, 'search' FROM files WHERE folder_id % 4 <> 1 AND file_id % 2 = 0")
def s21_remove_folders(spark, sf):
    f = files(spark, sf)
    gone = f.select("folder_id").distinct().filter("folder_id % 4 = 1")
    _, kept, search = K.remove_folders(gone, f, f.filter("file_id % 2 = 0").select("file_id"), gone)
    return kept.select("file_id", F.lit("file").alias("kind")).union(search.select("file_id", F.lit("search")))


@query(f"{_WITH}, k AS (SELECT file_id FROM files WHERE file_id % 7 <> 3) SELECT 'files' AS name, count(*) AS n FROM k UNION ALL SELECT 'pages', count(*) FROM conversations WHERE conv_id IN (SELECT file_id FROM k) OR conv_id NOT IN (SELECT file_id FROM files) UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id IN (SELECT file_id FROM k) OR vec_id NOT IN (SELECT file_id FROM files)")
def s22_reconcile_tables(spark, sf):
    f = files(spark, sf)
    tables = {"pages": table(spark, sf, "conversations").select(F.col("conv_id").alias("file_id")), "vectors": table(spark, sf, "embeddings").select(F.col("vec_id").alias("entity_id"))}
    kept, rest = K.reconcile_all(f, f.filter("file_id % 7 <> 3"), tables)
    count = lambda name, t: t.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return count("files", kept).union(count("pages", rest["pages"])).union(count("vectors", rest["vectors"]))


@query(f"{_WITH}, r AS (SELECT o_orderkey AS id, o_custkey % 50 AS file_id, sha256(o_orderpriority || (o_custkey % 9)) AS content_hash, o_orderpriority AS document_type FROM orders) SELECT 'file' AS by_key, CAST(file_id AS VARCHAR) AS k, max(id) AS id, max_by(document_type, id) AS document_type FROM r GROUP BY file_id UNION ALL SELECT 'hash', content_hash, max(id), max_by(document_type, id) FROM r GROUP BY content_hash")
def l_understanding_lookup(spark, sf):
    o = table(spark, sf, "orders")
    r = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("file_id"), F.sha2(F.concat("o_orderpriority", F.col("o_custkey") % 9), 256).alias("content_hash"), F.col("o_orderpriority").alias("document_type"))
    one = K.understanding_of(r).select(F.lit("file").alias("by_key"), F.col("file_id").cast("string").alias("k"), "id", "document_type")
    return one.union(K.understanding_of(r, "content_hash").select(F.lit("hash"), "content_hash", "id", "document_type"))


# ---------------------------------------------------------------- lists


@query(f"{_WITH} SELECT content_hash, file_id, path, row_number() OVER (PARTITION BY content_hash ORDER BY file_id) AS place FROM files QUALIFY count(*) OVER (PARTITION BY content_hash) > 1")
def a6_duplicate_members(spark, sf):
    return D.group_members(files(spark, sf)).select("content_hash", "file_id", "path", F.col("place").cast("long").alias("place"))


def _ordered(how: str, sql: str):
    def run(spark, sf):
        return C.ordered(files(spark, sf).withColumn("score", F.col("file_id") % 10 / 10.0), how, 25).select("file_id", "filename", "size_bytes")

    run.__name__ = f"o5_o6_order_{how}"
    return query(f"{_WITH} SELECT file_id, filename, size_bytes FROM files ORDER BY {sql}, file_id LIMIT 25")(run)


for _how, _sql in {"recent": "modified_at DESC", "oldest": "modified_at", "size": "size_bytes DESC", "smallest": "size_bytes", "az": "lower(filename)", "za": "lower(filename) DESC", "relevance": "file_id % 10 DESC"}.items():
    _ordered(_how, _sql)


@query(f"{_WITH} SELECT file_id FROM files WHERE lower(extension) IN ('.jpg', '.png') AND ltrim(lower(extension), '.') IN ('png', 'pdf')")
def f18_f5_list_filters(spark, sf):
    return C.shown(files(spark, sf), gallery=True, category_="image", formats=["PNG", ".pdf"]).select("file_id")


@query(f"{_WITH} SELECT file_id, coalesce(CASE WHEN file_id % 2 = 0 THEN extracted_text END, '') AS extracted_text, coalesce(CASE WHEN file_id % 3 = 0 THEN size_bytes END, 0) AS size_bytes, 'NORMAL' AS privacy_state FROM files")
def p12_api_rows(spark, sf):
    f = files(spark, sf)
    return C.api_rows(f.select("file_id", F.when(F.col("file_id") % 2 == 0, F.col("extracted_text")).alias("extracted_text"), F.when(F.col("file_id") % 3 == 0, F.col("size_bytes")).alias("size_bytes"), F.lit(None).cast("string").alias("privacy_state")))


@query("WITH h AS (SELECT conv_id * 1000 + turn AS id, text AS query_text, length(text) AS result_count, turn AS execution_time_ms, role AS query_plan_summary FROM conversations) SELECT query_text, max(id) AS last_id, max(query_plan_summary) AS query_plan_summary, max(result_count) AS result_count, max(execution_time_ms) AS execution_time_ms FROM h WHERE trim(query_text) <> '' GROUP BY 1")
def a7_history_columns(spark, sf):
    c = table(spark, sf, "conversations")
    return C.history_distinct(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("query_text"), F.length("text").cast("long").alias("result_count"), F.col("turn").alias("execution_time_ms"), F.col("role").alias("query_plan_summary")))


@query("WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT max(value) FILTER (r = floor(n * 0.5::DOUBLE)) AS p50, max(value) FILTER (r = floor(n * 0.95::DOUBLE)) AS p95, max(value) FILTER (r = floor(n * 0.99::DOUBLE)) AS p99 FROM s")
def a13_index_percentiles(spark, sf):
    return M.index_percentiles(table(spark, sf, "events"), "value")


@query(f"{_LIB_SQL} SELECT file_id FROM lib WHERE ocr_text IS NOT NULL AND contains(lower(ocr_text), 'en')")
def r4_ocr_credit(spark, sf):
    """Files whose OCR text a word hits: they get credit for it."""
    return library(spark, sf).files.filter(F.lower("ocr_text").contains("en")).select("file_id")


# ---------------------------------------------------------------- index, vectors, images


def _index(spark, sf) -> str:
    """The stored index of the documents, made once an application."""
    from .catalogue import _shared

    _shared(spark)
    base = spark.sparkContext.getCheckpointDir().rstrip("/")
    folder = f"{base}/index/{spark.sparkContext.applicationId}/{abs(hash(sf)):x}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/corpus/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        R.write_index(table(spark, sf, "documents"), "doc_id", "text", folder)
    return folder


@query(f"WITH {_sql_bm25(_TERMS, _PREFIX)} SELECT id, round(score, 6) AS score FROM b")
def r2_bm25_indexed(spark, sf):
    """BM25 over the stored postings; reads the buckets of its terms."""
    return R.bm25_indexed(spark, _index(spark, sf), _TERMS, _PREFIX).withColumn("score", F.round("score", 6))


@query(f"WITH w AS (SELECT doc_id AS id, unnest({_TOK.format('text')}) AS term FROM documents) SELECT id, term, count(*) AS tf FROM w GROUP BY 1, 2")
def r2_postings(spark, sf):
    return R.postings(table(spark, sf, "documents"), "doc_id", "text").select("id", "term", "tf")


@query(f"SELECT vec_id AS id, round({COS.format('embedding', str(_Q))}, 5) AS score FROM embeddings WHERE label = 3 AND vec_id % 2 = 1 AND {COS.format('embedding', str(_Q))} >= 0.02 ORDER BY {COS.format('embedding', str(_Q))} DESC, vec_id LIMIT 15")
def x2_vector_store(spark, sf):
    v = vectors(spark, sf).withColumn("entity_id", F.when(F.col("entity_type") == "file", F.col("entity_id") * 2).otherwise(F.col("entity_id") * 2 + 1))
    return X.VectorStore(v).query(_Q, "m3", 15, 0.02, lambda i: i % 2 == 1).withColumn("score", F.round("score", 5))


@query()
def x1_embedded_texts(spark, sf):
    """A vector for every text by the embedder that needs no model (tested against its own function)."""
    return table(spark, sf, "documents").select("doc_id", X.HashedWords().column(F.col("text")).alias("vector"))


@query()
def p7_perceptual_hashes(spark, sf):
    """Hashes of 32 x 32 images made of the vectors (tested against a plain transform)."""
    v = table(spark, sf, "embeddings")
    pixels = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: F.transform("embedding", lambda x: x.cast("double") * k)))
    return X.perceptual_hashes(v.select("vec_id", pixels.alias("pixels"))).select("vec_id", "phash", "hash")


# ---------------------------------------------------------------- sessions


@query("""WITH g AS (SELECT user_id AS token, epoch(ts) AS ts, event_type = 'purchase' AS revoked FROM events WHERE event_type IN ('signup', 'purchase')), c AS (SELECT event_id AS check_id, user_id AS token, epoch(ts) AS ts FROM events WHERE event_type = 'view'),
    l AS (SELECT check_id, max_by({'t': g.ts, 'r': g.revoked}, (g.ts, g.revoked)) AS last FROM c JOIN g ON g.token = c.token AND g.ts <= c.ts GROUP BY 1) SELECT c.check_id, coalesce(NOT last.r AND c.ts <= last.t + 86400, false) AS valid FROM c LEFT JOIN l USING (check_id)""")
def t7_sessions(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("token"), F.col("ts").cast("timestamp").cast("double").alias("ts"), "event_type")
    grants = e.filter("event_type in ('signup', 'purchase')").select("token", "ts", (F.col("event_type") == "purchase").alias("revoked"))
    return S.session_checks(grants, e.filter("event_type = 'view'").select("token", "ts", F.col("event_id").alias("check_id")), 86400.0).select("check_id", "valid")


@query()
def t7_attempt_outcomes(spark, sf):
    """Lockouts of users by their errors (a state machine in time; tested by example)."""
    e = table(spark, sf, "events").filter("event_type in ('error', 'signup')")
    return S.attempt_outcomes(e.select("event_id", "user_id", F.col("ts").cast("timestamp").cast("double").alias("ts"), (F.col("event_type") == "signup").alias("ok")), "user_id", "ts", "ok", failures=3, within=200_000.0, locked=100_000.0)
