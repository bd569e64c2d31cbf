"""Queries of indexes and tables that are changed in place, of images as pixels and of analysers' answers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import images as I
from ..operators import retrieval as R
from ..operators import understanding as U
from ..operators.postings import TextIndex
from ..operators.vector_index import VectorIndex
from ..sources.changes import moves
from ..sources.tables import KeyedTable
from ..sources.views import FILES_SQL, files, table
from . import search as S
from .catalogue import _PREFIX, _TERMS, _shared, _sql_bm25
from .catalogue import _COS as COS
from .catalogue import _Q as Q
from .registry import query
from .searches import NOW, _sql_search, library


def scratch(spark, name: str) -> str:
    """A folder of its own in the shared one."""
    _shared(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}/{uuid.uuid4().hex}"


_CHANGED = "changed AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN text || ' therefore the And' ELSE text END AS text FROM documents WHERE doc_id % 17 <> 5)"


def _changed_index(spark, sf) -> TextIndex:
    """Three quarters of the documents, then the others with new texts for a tenth, then deletions; the second
    batch comes twice and counts once; segments are merged."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    index = TextIndex(spark, scratch(spark, "text-index"))
    index.upsert(docs.filter("doc_id % 4 <> 1"), "doc_id", "text", batch=("files", 0))
    more = docs.filter("doc_id % 4 = 1 or doc_id % 10 = 3").withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit(" therefore the And"))).otherwise(F.col("text")))
    for _ in range(2):
        index.upsert(more, "doc_id", "text", batch=("files", 1))
    index.delete(docs.filter("doc_id % 17 = 5").select("doc_id"), batch=("files", 2))
    index.merge(most=1)
    return index


@query(f"WITH {_CHANGED}, {_sql_bm25(_TERMS, _PREFIX).replace('FROM documents', 'FROM changed')} SELECT id, round(score, 6) AS score FROM b")
def s13_changed_index(spark, sf):
    """All scores from an index after upserts, a replay, deletions and a merge."""
    return _changed_index(spark, sf).search(_TERMS, _PREFIX).withColumn("score", F.round("score", 6))


@query(f"WITH {_CHANGED}, {_sql_bm25(_TERMS, _PREFIX).replace('FROM documents', 'FROM changed')} SELECT id, round(score, 6) AS score FROM b WHERE id % 3 = 0 ORDER BY b.score DESC, id LIMIT 20")
def r2_bm25_top_of_index(spark, sf):
    """The 20 best among some documents, from the blocks that can hold them."""
    keep = table(spark, sf, "documents").filter("doc_id % 3 = 0").select("doc_id")
    return _changed_index(spark, sf).search(_TERMS, _PREFIX, k=20, keep=keep).withColumn("score", F.round("score", 6))


_SENTENCE = "show me the and from november 2023"


@query(_sql_search(_SENTENCE, S.Options(NOW), {}))
def q_search_indexed(spark, sf):
    """A whole search whose text branches read an index."""
    lib = library(spark, sf)
    index = TextIndex(spark, scratch(spark, "text-index"))
    index.upsert(S.contents(lib.files), "file_id", "content")
    found = S.search(S.Library(lib.files, lib.understanding, lib.text_vectors, lib.image_vectors, lib.people, index), _SENTENCE, S.Options(NOW), Q[::-1], Q)
    return found.select("file_id", "path", "filename", F.round("score", 5).alias("score"), F.round("role_score", 4).alias("role_score"), F.round("lexical", 5).alias("lexical"), F.round("image", 5).alias("image"), "date_score", "category_score", "badge", "explanation")


@query("""WITH c AS (SELECT o_orderkey AS k, o_custkey AS customer, o_totalprice AS price FROM orders WHERE o_orderkey % 7 <> 0),
    n AS (SELECT o_orderkey AS k, o_custkey AS customer, o_totalprice + 1 AS price, o_orderkey % 5 = 0 AS gone FROM orders WHERE o_orderkey <= (SELECT max(o_orderkey) FROM orders) / 10)
    SELECT k, customer, price FROM c WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT k, customer, price FROM n WHERE NOT gone""")
def s12_keyed_upsert(spark, sf):
    """A table in key ranges: the upsert of the lowest tenth of the keys, sent twice, leaves the other files as they are."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("price"))
    kept = KeyedTable(spark, scratch(spark, "keyed"), "k", rows_per_file=max(1, orders.count() // 20))
    kept.upsert(orders.filter("k % 7 <> 0"), batch=("orders", 0))
    top = orders.agg(F.max("k").alias("top"))
    low = orders.join(F.broadcast(top), F.col("k") <= F.col("top") / 10).select("k", "customer", (F.col("price") + 1).alias("price"), (F.col("k") % 5 == 0).alias("gone"))  # top is one row
    for _ in range(2):
        kept.upsert(low, deleted=F.col("gone"), batch=("orders", 1))
    return kept.read()


@query("SELECT id, query, round(score, 6) AS score FROM (SELECT *, 0 AS query FROM (WITH {0} SELECT * FROM b) UNION ALL SELECT *, 1 FROM (WITH {1} SELECT * FROM b))".format(_sql_bm25(_TERMS, _PREFIX), _sql_bm25(["of"], ["in"])))
def r5_bm25_of_several(spark, sf):
    """Several full-text queries in one pass over the texts."""
    return R.bm25_each(table(spark, sf, "documents"), "doc_id", "text", [(_TERMS, _PREFIX), (["of"], ["in"])]).withColumn("score", F.round("score", 6))


_AT = "(embedding[8 * {0} + {1} + 1]::DOUBLE * 40)"
_LAPLACIAN = "list_transform(range(64), lambda i: " + " + ".join([_AT.format("(CASE WHEN i < 8 THEN 1 ELSE i // 8 - 1 END)", "i % 8"), _AT.format("(CASE WHEN i >= 56 THEN 6 ELSE i // 8 + 1 END)", "i % 8"), _AT.format("(i // 8)", "(CASE WHEN i % 8 = 0 THEN 1 ELSE i % 8 - 1 END)"), _AT.format("(i // 8)", "(CASE WHEN i % 8 = 7 THEN 6 ELSE i % 8 + 1 END)")]) + " - 4 * " + _AT.format("(i // 8)", "i % 8") + ")"


def _squares(spark, sf):
    """The vectors as images of 8 x 8 pixels."""
    v = table(spark, sf, "embeddings")
    return v.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 40).alias("pixels"), F.lit(8).alias("width"), F.lit(8).alias("height"), ((F.col("vec_id") % 10 + 1) / 10).alias("confidence"), (F.col("vec_id") % 150 + 1).cast("double").alias("face"))


@query(f"SELECT vec_id, round(s, 5) AS sharpness, round(0.40::DOUBLE * ((vec_id % 10 + 1) / 10.0::DOUBLE) + 0.35::DOUBLE * least(1.0::DOUBLE, s / 120.0::DOUBLE) + 0.25::DOUBLE * least(1.0::DOUBLE, (vec_id % 150 + 1) / 112.0::DOUBLE), 3) AS quality FROM (SELECT vec_id, list_aggregate({_LAPLACIAN}, 'var_pop') AS s FROM embeddings)")
def p16_pixel_quality(spark, sf):
    """Sharpness from pixels, and the quality of a face with it."""
    rows = I.with_sharpness(_squares(spark, sf))
    quality = I.face_quality(F.col("confidence"), F.col("sharpness"), F.col("face"), F.col("face") + 1)
    return rows.select("vec_id", F.round("sharpness", 5).alias("sharpness"), quality.alias("quality"))


_BLUR = "list_sum(list_transform(range(49), lambda k: {w}[k // 7 + 1] * {w}[k % 7 + 1] * embedding[8 * greatest(0, least(7, i // 8 + k // 7 - 3)) + greatest(0, least(7, i % 8 + k % 7 - 3)) + 1]::DOUBLE * 40))"


@query(f"""WITH b AS (SELECT vec_id, CASE WHEN label = 3 THEN list_transform(range(64), lambda i: {_BLUR.format(w=I.gaussian(1.0).tolist())}) ELSE list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * 40) END AS p FROM embeddings),
    t AS (SELECT vec_id, list_transform(range(16), lambda j: (p[16 * (j // 4) + 2 * (j % 4) + 1] + p[16 * (j // 4) + 2 * (j % 4) + 2] + p[16 * (j // 4) + 2 * (j % 4) + 9] + p[16 * (j // 4) + 2 * (j % 4) + 10]) / 4) AS q FROM b)
    SELECT vec_id, 4 AS thumb_width, round(q[1], 4) AS first, round(q[16], 4) AS last, round(list_sum(list_transform(range(16), lambda j: (j + 1) * q[j + 1])), 4) AS weighted FROM t""")
def g2_thumbnails(spark, sf):
    """Thumbnails, those of protected images blurred."""
    rows = I.thumbnails(_squares(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id"), 4, 1.0, F.col("label") == 3)
    weighted = F.aggregate(F.transform("thumbnail", lambda x, j: (j + 1) * x), F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", "thumb_width", F.round(F.element_at("thumbnail", 1), 4).alias("first"), F.round(F.element_at("thumbnail", 16), 4).alias("last"), F.round(weighted, 4).alias("weighted"))


@query(f"SELECT vec_id AS id, round({COS.format('embedding', str(Q))}, 5) AS score FROM embeddings WHERE label <> 4 AND vec_id % 11 <> 5 ORDER BY {COS.format('embedding', str(Q))} DESC, vec_id LIMIT 20")
def x2_stored_vectors(spark, sf):
    """Exact nearest vectors from the files of a stored index that can hold them, after deletions."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    index = VectorIndex(spark, scratch(spark, "vectors"), ball=128)
    index.add(v, "vec_id", "embedding")
    index.delete(v.filter("vec_id % 11 = 5").select("vec_id"))
    return index.query(Q, 20, keep=F.col("label") != 4).withColumn("score", F.round("score", 5))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 OR lang IS NULL THEN 'document' ELSE lower(lang) END AS document_type, CASE WHEN doc_id % 3 <> 2 THEN source END AS title, CASE WHEN doc_id % 3 <> 2 THEN source || '|' || n_chars ELSE '' END AS dates,
    CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN '' ELSE '' END AS people, CASE doc_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 ELSE 1.0 END::DOUBLE AS confidence, doc_id % 3 <> 2 AS is_json FROM documents""")
def s9_answers(spark, sf):
    """Analysers' answers of mixed types, bare, fenced and broken ones."""
    d = table(spark, sf, "documents")
    kind = F.coalesce(F.concat(F.lit('" '), F.upper("lang"), F.lit(' "')), F.lit("null"))
    body = F.concat(F.lit('{"document_type":'), kind, F.lit(',"title":"'), "source", F.lit('","dates":[" '), "source", F.lit(' ",'), "n_chars", F.lit(',null," ",{"a":1}],"people":'), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('"'), "source", F.lit('"'))).otherwise("7"), F.lit(',"confidence":'), F.when(F.col("doc_id") % 3 == 0, "0.5").otherwise('"0.25"'), F.lit("}"))
    raw = F.when(F.col("doc_id") % 3 == 0, body).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n``` as asked"))).otherwise(F.lit("no { answer"))
    found = U.answered(d.select("doc_id", raw.alias("raw_response")))
    return found.select("doc_id", "document_type", "title", F.array_join("dates", "|").alias("dates"), F.array_join("people", "|").alias("people"), "confidence", "is_json")


@query(f"""WITH {FILES_SQL}, d AS (SELECT path, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS n FROM files WHERE file_id % 7 = 0),
    c AS (SELECT '/new' || path AS path, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY '/new' || path) AS n FROM files WHERE file_id % 14 = 0 OR file_id % 11 = 3),
    m AS (SELECT d.path, c.path AS dest FROM d JOIN c USING (content_hash, n))
    SELECT CASE WHEN dest IS NULL THEN 'deleted' ELSE 'moved' END AS event_type, path, dest FROM d LEFT JOIN m USING (path) UNION ALL SELECT 'created', path, NULL FROM c WHERE path NOT IN (SELECT dest FROM m)""")
def t1_moved_files(spark, sf):
    """Deletions and creations of one content are moves."""
    f = files(spark, sf)
    event = lambda rows, kind, path, digest: rows.select(F.lit(0).cast("timestamp").alias("ts"), F.lit(kind).alias("event_type"), path.alias("path"), "size_bytes", digest.alias("content_hash"))
    gone = event(f.filter("file_id % 7 = 0"), "deleted", F.col("path"), F.lit(None).cast("string"))
    came = event(f.filter("file_id % 14 = 0 or file_id % 11 = 3"), "created", F.concat(F.lit("/new"), "path"), F.col("content_hash"))
    return moves(gone.unionByName(came), f.select("path", "content_hash")).select("event_type", "path", "dest")
