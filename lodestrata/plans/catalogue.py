"""The engine's operators as queries over the test tables, with equivalent DuckDB SQL.

Names begin with the operator's handle in the survey's inventory. Every query runs over whole tables;
a limit stands only where it is the operator (top-k).
"""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import catalogue as C
from ..operators import duplicates as D
from ..operators import entities as E
from ..operators import governance as G
from ..operators import metrics as M
from ..operators import retrieval as R
from ..sources.views import FILES_SQL, files, table
from ..sources.views import checkpoints as _shared
from ..streaming import events as S
from .registry import QUERIES, SQL, query  # noqa: F401

def _in(exts: list[str]) -> str:
    return "(" + ", ".join(f"'{e}'" for e in exts) + ")"


def _sql_case(column: str, table_: dict[str, list[str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN lower({column}) IN {_in(v)} THEN '{k}'" for k, v in table_.items()) + f" ELSE '{other}' END"


def _sql_hits(column: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({column}, '{w}')::INTEGER" for w in words) + ")"


def _sql_label() -> str:
    pairs = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.FILE_LABELS.items())
    tag = f"regexp_extract(filename, '(?i)\\b({V.MOVIE_TAGS})\\b', 1)"
    movie = f"CASE WHEN size_bytes >= {V.MOVIE_BYTES} OR {tag} <> '' THEN 'Movie (' || CASE WHEN {tag} <> '' THEN upper({tag}) ELSE 'HD' END || ')' ELSE 'Video Clip' END"
    return f"CASE WHEN lower(extension) IN {_in(V.VIDEO)} THEN {movie} ELSE coalesce(CASE lower(extension) {pairs} END, upper(ltrim(extension, '.')) || ' File') END"


_TOK = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_WITH = f"WITH {FILES_SQL}"

# ---------------------------------------------------------------- scans and sinks


@query(f"{_WITH} SELECT file_id, path, size_bytes FROM files WHERE extension IN ('.pdf', '.txt')")
def s2_explicit_paths(spark, sf):
    """Only listed files that exist: a semi-join of the list with the catalogue."""
    f = files(spark, sf)
    wanted = f.filter(F.col("extension").isin(".pdf", ".txt")).select("path")
    return f.join(wanted, "path", "left_semi").select("file_id", "path", "size_bytes")


_SENSITIVE_TEXT = "lower(filename) || ' ' || lower(extracted_text)"


@query(f"""{_WITH}, changes AS (SELECT path, size_bytes + (file_id % 3 = 0)::BIGINT AS size_bytes, modified_at FROM files WHERE file_id % 2 = 0 UNION ALL SELECT path || '.new', size_bytes, modified_at FROM files WHERE file_id % 7 = 0)
    SELECT coalesce(n.path, c.path) AS path, coalesce(n.size_bytes, c.size_bytes) AS size_bytes, coalesce(n.modified_at, c.modified_at) AS modified_at,
    CASE WHEN n.path IS NULL OR (c.path IS NOT NULL AND n.size_bytes = c.size_bytes AND n.modified_at = c.modified_at) THEN 'indexed' ELSE 'pending_extraction' END AS status
    FROM files c FULL JOIN changes n ON c.path = n.path""")
def s12_upsert(spark, sf):
    f = files(spark, sf).select("file_id", "path", "size_bytes", "modified_at")
    changed = f.filter("file_id % 2 = 0").select("path", (F.col("size_bytes") + F.when(F.col("file_id") % 3 == 0, 1).otherwise(0)).alias("size_bytes"), "modified_at")
    new = f.filter("file_id % 7 = 0").select(F.concat("path", F.lit(".new")).alias("path"), "size_bytes", "modified_at")
    return C.upsert(f.drop("file_id"), changed.unionByName(new))


@query("SELECT doc_id, len(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> ''))::INTEGER AS word_count FROM documents")
def s14_page_word_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.word_count(F.col("text")).alias("word_count"))


_HISTORY = "h AS (SELECT conv_id * 1000 + turn AS id, conv_id AS owner, text AS query_text, length(text) AS result_count FROM conversations WHERE role = 'user')"


def history(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("owner"), F.col("text").alias("query_text"), F.length("text").cast("long").alias("result_count"))


@query(f"WITH {_HISTORY}, l AS (SELECT *, lag(query_text) OVER (PARTITION BY owner ORDER BY id) AS p FROM h WHERE trim(query_text) <> '') SELECT id, owner, query_text, result_count FROM l WHERE p IS NULL OR p <> query_text")
def s20_history_without_repeats(spark, sf):
    return C.history_without_repeats(history(spark, sf))


@query(f"{_WITH} SELECT file_id, path FROM files WHERE path IN (SELECT path FROM files WHERE folder_id <> 4)")
def s22_reconcile_missing(spark, sf):
    f = files(spark, sf)
    return C.reconcile(f, f.filter("folder_id <> 4")).select("file_id", "path")


@query("SELECT event_id, props AS raw, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s10_json_recovery(spark, sf):
    e = table(spark, sf, "events")
    ticks = "`" * 3
    shape = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit(f"answer:\n{ticks}json\n"), "props", F.lit(f"\n{ticks}"))).otherwise(F.concat(F.lit("well, "), "props", F.lit(" there")))
    return e.select("event_id", F.col("props").alias("raw"), T.recovered_json(shape, "k long")["k"].alias("k"))


_PLAIN = "regexp_replace(regexp_replace(html, '<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'gs')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_a}', '{_b}')"


@query(f"SELECT page_id, trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g')) AS body FROM pages")
def s3_html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_text(F.col("html")).alias("body"))


# ---------------------------------------------------------------- projections


@query(f"{_WITH} SELECT file_id, {_sql_label()} AS file_type, {_sql_case('extension', V.EXT_CATEGORY, 'Other')} AS category FROM files")
def p1_p2_labels(spark, sf):
    return files(spark, sf).select("file_id", C.type_label(F.col("extension"), F.col("filename"), F.col("size_bytes")).alias("file_type"), C.category(F.col("extension")).alias("category"))


_NAMES = "CASE file_id % 4 WHEN 0 THEN 'Film 2019 1080p BluRay.mkv' WHEN 1 THEN 'holiday.mp4' WHEN 2 THEN 'x264_take.mp4' ELSE 'show.WEB-DL.avi' END"


@query(f"""{_WITH}, v AS (SELECT file_id, {_NAMES} AS filename, size_bytes * 100000 AS size_bytes FROM files), t AS (SELECT *, regexp_extract(filename, '(?i)\\b({V.MOVIE_TAGS})\\b', 1) AS tag FROM v)
    SELECT file_id, CASE WHEN size_bytes >= {V.MOVIE_BYTES} OR tag <> '' THEN 'Movie (' || CASE WHEN tag <> '' THEN upper(tag) ELSE 'HD' END || ')' ELSE 'Video Clip' END AS label FROM t""")
def p3_video_classification(spark, sf):
    name = F.expr(_NAMES)
    return files(spark, sf).select("file_id", C.video_label(name, F.col("size_bytes") * 100000).alias("label"))


def _sql_sensitivity(body: str = "extracted_text", name: str = "filename") -> str:
    both = f"(lower({name}) || ' ' || lower({body}))"
    p = {k: f"regexp_matches({body}, '{v}')" for k, v in V.SENSITIVE_PATTERNS.items()}
    ids = f"{p['aadhaar']} OR {p['pan']} OR {p['voter']} OR ({p['passport']} AND (contains({both}, 'passport') OR contains({both}, 'republic of india'))) OR ({_sql_hits(both, V.ID_WORDS)} > 0 AND (contains({both}, 'card') OR contains({both}, 'identity')))"
    bank = _sql_hits(both, V.BANKING_WORDS)
    return f"CASE WHEN {ids} THEN 'ID_DOCUMENT' WHEN {p['card']} OR {p['ifsc']} OR ({p['account']} AND {bank} >= 1) OR {bank} >= 3 THEN 'BANKING_FINANCE' WHEN {_sql_hits(both, V.CONFIDENTIAL_WORDS)} > 0 THEN 'CONFIDENTIAL' ELSE 'NONE' END"


def _sql_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '(^|[^a-z0-9]){w}($|[^a-z0-9])')" if len(w) <= 3 else f"contains({column}, '{w}')" for w in words) + ")"


def _sql_taxonomy(kind: bool) -> str:
    t = "t"
    has = lambda *w: "(" + " OR ".join(f"contains({t}, '{x}')" for x in w) + ")"
    ids = f"CASE WHEN {has('aadhaar', 'uidai')} THEN 'Aadhaar Card' WHEN {has('pan', 'income tax')} THEN 'PAN Card' WHEN {has('passport')} THEN 'Passport' WHEN {has('voter', 'election')} THEN 'Voter ID' WHEN {has('driving', 'licence', 'license')} THEN 'Driving License' ELSE 'Identity Document' END"
    bank = f"CASE WHEN {has('statement')} THEN 'Bank Statement' WHEN {has('salary', 'payslip')} THEN 'Salary Slip' WHEN {has('tax', 'itr')} THEN 'Tax Return' ELSE 'Financial Record' END"
    rules = [("s = 'ID_DOCUMENT'", "'IDs & Documents'", ids), ("s = 'BANKING_FINANCE'", "'Banking & Finance'", bank), (f"lower(extension) IN {_in(V.IMAGES)}", "'Personal Photos'", "'Photo'"), (_sql_any(t, V.EDUCATION_WORDS), "'Education'", "'Academic Document'"), (_sql_any(t, V.WORK_WORDS), "'Work'", "'Work Document'"), (_sql_any(t, V.TRAVEL_WORDS), "'Travel'", "'Travel Document'"), ("lower(extension) IN ('.pdf', '.docx', '.doc', '.txt', '.md')", "'IDs & Documents'", "'Document'")]
    return "CASE " + " ".join(f"WHEN {a} THEN {c if kind else b}" for a, b, c in rules) + (" ELSE upper(replace(extension, '.', ''))" if kind else " ELSE 'Other'") + " END"


@query(f"{_WITH}, c AS (SELECT file_id, extension, {_SENSITIVE_TEXT} AS t, {_sql_sensitivity()} AS s FROM files) SELECT file_id, {_sql_taxonomy(False)} AS category_v4, {_sql_taxonomy(True)} AS document_type FROM c")
def p4_taxonomy(spark, sf):
    f = files(spark, sf).withColumn("s", G.sensitivity(F.col("extracted_text"), F.col("filename"))).withColumn("t", F.concat_ws(" ", F.lower("filename"), F.lower("extracted_text")))
    cat, kind = C.taxonomy(F.col("t"), F.col("extension"), F.col("s"))
    return f.select("file_id", cat.alias("category_v4"), kind.alias("document_type"))


@query(f"{_WITH} SELECT file_id, s AS sensitivity_class, CASE WHEN s = 'NONE' THEN 'NORMAL' ELSE 'PROTECTED' END AS privacy_state, CASE s WHEN 'ID_DOCUMENT' THEN 0.95 WHEN 'BANKING_FINANCE' THEN 0.90 WHEN 'CONFIDENTIAL' THEN 0.85 ELSE 0.0 END::DOUBLE AS confidence FROM (SELECT *, {_sql_sensitivity()} AS s FROM files)")
def p5_sensitivity(spark, sf):
    f = files(spark, sf).select("file_id", G.sensitivity(F.col("extracted_text"), F.col("filename")).alias("sensitivity_class"))
    return f.select("file_id", "sensitivity_class", G.state(F.col("sensitivity_class")).alias("privacy_state"), G.confidence(F.col("sensitivity_class")).alias("confidence"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def p6_content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


_CONCEPTS = ["Puppy", "QR-code", "automobile!", "dog", "Flyer", "vibrant", "laptop computer"]


_SQL_SYNONYM = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.SYNONYMS.items()) + " ELSE w END"


@query(f"""WITH r AS (SELECT p_partkey, unnest(list_slice({_CONCEPTS}, CAST(p_partkey % 5 + 1 AS BIGINT), CAST(p_partkey % 5 + 3 AS BIGINT))) AS raw, unnest([1, 2, 3]) AS place FROM part),
    w AS (SELECT p_partkey, place, trim(regexp_replace(lower(raw), '[.,;:!?"''()]', '', 'g')) AS w FROM r), c AS (SELECT p_partkey, {_SQL_SYNONYM} AS c, min(place) AS place FROM w GROUP BY 1, 2)
    SELECT p_partkey, list(c ORDER BY place) AS concepts FROM c WHERE c <> '' GROUP BY 1""")
def p8_canonical_concepts(spark, sf):
    raw = F.slice(F.array(*[F.lit(c) for c in _CONCEPTS]), (F.col("p_partkey") % 5 + 1).cast("int"), 3)
    return table(spark, sf, "part").select("p_partkey", T.canonical(raw).alias("concepts"))


@query(f"SELECT p_partkey, p_name, ({' OR '.join(f'''contains(lower(p_name), '{w}')''' for w in V.AMBIENT)}) AS is_ambient, list_sort(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: length(x) >= 2))) AS terms FROM part")
def p9_concept_tiers(spark, sf):
    n = F.lower("p_name")
    return table(spark, sf, "part").select("p_partkey", "p_name", T.ambient(n).alias("is_ambient"), F.array_sort(F.array_distinct(F.filter(F.split(n, " "), lambda x: F.length(x) >= 2))).alias("terms"))


@query("SELECT vec_id, floor(least(99.0, greatest(65.0, (list_extract(embedding, 1)::DOUBLE - 0.18) / 0.16 * 30 + 70)))::DOUBLE AS badge FROM embeddings")
def p15_image_badge(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", R.image_badge(F.element_at("embedding", 1).cast("double")).cast("double").alias("badge"))


@query("""WITH w AS (SELECT doc_id, string_split_regex(text, '\\s+') AS w FROM documents WHERE contains(lower(text), 'the')), a AS (SELECT *, greatest(1, list_position(list_transform(w, lambda x: contains(lower(x), 'the')), true) - 6) AS spot FROM w)
    SELECT doc_id, CASE WHEN spot > 1 THEN '…' ELSE '' END || regexp_replace(array_to_string(list_slice(w, spot, spot + 17), ' '), '(the)', '<b>\\1</b>', 'gi') || CASE WHEN len(w) >= spot + 18 THEN '…' ELSE '' END AS snippet FROM a""")
def p17_snippet(spark, sf):
    return table(spark, sf, "documents").filter(F.lower("text").contains("the")).select("doc_id", T.snippet(F.col("text"), "the").alias("snippet"))


# ---------------------------------------------------------------- filters


@query(f"{_WITH} SELECT file_id, extension FROM files WHERE lower(extension) IN {_in(V.FILTER_CATEGORY['Document'])}")
def f1_category_filter(spark, sf):
    return files(spark, sf).filter(C.in_category(F.col("extension"), "document")).select("file_id", "extension")


@query(f"{_WITH} SELECT file_id FROM files WHERE ends_with(lower(path), '.pdf') AND size_bytes > 2048")
def f3_f4_extension_and_size(spark, sf):
    from datetime import date

    from .planner import parse

    plan = parse("ext:pdf size:>2KB", date(2026, 10, 7))
    return files(spark, sf).filter(plan.filters(F.col("path"), F.col("size_bytes"), F.to_date(F.timestamp_seconds("modified_at")))).select("file_id")


@query(f"{_WITH} SELECT file_id FROM files WHERE CAST(make_timestamp(CAST(modified_at * 1000000 AS BIGINT)) AS DATE) BETWEEN DATE '2023-12-05' AND DATE '2023-12-10'")
def f6_date_predicate(spark, sf):
    from datetime import date

    from .planner import parse

    day = F.to_date(F.timestamp_seconds("modified_at"))
    plan = parse("notes between 5 and 10 Dec 2023", date(2026, 10, 7))
    return files(spark, sf).withColumn("day", day).filter(plan.when.predicate(F.col("day"))).select("file_id")


@query(f"{_WITH} SELECT f.file_id FROM files f WHERE size_bytes > 500 OR file_id % 5 = 0")
def f17_fast_path_changed(spark, sf):
    f = files(spark, sf)
    seen = f.filter("size_bytes <= 500").withColumn("content_hash", F.when(F.col("file_id") % 5 != 0, F.col("content_hash")))
    return C.fast_path(f.drop("content_hash"), seen).select("file_id")


_WATCHED = "'/' || list_extract(['.git', 'a', 'node_modules', 'b', 'AppData', 'env.d', 'c'], CAST(event_id % 7 + 1 AS BIGINT)) || '/' || list_extract(['~$', '.', '', 'x'], CAST(event_id % 4 + 1 AS BIGINT)) || event_type || list_extract(['.txt', '.TMP', '.log', '.txt~', '', '.part'], CAST(event_id % 6 + 1 AS BIGINT))"


@query(f"""WITH p AS (SELECT event_id, {_WATCHED} AS path FROM events), n AS (SELECT *, list_extract(string_split(path, '/'), -1) AS name FROM p)
    SELECT event_id, path, len(list_intersect(string_split(path, '/'), {V.IGNORED_FOLDERS})) > 0 OR starts_with(name, '~$') OR starts_with(name, '.') OR list_contains({V.IGNORED_EXTENSIONS}, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1))) AS is_ignored FROM n""")
def f14_watch_ignore(spark, sf):
    pick = lambda words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("event_id") % len(words) + 1).cast("int"))
    path = F.concat(F.lit("/"), pick([".git", "a", "node_modules", "b", "AppData", "env.d", "c"]), F.lit("/"), pick(["~$", ".", "", "x"]), "event_type", pick([".txt", ".TMP", ".log", ".txt~", "", ".part"]))
    e = table(spark, sf, "events").select("event_id", path.alias("path"))
    return e.select("event_id", "path", C.ignored(F.col("path")).alias("is_ignored"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') OR contains(lower(source), 'src1')")
def f19_like_tokens(spark, sf):
    return table(spark, sf, "documents").filter(F.lower("text").contains("tion") | F.lower("source").contains("src1")).select("doc_id")


# ---------------------------------------------------------------- joins and aggregates


@query(f"{_WITH}, g AS (SELECT DISTINCT folder_id FROM files UNION SELECT 999) SELECT g.folder_id, count(f.file_id) AS n_files, coalesce(sum(f.size_bytes), 0)::BIGINT AS bytes FROM g LEFT JOIN files f USING (folder_id) GROUP BY 1")
def j3_a5_folder_sizes(spark, sf):
    f = files(spark, sf)
    folders = f.select("folder_id").distinct().union(spark.range(999, 1000).select(F.col("id").cast("int")))
    return C.folder_sizes(folders, f)


@query("SELECT c_custkey, count(DISTINCT o_orderkey) FILTER (o_orderstatus = 'O') AS n_open, count(DISTINCT o_orderkey) FILTER (o_orderstatus = 'F') AS n_filled FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j4_a8_conditional_distinct(spark, sf):
    j = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy("c_custkey").agg(F.count_distinct(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("n_open"), F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("n_filled"))


@query("SELECT o_custkey AS person_id, min_by(o_orderkey, (-o_totalprice, o_orderkey)) AS det_id FROM orders GROUP BY 1")
def j10_n2_best_per_person(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("det_id"), F.col("o_totalprice").alias("quality"), F.lit(1.0).alias("confidence"))
    return E.best_per_person(o)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000)")
def j11_anti(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").filter("o_orderstatus = 'F' and o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def j12_semi(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query(f"WITH w AS (SELECT DISTINCT doc_id AS file_id, unnest({_TOK.format('text')}) AS word FROM documents), p AS (SELECT p_partkey AS person_id, lower(split_part(p_name, ' ', 1)) AS word FROM part) SELECT DISTINCT person_id, file_id FROM w JOIN p USING (word)")
def j18_text_mentions(spark, sf):
    persons = table(spark, sf, "part").select(F.col("p_partkey").alias("person_id"), F.split("p_name", " ")[0].alias("name"))
    return E.text_mentions(persons, files(spark, sf))


@query(f"{_WITH}, w AS (SELECT file_id, ' ' || array_to_string({_TOK.format("filename || ' ' || coalesce(extracted_text, '')")}, ' ') || ' ' AS text FROM files), p AS (SELECT p_partkey AS person_id, ' ' || array_to_string({_TOK.format('p_name')}, ' ') || ' ' AS name FROM part UNION ALL SELECT doc_id, ' doc ' || doc_id || ' ' FROM documents WHERE doc_id % 10 = 0) SELECT DISTINCT person_id, file_id FROM w JOIN p ON contains(text, name)")
def j18_whole_name_mentions(spark, sf):
    """Whole names, with file names of two words besides, as the parts' names are in no text."""
    persons = table(spark, sf, "part").select(F.col("p_partkey").alias("person_id"), F.col("p_name").alias("name"))
    named = table(spark, sf, "documents").filter("doc_id % 10 = 0").select(F.col("doc_id").alias("person_id"), F.concat(F.lit("Doc "), "doc_id").alias("name"))
    return E.text_mentions(persons.union(named), files(spark, sf))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def a1_status_counts(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query(f"{_WITH} SELECT category, count(*) AS n_files FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS category FROM files WHERE lower(extension) IN {_in(e)}" for c, e in V.FILTER_CATEGORY.items()) + ") GROUP BY 1")
def a2_category_counts(spark, sf):
    return C.category_counts(files(spark, sf))


@query(f"{_WITH}, m AS (SELECT *, file_id % 9 = 0 AS p, file_id <> min(file_id) OVER (PARTITION BY content_hash) AS d FROM files) SELECT count(*) AS n_files, sum(size_bytes)::BIGINT AS bytes, count(*) FILTER (p) AS n_protected, coalesce(sum(size_bytes) FILTER (p), 0)::BIGINT AS protected_bytes, count(*) FILTER (d) AS n_duplicates, coalesce(sum(size_bytes) FILTER (d), 0)::BIGINT AS duplicate_bytes FROM m")
def a3_storage_totals(spark, sf):
    return C.storage_totals(files(spark, sf), F.col("file_id") % 9 == 0)


@query(f"{_WITH} SELECT {_sql_case('extension', V.EXT_CATEGORY, 'Other')} AS category, count(*)::BIGINT AS n_files, sum(size_bytes)::BIGINT AS bytes FROM files GROUP BY 1")
def a4_storage_by_category(spark, sf):
    return C.storage_by_category(files(spark, sf))


@query(f"{_WITH} SELECT content_hash, count(*) AS copy_count, min(file_id) AS first_id, sum(size_bytes)::BIGINT AS bytes FROM files GROUP BY 1 HAVING count(*) > 1")
def a6_exact_duplicates(spark, sf):
    return D.exact_groups(files(spark, sf))


@query(f"{_WITH} SELECT file_id, nullif(min(file_id) OVER (PARTITION BY content_hash), file_id) AS duplicate_of_id FROM files")
def q12_duplicate_of(spark, sf):
    return D.duplicate_of(files(spark, sf))


@query(f"WITH {_HISTORY} SELECT query_text, max(id) AS last_id, max(result_count) AS result_count FROM h WHERE trim(query_text) <> '' GROUP BY 1")
def a7_history_distinct(spark, sf):
    return C.history_distinct(history(spark, sf))


@query("SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events")
def a12_latency_percentiles(spark, sf):
    e = M.latency(table(spark, sf, "events"), "value")
    return e.select(*[F.round(c, 6).alias(c) for c in e.columns])


_LINKS = "l AS (SELECT o_custkey % 200 AS person_id, o_orderkey % 50 AS file_id, round(o_totalprice / 1000000, 6) AS confidence, (o_orderstatus = 'F')::INTEGER AS is_confirmed FROM orders)"


def links(spark, sf):
    return table(spark, sf, "orders").select((F.col("o_custkey") % 200).alias("person_id"), (F.col("o_orderkey") % 50).alias("file_id"), F.round(F.col("o_totalprice") / 1000000, 6).alias("confidence"), (F.col("o_orderstatus") == "F").cast("int").alias("is_confirmed"))


@query(f"WITH {_LINKS} SELECT person_id, file_id, max(confidence) AS confidence, max(is_confirmed) AS is_confirmed FROM l GROUP BY 1, 2")
def a14_max_merge(spark, sf):
    x = links(spark, sf)
    return E.merge_links(x.filter("person_id % 2 = 0"), x.filter("person_id % 2 = 1 or is_confirmed = 1"), ["person_id", "file_id"])


@query(f"WITH {_LINKS} SELECT CASE WHEN person_id = 7 THEN 3 ELSE person_id END AS person_id, file_id, max(confidence) AS confidence, max(is_confirmed) AS is_confirmed FROM l GROUP BY 1, 2")
def e1_merge_person(spark, sf):
    return E.merge_person(links(spark, sf), 7, 3, ["person_id", "file_id"])


@query("SELECT s_suppkey AS person_id, min(s_suppkey) OVER (PARTITION BY lower(trim(substr(s_name, 1, 12)))) AS kept_id FROM supplier")
def n9_merge_names(spark, sf):
    return E.merge_names(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("person_id"), F.substring("s_name", 1, 12).alias("name")))


# ---------------------------------------------------------------- duplicates, vectors, entities

_BITS = " | ".join(f"(CASE WHEN list_extract(embedding, {i + 1}) > 0 THEN 1::UBIGINT << {i} ELSE 0::UBIGINT END)" for i in range(64))


_FLIPPED = f"h AS (SELECT vec_id AS id, ({_BITS}) AS h FROM embeddings UNION ALL SELECT vec_id + 1000000, xor(xor(({_BITS}), 1::UBIGINT << (vec_id % 64)), 1::UBIGINT << (vec_id * 7 % 64)) FROM embeddings)"


@query(f"WITH {_FLIPPED} SELECT a.id AS id_a, b.id AS id_b, bit_count(xor(a.h, b.h))::INTEGER AS distance FROM h a JOIN h b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 5")
def j14_o11_hamming_pairs(spark, sf):
    """Every hash and a copy of it with up to two bits changed."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), D.sign_hash(F.col("embedding")).alias("hash"))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") * k % 64).cast("int"))
    return D.hamming_pairs(v.union(v.select(F.col("id") + 1_000_000, F.col("hash").bitwiseXOR(bit(1)).bitwiseXOR(bit(7)))), 5)


_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"
_COS = f"({_DOT.format('{0}', '{1}')} / (sqrt({_DOT.format('{0}', '{0}')}) * sqrt({_DOT.format('{1}', '{1}')})))"
_Q = [round(((k * 37) % 101 - 50) / 50.0, 2) for k in range(64)]


@query(f"SELECT vec_id AS id, round({_COS.format('embedding', str(_Q))}, 5) AS score FROM embeddings ORDER BY {_COS.format('embedding', str(_Q))} DESC, vec_id LIMIT 20")
def r21_o9_knn(spark, sf):
    return R.knn(table(spark, sf, "embeddings"), _Q, 20, "vec_id", "embedding").withColumn("score", F.round("score", 5))


@query(f"SELECT vec_id AS id, round({_COS.format('embedding', str(_Q))}, 5) AS score FROM embeddings WHERE label <> 4 AND {_COS.format('embedding', str(_Q))} >= 0.1 ORDER BY 2 DESC, 1 LIMIT 1000")
def f12_knn_threshold_filtered(spark, sf):
    return R.knn(table(spark, sf, "embeddings"), _Q, 1000, "vec_id", "embedding", threshold=0.1, keep=F.col("label") != 4).withColumn("score", F.round("score", 5))


_ENSEMBLE = R.mean_vector([_Q, [x * (-1) ** k for k, x in enumerate(_Q)], _Q[::-1]])


@query(f"SELECT vec_id AS id, round({_COS.format('embedding', str(_ENSEMBLE))}, 5) AS score FROM embeddings ORDER BY {_COS.format('embedding', str(_ENSEMBLE))} DESC, vec_id LIMIT 25")
def r8_prompt_ensemble(spark, sf):
    return R.knn(table(spark, sf, "embeddings"), _ENSEMBLE, 25, "vec_id", "embedding").withColumn("score", F.round("score", 5))


def faces(spark, sf):
    v = table(spark, sf, "embeddings")
    refs = v.filter("vec_id % 9 = 0").select(F.col("label").alias("person_id"), F.col("embedding").alias("ref_vector"))
    return v.filter("vec_id % 9 <> 0").select(F.col("vec_id").alias("det_id"), F.col("embedding").alias("det_vector")), refs


_MATCH = f"""p AS (SELECT d.vec_id AS det_id, r.label AS person_id, max({_DOT.format('d.embedding', 'r.embedding')}) AS sim FROM embeddings d, embeddings r WHERE d.vec_id % 9 <> 0 AND r.vec_id % 9 = 0 GROUP BY 1, 2),
    k AS (SELECT *, lead(sim) OVER (PARTITION BY det_id ORDER BY sim DESC, person_id) AS second, row_number() OVER (PARTITION BY det_id ORDER BY sim DESC, person_id) AS rn FROM p),
    m AS (SELECT det_id, person_id, sim AS best, CASE WHEN coalesce(second, -1) < 0 THEN 1.0 ELSE sim - second END AS margin FROM k WHERE rn = 1)"""


@query(f"WITH {_MATCH} SELECT det_id, person_id, round(best, 5) AS best, CASE WHEN best >= 0.3 AND margin >= 0.03 THEN 'CONFIRMED' WHEN best >= 0.2 THEN 'POSSIBLE' ELSE 'UNKNOWN' END AS grade FROM m")
def r22_j16_n1_face_grades(spark, sf):
    m = E.best_matches(*faces(spark, sf))
    return m.select("det_id", "person_id", F.round("best", 5).alias("best"), E.graded(F.col("best"), F.col("margin"), 0.3, 0.2).alias("grade"))


@query()
def r24_propagation(spark, sf):
    _shared(spark)
    return E.propagate(*faces(spark, sf), confirmed=0.4, lead=0.03)


@query(f"""WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND {_DOT.format('a.embedding', 'b.embedding')} >= 0.4), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    reach(node, other) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM reach r JOIN u ON u.a = r.other) SELECT node, min(other) AS component FROM reach GROUP BY 1""")
def r25_j15_clusters(spark, sf):
    _shared(spark)
    return E.components(E.similar_links(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 0.4))


@query()
def n8_suppression(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("image_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("det_id"), (F.col("l_quantity") * 3).alias("x"), (F.col("l_tax") * 1000).alias("y"), (F.lit(20.0) + F.col("l_discount") * 100).alias("w"), F.lit(25.0).alias("h"), F.col("l_extendedprice").alias("confidence"))
    return E.suppress_overlaps(p)


# ---------------------------------------------------------------- retrieval

_TERMS, _PREFIX = ["the", "and"], ["ther"]


def _sql_bm25(terms: list[str], prefixes: list[str], every: bool = True) -> str:
    tf = [f"len(list_filter(t, lambda x: x = '{t}'))" for t in terms] + [f"len(list_filter(t, lambda x: starts_with(x, '{p}')))" for p in prefixes]
    n = range(len(tf))
    cols = ", ".join(f"{x} AS tf{k}" for k, x in enumerate(tf))
    stats = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in n)
    score = " + ".join(f"ln(1 + (n - df{k} + 0.5::DOUBLE) / (df{k} + 0.5::DOUBLE)) * tf{k} * 2.2::DOUBLE / (tf{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for k in n)
    hit = (" AND " if every else " OR ").join(f"tf{k} > 0" for k in n)
    return f"r AS (SELECT doc_id AS id, {_TOK.format('text')} AS t FROM documents), c AS (SELECT id, len(t) AS dl, {cols} FROM r), s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {stats} FROM c), b AS (SELECT id, {score} AS score FROM c, s WHERE {hit})"


@query(f"WITH {_sql_bm25(_TERMS, _PREFIX)} SELECT id, round(score, 6) AS score, round(score / (1 + score), 6) AS norm, round(1 / (1 + score), 6) AS compat_norm FROM b ORDER BY b.score DESC, id LIMIT 20")
def r2_bm25(spark, sf):
    """Flagship: conjunctive BM25 with a prefix term, top 20."""
    best = R.top(R.bm25(table(spark, sf, "documents"), "doc_id", "text", _TERMS, _PREFIX), 20)
    s = F.col("score")
    return best.select("id", F.round(s, 6).alias("score"), F.round(R.bm25_norm(s), 6).alias("norm"), F.round(R.bm25_norm(s, compat=True), 6).alias("compat_norm"))


@query(f"WITH {_sql_bm25(['de', 'und'], [], False)} SELECT id, round(score, 6) AS score FROM b")
def r1_any_term(spark, sf):
    return R.bm25(table(spark, sf, "documents"), "doc_id", "text", ["de", "und"], require_all=False).withColumn("score", F.round("score", 6))


@query(f"WITH w AS (SELECT doc_id AS id, unnest({_TOK.format('text')}) AS term FROM documents) SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM w GROUP BY 1")
def a16_term_statistics(spark, sf):
    p = R.postings(table(spark, sf, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


_NORM = "trim(regexp_replace(lower(filename), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query(f"{_WITH} SELECT file_id, (CASE WHEN contains({_NORM}, 'doc 12') THEN 1.0 WHEN contains({_NORM}, 'doc') AND contains({_NORM}, '12') THEN 0.95 WHEN contains(lower(extracted_text), 'tion') THEN 0.4 ELSE 0.0 END)::DOUBLE AS score FROM files")
def r6_filename_score(spark, sf):
    return files(spark, sf).select("file_id", R.filename_score(F.col("filename"), F.col("extracted_text"), "doc 12", ["tion"]).alias("score"))


_FUSION = f"""{_sql_bm25(['the'], [])}, lex AS (SELECT id, score / (1 + score) AS lexical FROM b), den AS (SELECT vec_id AS id, greatest({_COS.format('embedding', str(_Q))}, 0) AS dense FROM embeddings WHERE {_COS.format('embedding', str(_Q))} >= 0.05),
    u AS (SELECT id, lexical, 0.0::DOUBLE AS dense FROM lex UNION ALL SELECT id, 0.0::DOUBLE, dense FROM den), cand AS (SELECT id, max(lexical) AS lexical, max(dense) AS dense, (CASE WHEN id % 10 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS filename FROM u GROUP BY 1)"""


def candidates(spark, sf):
    lex = R.bm25(table(spark, sf, "documents"), "doc_id", "text", ["the"]).select("id", R.bm25_norm(F.col("score")).alias("lexical"))
    q = F.array(*[F.lit(x) for x in _Q])
    den = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), R.cosine(F.col("embedding"), q).alias("dense")).filter("dense >= 0.05")
    both = R.union_branches(lex, den)
    return both.withColumn("filename", F.when(F.col("id") % 10 == 0, 1.0).otherwise(0.0))


def _hybrid(intent: str):
    w = V.INTENT_WEIGHTS[intent]

    def run(spark, sf):
        c = candidates(spark, sf)
        scored = c.select("id", R.fused(intent, F.col("image"), F.col("lexical"), F.col("dense"), F.col("filename")).alias("score")).filter("score > 0.05")
        return R.top(scored, 50).withColumn("score", F.round("score", 6))

    run.__name__ = f"r14_r15_hybrid_{intent}"
    return query(f"WITH {_FUSION} SELECT id, round(score, 6) AS score FROM (SELECT id, {w[1]}::DOUBLE * lexical + {w[2]}::DOUBLE * dense + {w[3]}::DOUBLE * filename AS score FROM cand) WHERE score > 0.05 ORDER BY round(score, 12) DESC, id LIMIT 50")(run)


for _intent in V.INTENT_WEIGHTS:
    _hybrid(_intent)


_BASE = "b AS (SELECT l_orderkey AS k, l_linenumber AS n, l_discount * 10 AS base, l_tax * 10 AS roles, l_quantity / 50 AS coord FROM lineitem)"


@query(f"""WITH {_BASE}, r AS (SELECT *, CASE WHEN roles > 0.05 AND coord >= 0.25 THEN 0.35 * coord * roles + (1 - 0.35 * coord) * base ELSE base * 0.85 END AS s1 FROM b), d AS (SELECT *, s1 * greatest(0.15, 1 - 0.6 * coord) AS s2 FROM r),
    p AS (SELECT *, CASE WHEN n > 3 AND roles > 0 THEN 0.55 * roles + 0.45 * s2 ELSE s2 * 0.4 END AS s3 FROM d), q AS (SELECT *, CASE WHEN n = 1 THEN least(1.0, s3 * 1.35) WHEN n = 2 THEN s3 * 0.4 ELSE s3 END AS s4 FROM p)
    SELECT k, n, round(greatest(0.0, least(1.0, CASE WHEN k % 2 = 0 THEN least(1.0, s4 * 1.25) ELSE s4 END)) + 1e-9, 6)::DOUBLE AS score FROM q""")
def r16_r19_score_chain(spark, sf):
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_discount") * 10).alias("base"), (F.col("l_tax") * 10).alias("roles"), (F.col("l_quantity") / 50).alias("coord"))
    s = R.contradiction_damping(R.role_blend(F.col("base"), F.col("roles"), F.col("coord")), F.col("coord"))
    s = R.person_fusion(s, F.when(F.col("n") > 3, F.col("roles")).otherwise(0.0), True)
    b = b.withColumn("s3", s)
    date = F.when(F.col("n") == 1, 1).when(F.col("n") == 2, -1).otherwise(0)
    return b.select("k", "n", F.round(R.boosted(F.col("s3"), date, F.col("k") % 2 == 0) + 1e-9, 6).alias("score"))


@query("""WITH r AS (SELECT c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank, c_nationkey AS q, c_acctbal / 10000 AS score, (c_custkey % 10) / 10.0::DOUBLE AS second FROM customer), b AS (SELECT *, CASE WHEN rank <= 5 THEN round(0.7::DOUBLE * score + 0.3::DOUBLE * second, 3) ELSE score END AS s FROM r)
    SELECT q, id, CASE WHEN rank <= 5 THEN row_number() OVER (PARTITION BY q, rank > 5 ORDER BY s DESC, rank) ELSE rank END AS rank, round(s, 6) AS score FROM b""")
def r20_o13_rerank(spark, sf):
    order = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    r = table(spark, sf, "customer").withColumn("rank", F.row_number().over(order)).select(F.col("c_nationkey").alias("q"), F.col("c_custkey").alias("id"), "rank", (F.col("c_acctbal") / 10000).alias("score"), ((F.col("c_custkey") % 10) / 10.0).alias("second"))
    return R.rerank(r, F.col("second"), query="q").select("q", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("""WITH t AS (SELECT p_partkey AS id, list_distinct(list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda x: length(x) > 1)) AS w FROM part) SELECT id, len(list_intersect(w, ['brushed', 'steel', 'large', 'red', 'promo']))::INTEGER AS hits FROM t WHERE len(list_intersect(w, ['brushed', 'steel', 'large', 'red', 'promo'])) > 0 ORDER BY 2 DESC, 1 DESC LIMIT 50""")
def r10_o12_concept_search(spark, sf):
    """Whole words of the concatenated fields, scored before the limit."""
    w = F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), "[^a-z0-9]+"), lambda x: F.length(x) > 1))
    hits = F.size(F.array_intersect(w, F.array(*[F.lit(x) for x in ("brushed", "steel", "large", "red", "promo")])))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), hits.alias("hits")).filter("hits > 0").orderBy(F.desc("hits"), F.desc("id")).limit(50)


@query(f"SELECT doc_id, len(list_intersect({_TOK.format('text')}, {V.ROMANISED_WORDS})) > 0 OR regexp_matches(text, '[\\x{{0900}}-\\x{{0D7F}}]') AS code_mixed FROM documents")
def qj_code_mixed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.code_mixed(F.col("text")).alias("code_mixed"))


# ---------------------------------------------------------------- governance

_STATE = f"s AS (SELECT *, CASE WHEN file_id % 11 = 0 THEN 'HIDDEN' WHEN file_id % 13 = 0 THEN 'PROTECTED' ELSE 'NORMAL' END AS auto_state FROM files), g AS (SELECT *, CASE WHEN file_id % 22 = 0 THEN 'NORMAL' ELSE auto_state END AS privacy_state FROM s)"


def governed(spark, sf):
    f = files(spark, sf).withColumn("privacy_state", F.when(F.col("file_id") % 11 == 0, "HIDDEN").when(F.col("file_id") % 13 == 0, "PROTECTED").otherwise("NORMAL"))
    overrides = files(spark, sf).filter("file_id % 22 = 0").select("file_id", F.lit("NORMAL").alias("privacy_state"))
    return G.apply_policy(f, overrides)


@query(f"{_WITH}, {_STATE} SELECT privacy_state, count(*) AS n FROM g GROUP BY 1")
def g1_a15_policy_counts(spark, sf):
    return governed(spark, sf).groupBy("privacy_state").agg(F.count("*").alias("n"))


@query(f"{_WITH}, {_STATE} SELECT file_id FROM g WHERE privacy_state NOT IN ('HIDDEN', 'PROTECTED')")
def f10_f11_row_hiding(spark, sf):
    return G.visible(governed(spark, sf), False, "hide").select("file_id")


@query(f"{_WITH}, {_STATE} SELECT file_id, size_bytes, CASE WHEN privacy_state = 'PROTECTED' THEN 'Protected File' || extension ELSE filename END AS filename, CASE WHEN privacy_state = 'PROTECTED' THEN '[PROTECTED PATH]' ELSE path END AS path, CASE WHEN privacy_state = 'PROTECTED' THEN '[PROTECTED]' ELSE extracted_text END AS extracted_text FROM g WHERE privacy_state <> 'HIDDEN'")
def g2_masked_projection(spark, sf):
    return G.masked(G.visible(governed(spark, sf), False), False).select("file_id", "size_bytes", "filename", "path", "extracted_text")


# ---------------------------------------------------------------- order and limits


@query(f"{_WITH} SELECT file_id, size_bytes FROM files ORDER BY size_bytes DESC, file_id LIMIT 15")
def o10_largest_files(spark, sf):
    return R.top(files(spark, sf), 15, "size_bytes", "file_id").select("file_id", "size_bytes")


@query(f"{_WITH} SELECT file_id, modified_at FROM files ORDER BY modified_at DESC, file_id LIMIT 20")
def o3_recent_files(spark, sf):
    return R.top(files(spark, sf), 20, "modified_at", "file_id").select("file_id", "modified_at")


@query(f"{_WITH} SELECT file_id, extension, size_bytes FROM files WHERE lower(extension) IN {_in(V.VIDEO)} ORDER BY size_bytes DESC, file_id LIMIT 20")
def o4_largest_videos(spark, sf):
    return R.top(files(spark, sf).filter(F.lower("extension").isin(V.VIDEO)), 20, "size_bytes", "file_id").select("file_id", "extension", "size_bytes")


# ---------------------------------------------------------------- quality

_RUNS = """listed AS (SELECT o_custkey AS query_id, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), runs AS (SELECT query_id, item, min(rank) AS rank FROM (SELECT * FROM listed UNION ALL SELECT query_id, item, rank + 2 FROM listed) GROUP BY 1, 2), qrels AS (SELECT o_custkey AS query_id, o_orderkey AS item, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS gain FROM orders WHERE o_orderkey % 3 = 0)"""


def judged(spark, sf):
    o = table(spark, sf, "orders")
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    runs = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item"), F.row_number().over(order).alias("rank"))
    runs = runs.union(runs.withColumn("rank", F.col("rank") + 2))  # every item is returned twice
    qrels = o.filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item"), F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias("gain"))
    return runs, qrels


_PER_QUERY = f"""{_RUNS}, m AS (SELECT r.query_id, r.rank, coalesce(q.gain, 0) AS gain FROM runs r LEFT JOIN qrels q USING (query_id, item) WHERE r.rank <= 10), s AS (SELECT query_id, count(*) FILTER (gain > 0) AS found, min(rank) FILTER (gain > 0) AS first, sum((power(2.0::DOUBLE, gain) - 1) / log2(rank + 1)) AS dcg FROM m GROUP BY 1),
    i AS (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS p FROM qrels), d AS (SELECT query_id, count(*) AS n, sum((power(2.0::DOUBLE, gain) - 1) / log2(p + 1)) FILTER (p <= 10) AS ideal FROM i GROUP BY 1),
    e AS (SELECT d.query_id, coalesce((found > 0)::INTEGER, 0) AS hit, coalesce(found / 10.0::DOUBLE, 0) AS precision, coalesce(found / n::DOUBLE, 0) AS recall, coalesce(1.0::DOUBLE / first, 0) AS reciprocal_rank, coalesce(dcg / ideal, 0) AS ndcg FROM d LEFT JOIN s USING (query_id))"""
_METRICS = ("hit", "precision", "recall", "reciprocal_rank", "ndcg")


@query(f"WITH {_PER_QUERY} SELECT query_id, hit, round(precision, 6) AS precision, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg FROM e")
def n4_n7_query_metrics(spark, sf):
    p = M.per_query(*judged(spark, sf))
    return p.select("query_id", "hit", *[F.round(c, 6).alias(c) for c in _METRICS[1:]])


@query(f"WITH {_PER_QUERY} SELECT {', '.join(f'round(avg({m}), 6) AS mean_{m}' for m in _METRICS)} FROM e")
def a12_mean_metrics(spark, sf):
    return M.means(M.per_query(*judged(spark, sf)))


# ---------------------------------------------------------------- streams (the same functions run on streams)


@query("""WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM o)
    SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max(ts) AS at, count(*) AS n_events FROM g GROUP BY user_id, s""")
def t2_debounce(spark, sf):
    return S.debounce(table(spark, sf, "events"), ["user_id"], "6 hours", tie="event_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t8_tumbling_counts(spark, sf):
    return S.tumbling(table(spark, sf, "events"), "1 hour", ["event_type"])


@query("""WITH w AS (SELECT user_id, time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR * unnest([0, 1]) AS start FROM events WHERE event_type = 'error') SELECT start, user_id, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 2""")
def t7_lockouts(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'error'")
    return S.failure_windows(e, ["user_id"], failures=2, within="24 hours", slide="12 hours")
