"""Lexical, dense and filename scoring, fusion and reranking."""

from __future__ import annotations

import re
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import normal, tokens

K1, B = 1.2, 0.75


def _times(words: str, term: str, prefix: bool = False) -> Column:
    """How often a term, or tokens that start with it, are among the words."""
    return F.size(F.filter(words, lambda x: x.startswith(term) if prefix else x == F.lit(term)))


def postings(docs: DataFrame, id_col: str, text_col: str, terms: list[str] | None = None, prefixes: list[str] = ()) -> DataFrame:
    """(id, dl, term, tf), counted inside each row, so nothing is shuffled; with terms given only theirs.
    A prefix term counts every token that starts with it. Rows that share an id are documents of their own."""
    rows = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    if terms is None and not prefixes:
        # runs of equals in the sorted tokens: a token's count is the distance to the next run
        run = rows.select("id", F.size("t").alias("dl"), F.array_sort("t").alias("t"))
        starts = F.filter(F.sequence(F.lit(0), F.col("dl") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
        marked = run.filter("dl > 0").select("id", "dl", "t", starts.alias("s"))
        counted = F.transform("s", lambda i, k: F.struct(F.get("t", i).alias("term"), (F.coalesce(F.get("s", k + 1), F.col("dl")) - i).cast("long").alias("tf")))
        return marked.select("id", "dl", F.explode(counted).alias("w")).select("id", "dl", "w.term", "w.tf")
    wanted = [F.struct(F.lit(t).alias("term"), _times("t", t).alias("tf")) for t in terms or ()]
    wanted += [F.struct(F.lit(p + "*").alias("term"), _times("t", p, True).alias("tf")) for p in prefixes]
    return rows.select("id", F.size("t").alias("dl"), F.explode(F.array(*wanted)).alias("w")).select("id", "dl", "w.term", "w.tf")


#: Buckets of terms in a stored index; a query reads those of its terms.
TERM_BUCKETS = 64


def bucket_of(term: str) -> int:
    """The bucket of a term: by its first two characters, so that a prefix of two or more has one bucket."""
    return zlib.crc32(term[:2].encode()) % TERM_BUCKETS


def write_index(docs: DataFrame, id_col: str, text_col: str, folder: str) -> None:
    """Store the postings by bucket of their terms, with document frequency left to the query, and the
    corpus statistics beside them. Tokens are made once, not for each query. Buckets are of any size, so
    large ones are dealt over several tasks and files, each sorted by term."""
    rows = postings(docs, id_col, text_col)
    bucket = F.pmod(F.crc32(F.substring("term", 1, 2).cast("binary")), F.lit(TERM_BUCKETS)).cast("int")
    rows.withColumn("bucket", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    sizes = docs.select(F.size(tokens(F.col(text_col))).alias("dl"))
    sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{folder}/corpus")


def bm25_indexed(spark, folder: str, terms: list[str] = (), prefixes: list[str] = (), require_all: bool = True, k1: float = K1, b: float = B) -> DataFrame:
    """``bm25`` over a stored index: reads the buckets of the terms only (short prefixes read all)."""
    stored = spark.read.parquet(f"{folder}/postings")
    buckets = [bucket_of(t) for t in (*terms, *prefixes)]
    if all(len(p) >= 2 for p in prefixes):
        stored = stored.filter(F.col("bucket").isin(sorted(set(buckets))))
    wanted = [F.when(F.col("term") == t, F.lit(t)) for t in terms] + [F.when(F.col("term").startswith(p), F.lit(p + "*")) for p in prefixes]
    named = stored.select("id", "dl", "tf", F.explode(F.array_compact(F.array(*wanted))).alias("q"))
    hits = named.groupBy("id", "dl", "q").agg(F.sum("tf").alias("tf"))
    df = hits.groupBy("q").agg(F.count("*").alias("df"))  # a row for each term of the query
    corpus = spark.read.parquet(f"{folder}/corpus")  # one row
    met = hits.join(F.broadcast(df), "q").join(F.broadcast(corpus))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = met.groupBy("id").agg(F.sum(part).alias("score"), F.count("*").alias("_terms"))
    return scored.filter(F.col("_terms") == len(buckets) if require_all else F.lit(True)).select("id", "score")


def bm25(docs: DataFrame, id_col: str, text_col: str, terms: list[str] = (), prefixes: list[str] = (), require_all: bool = True, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) of documents with the terms. No shuffle of documents: the terms' frequencies are
    columns, and the corpus statistics are one aggregate."""
    names = [*terms, *[p + "*" for p in prefixes]]
    rows = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    counts = [_times("t", t).alias(f"tf{k}") for k, t in enumerate(terms)]
    counts += [_times("t", p, True).alias(f"tf{len(terms) + k}") for k, p in enumerate(prefixes)]
    rows = rows.select("id", F.size("t").alias("dl"), *counts)
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(names))])
    hit = reduce((lambda x, y: x & y) if require_all else (lambda x, y: x | y), [F.col(f"tf{k}") > 0 for k in range(len(names))])
    idf = lambda k: F.log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
    part = lambda k: idf(k) * F.col(f"tf{k}") * (k1 + 1) / (F.col(f"tf{k}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    score = reduce(lambda x, y: x + y, [part(k) for k in range(len(names))])
    return rows.filter(hit).join(F.broadcast(stats)).select("id", score.alias("score"))  # stats is one row


def bm25_each(docs: DataFrame, id_col: str, text_col: str, queries: list[tuple[list[str], list[str]]], require_all: bool = True, k1: float = K1, b: float = B) -> DataFrame:
    """(id, query, score): ``bm25`` of several (terms, prefixes) at once, ``query`` their place in the list. The
    documents are tokenised once for the statistics and once for the scores, whatever the number of queries."""
    flat = list(dict.fromkeys([(t, False) for q in queries for t in q[0]] + [(p, True) for q in queries for p in q[1]]))
    place = {x: k for k, x in enumerate(flat)}
    rows = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    rows = rows.select("id", F.size("t").alias("dl"), *[_times("t", t, p).alias(f"tf{k}") for k, (t, p) in enumerate(flat)])
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(flat))])
    idf = lambda k: F.log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
    part = lambda k: idf(k) * F.col(f"tf{k}") * (k1 + 1) / (F.col(f"tf{k}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    found = []
    for number, (terms, prefixes) in enumerate(queries):
        own = [place[t, False] for t in terms] + [place[p, True] for p in prefixes]
        hit = reduce((lambda x, y: x & y) if require_all else (lambda x, y: x | y), [F.col(f"tf{k}") > 0 for k in own])
        found.append(F.when(hit, F.struct(F.lit(number).alias("query"), reduce(lambda x, y: x + y, [part(k) for k in own]).alias("score"))))
    some = reduce(lambda x, y: x | y, [F.col(f"tf{k}") > 0 for k in range(len(flat))])
    each = rows.filter(some).join(F.broadcast(stats)).select("id", F.explode(F.array_compact(F.array(*found))).alias("f"))  # stats is one row
    return each.select("id", "f.query", "f.score")


def bm25_norm(score: Column, compat: bool = False) -> Column:
    """Into [0, 1): s / (1 + s); the compatible form 1 / (1 + s) turns the order round."""
    return 1 / (1 + score) if compat else score / (1 + score)


def top(scored: DataFrame, k: int, score: str = "score", tie: str = "id") -> DataFrame:
    return scored.orderBy(F.desc(score), tie).limit(k)


def filename_score(name: Column, content: Column, query: str, expansions: list[str] = ()) -> Column:
    words = [w for w in query.lower().split() if len(w) > 1]
    own = normal(name)
    whole = own.contains(" ".join(query.lower().split()))
    every = reduce(lambda a, b: a & b, [own.contains(w) for w in words]) if words else F.lit(False)
    some = lambda x: reduce(lambda a, b: a | b, [x.contains(e.lower()) for e in expansions]) if expansions else F.lit(False)
    return F.when(whole, 1.0).when(every, 0.95).when(some(own), 0.8).when(some(F.lower(content)), 0.4).otherwise(0.0)


def expansion_terms(query: str, most: int = 6) -> list[str]:
    """Assignment, acronym and compound forms of the query's words, at most ``most``."""
    low, out = query.lower(), []
    if m := re.search(V.ASSIGNMENT, query):
        kind, n = m[1].lower(), m[2]
        out += [f"{kind} {n}", f"{kind}{n}", f"{kind}-{n}", f"la {n}", f"la{n}", f"da {n}", f"assignment {n}", f"assessment {n}"]
    for w in low.split():
        out += V.ACRONYMS.get(w, [])
    joined = " ".join(low.split())
    out += [other for form, other in V.COMPOUNDS.items() if form in joined]
    return [x for x in dict.fromkeys(x.lower() for x in out) if x != joined][:most]


def query_terms(text: str) -> tuple[list[str], list[str]]:
    """(whole terms, prefix terms) of a full-text query: words of three letters and more match as
    prefixes, shorter ones whole; all of them must match."""
    words = list(dict.fromkeys(re.sub(r"[^\w\s]|_", " ", text.lower()).split()))
    return [w for w in words if len(w) < 3], [w for w in words if len(w) >= 3]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str, vector_col: str, threshold: float | None = None, keep: Column | None = None) -> DataFrame:
    """Exact nearest vectors to one query: the query is a literal, the rest a top-k without shuffle of all rows."""
    rows = vectors if keep is None else vectors.filter(keep)
    q = F.array(*[F.lit(float(x)) for x in query])
    found = rows.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), q).alias("score"))
    if threshold is not None:
        found = found.filter(F.col("score") >= threshold)
    return top(found, k)


def mean_vector(vectors: list[list[float]]) -> list[float]:
    """Prompt ensemble: the normalised mean."""
    mean = [sum(x) / len(vectors) for x in zip(*vectors, strict=True)]
    size = sum(x * x for x in mean) ** 0.5
    return [x / size for x in mean] if size else mean


def image_norm(score: Column) -> Column:
    """Similarities of image and text, which hardly leave [0.18, 0.34], as [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - 0.18) / 0.16))


def image_badge(score: Column) -> Column:
    return F.least(F.lit(99.0), F.greatest(F.lit(65.0), (score - 0.18) / 0.16 * 30 + 70)).cast("int")


def union_branches(*branches: DataFrame) -> DataFrame:
    """(id, lexical, dense, image, filename): candidates of all branches, the best score of each kind."""
    kinds = ("lexical", "dense", "image", "filename")
    wide = [b.select("id", *[(F.col(c) if c in b.columns else F.lit(0.0)).alias(c) for c in kinds]) for b in branches]
    return reduce(DataFrame.unionByName, wide).groupBy("id").agg(*[F.max(c).alias(c) for c in kinds])


def fused(intent: str, image: Column, lexical: Column, dense: Column, filename: Column) -> Column:
    w = V.INTENT_WEIGHTS[intent]
    return w[0] * image + w[1] * lexical + w[2] * dense + w[3] * filename


def role_blend(base: Column, roles: Column, coordination: Column, denied: Column | None = None) -> Column:
    """Roles lead as far as the candidate has them together. Where they do not, ``denied`` (analysed,
    seen by the image branch, but without the roles; all such rows if not given) damps."""
    w = 0.35 * coordination
    damped = base * 0.85 if denied is None else F.when(denied, base * 0.85).otherwise(base)
    return F.when((roles > 0.05) & (coordination >= 0.25), w * roles + (1 - w) * base).otherwise(damped)


def contradiction_damping(score: Column, contradiction: Column) -> Column:
    return score * F.greatest(F.lit(0.15), 1 - 0.6 * contradiction)


def person_fusion(score: Column, person: Column, requested: bool) -> Column:
    return F.when(person > 0, 0.55 * person + 0.45 * score).otherwise(score * 0.40) if requested else score


def boosted(score: Column, date: Column, category: Column) -> Column:
    """date: 1 match, -1 mismatch, 0 none asked for; category: match or not. Within [0, 1]."""
    s = F.when(date > 0, F.least(F.lit(1.0), score * 1.35)).when(date < 0, score * 0.40).otherwise(score)
    s = F.when(category, F.least(F.lit(1.0), s * 1.25)).otherwise(s)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def rerank(ranked: DataFrame, second: Column, pool: int = 5, query: str | None = None) -> DataFrame:
    """The first ``pool`` rows of each query's list blend .70 own with .30 second score and change places
    by it; the tail stays as it is and enters no window. ``query`` is the lists' key; without one all
    rows are one list."""
    inside = F.col("rank") <= pool
    blended = ranked.filter(inside).withColumn("score", F.round(0.70 * F.col("score") + 0.30 * second, 3))
    order = Window.partitionBy(F.col(query) if query else F.lit(0)).orderBy(F.desc("score"), "rank")
    kind = ranked.schema["rank"].dataType
    head = blended.withColumn("rank", F.row_number().over(order).cast(kind))
    return head.unionByName(ranked.filter(~inside))


def explanation(reasons: Column) -> Column:
    return F.array_join(F.slice(F.array_distinct(reasons), 1, 3), " · ")
