"""Mixing sources to target weights through soft domain membership.

1. A word classifier (naive Bayes over distinct words) is fitted on labelled documents; it gives each
   document a posterior over the domains ``high``, ``low`` and ``toxic``.
2. Nonnegative document rates r are fitted so that the expected tokens of each domain,
   sum of r * tokens * posterior, meet the target weights: least squares by projected gradient. A
   step is one distributed aggregate of a few sums; the residuals so far are all the state there
   is, and each document's rate is a fold over them.

Native: DataFrame functions only. Fitted on all labelled documents and all telling words. The words'
weights are broadcast only where they are at most ``BROADCAST_WORDS`` (counted first) and joined by
shuffle beyond; token totals, posteriors and the fit itself cover every document.

Defined results: a null or empty text has no tokens, and a posterior and rate like any other; labels with null marks or unknown ids are not learned from; of repeated labels of an id the
worst counts; rows that repeat a document id are weighed each for itself; without labels all
domains are equally likely; without documents there are no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import persist_table

DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.85, "low": 0.13, "toxic": 0.02}
#: What makes a word telling. All documents are scored with all their tokens.
MIN_DOCS, MIN_DEVIATION, MIN_RATIO = 5, 5.0, 3.0
#: Telling words up to which their weights are broadcast.
BROADCAST_WORDS = 200_000
ROUNDS, TOLERANCE = 200, 1e-6


def distinct_words(text: Column) -> Column:
    """(number of tokens, distinct lower-case words); a token is a run without ASCII white space."""
    words = F.coalesce(F.array_remove(F.split(F.lower(text), r"[\x09-\x0D\x20]+"), ""), F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.array_distinct(w).alias("words"))), 1)


def training_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(label_id, domain) of all labelled ids."""
    marks = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    one = marks.groupBy(F.col(id_col).alias("label_id")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").otherwise("low")
    return one.select("label_id", domain.alias("domain"))


def learned_texts(texts: DataFrame, one: DataFrame) -> DataFrame:
    """``texts`` (label_id, key, text) that ``one`` (label_id, key, domain), a row for each key, names. Texts are shuffled
    once, at any size of the tables: rows that repeat in the table are one document, and meet where they were joined."""
    return texts.join(one.hint("merge"), ["label_id", "key"]).dropDuplicates(["label_id", "key"])


def word_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[float]]:
    """(word, w_<domain>...): what a word's presence adds to the log odds, for all telling words;
    and per domain the log likelihood of a text with none of them."""
    chosen = training_domains(labels, id_col)
    texts = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    # of equal texts one is learned from
    one = texts.select("label_id", "key").join(chosen, "label_id").select("label_id", "domain", "key")
    one = persist_table(one.groupBy("key").agg(F.min(F.struct("label_id", "domain")).alias("m")).select("key", "m.label_id", "m.domain"), "training")
    sizes = {r["domain"]: r["count"] for r in one.groupBy("domain").count().collect()}
    total = sum(sizes.values())
    held = learned_texts(texts, one).select("domain", F.explode(distinct_words(F.col("text"))["words"]).alias("word"))
    counts = held.groupBy("word").agg(*[F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS])
    share = {d: F.least((F.col(d) + 0.5) / (sizes.get(d, 0) + 1.0), F.lit(0.999)) for d in DOMAINS}
    seen = reduce(lambda a, b: a + b, [F.col(d) for d in DOMAINS])
    # by how many standard deviations a word's share of a domain's documents is off
    rest = {d: min(max(sizes.get(d, 0) / max(total, 1), 1e-9), 1 - 1e-9) for d in DOMAINS}
    off = F.greatest(*[F.abs(F.col(d) - seen * rest[d]) / F.sqrt(seen * rest[d] * (1 - rest[d]) + 1.0) for d in DOMAINS])
    ratio = F.greatest(*share.values()) / F.least(*share.values())
    rows = counts.filter(seen >= MIN_DOCS).withColumns({"off": off, "ratio": ratio}).filter((F.col("off") >= MIN_DEVIATION) & (F.col("ratio") >= MIN_RATIO))
    absent = {f"a_{d}": F.log1p(-share[d]) for d in DOMAINS}
    weights = persist_table(rows.select("word", *[(F.log(share[d]) - absent[f"a_{d}"]).alias(f"w_{d}") for d in DOMAINS], *[v.alias(k) for k, v in absent.items()]), "weights")
    none = weights.agg(*[F.sum(k).alias(k) for k in absent]).first()
    prior = [float(np.log((sizes.get(d, 0) + 1) / (total + len(DOMAINS)))) + float(none[f"a_{d}"] or 0.0) for d in DOMAINS]
    return weights.drop(*absent), prior


def posteriors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(row, id, n_tokens, p_<domain>...) of every row of ``docs``."""
    weights, prior = word_weights(docs, labels, id_col, text_col)
    small = weights.count() <= broadcast_words
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), distinct_words(F.col(text_col)).alias("d"))
    spread = rows.select("row", "id", F.col("d.n").alias("n_tokens"), F.explode_outer("d.words").alias("word"))
    joined = spread.join(F.broadcast(weights) if small else weights, "word", "left")
    sums = joined.groupBy("row").agg(F.first("id").alias("id"), F.first("n_tokens").cast("long").alias("n_tokens"), *[F.coalesce(F.sum(f"w_{d}"), F.lit(0.0)).alias(f"s_{d}") for d in DOMAINS])
    score = [F.lit(p) + F.col(f"s_{d}") for p, d in zip(prior, DOMAINS, strict=True)]
    top = F.greatest(*score)
    parts = [F.exp(s - top) for s in score]
    whole = reduce(lambda a, b: a + b, parts)
    return sums.select("row", "id", "n_tokens", *[(x / whole).alias(f"p_{d}") for x, d in zip(parts, DOMAINS, strict=True)])


def rate_column(steps: list[list[float]]) -> Column:
    """The rate after the given preconditioned residuals: each step moves it along the document's
    posterior and projects it on the nonnegative numbers."""
    rate = F.lit(1.0)
    if not steps:
        return rate
    history = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    move = lambda g: reduce(lambda a, b: a + b, [F.col(f"p_{d}") * F.element_at(g, k + 1) for k, d in enumerate(DOMAINS)])
    return F.aggregate(history, rate, lambda r, g: F.greatest(F.lit(0.0), r - move(g)))


def fit_rates(members: DataFrame, targets: dict[str, float] = TARGETS, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[list[list[float]], np.ndarray]:
    """Residual history of the projected gradient, and the domains' expected shares at its end.

    In the token-weighted metric the gradient of a document is its posterior times the residual. The
    residual is preconditioned by the inverse of H = sum of tokens * p p' over the documents whose rate is
    not at its bound (all of them at first), which is how the mix answers to a step; a step after which
    the residual has grown is followed by half a step. It raises where ``rounds`` are not enough.
    """
    p = [F.col(f"p_{d}") for d in DOMAINS]
    pairs = [(i, j) for i in range(len(p)) for j in range(i, len(p))]
    total = float(members.agg(F.sum("n_tokens")).first()[0] or 0)
    if not total:
        return [], np.zeros(len(DOMAINS))
    goal = np.array([targets[d] for d in DOMAINS], float)
    goal = goal / goal.sum() * total
    steps: list[list[float]] = []
    last, part = None, 1.0
    for _ in range(rounds):
        rated = members.withColumn("rate", rate_column(steps))
        free = F.when(F.col("rate") > 0, F.col("n_tokens")).otherwise(0)
        sums = rated.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * x).alias(d) for x, d in zip(p, DOMAINS, strict=True)], *[F.sum(free * p[i] * p[j]).alias(f"h{i}_{j}") for i, j in pairs]).first()
        mix = np.array([sums[d] for d in DOMAINS], float)
        if np.abs(mix - goal).max() <= tolerance * total:
            break
        if last is not None and np.abs(mix - last).max() <= tolerance * total:
            break  # the targets are out of reach: the least squares are reached
        part = 1.0 if last is None or np.linalg.norm(mix - goal) < np.linalg.norm(last - goal) else part / 2
        last = mix
        h = np.zeros((len(p), len(p)))
        for i, j in pairs:
            h[i, j] = h[j, i] = sums[f"h{i}_{j}"]
        steps.append((part * (np.linalg.pinv(h, rcond=1e-10) @ (mix - goal))).tolist())
    else:
        raise RuntimeError(f"fit_rates: the rates still move after {rounds} rounds")
    return steps, mix / max(mix.sum(), 1e-300)


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """(row, id, n_tokens, p_<domain>..., rate) of every row."""
    members = persist_table(posteriors(docs, labels, id_col, text_col, **fit), "members")
    steps, _ = fit_rates(members, targets)
    return members.withColumn("rate", rate_column(steps))


def mixing_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return mixing_rates(docs, labels).withColumnRenamed("id", "doc_id").drop("row")


def apply_mixing(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """Each document as often as its rate says: floor(rate + u) times, u uniform by the id's hash.
    Columns unchanged; a document of rate 1 or more always stays. Rows that repeat an id share the
    largest of their rates."""
    members = persist_table(posteriors(docs, labels, id_col, text_col, **fit), "members")
    steps, _ = fit_rates(members, targets)
    rated = members.select(F.col("id").alias("_rate_id"), rate_column(steps).alias("_rate")).groupBy("_rate_id").agg(F.max("_rate").alias("_rate"))
    joined = docs.join(rated, F.col(id_col).eqNullSafe(F.col("_rate_id")), "left")
    u = F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) / float(1 << 20)
    copies = F.floor(F.coalesce(F.col("_rate"), F.lit(1.0)) + u).cast("int")
    return joined.filter(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)
