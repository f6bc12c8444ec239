"""Ranked lexical retrieval: BM25, TF-IDF cosine, rank fusion, reranking, query expansion, weighted substring scores.

An index is three small relations (postings, document statistics, term statistics); a search is an equi-join of query
terms with postings. Nothing is scored that shares no term with a query. Statistics are those of the whole corpus, also where a
filter restricts the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import materialise

K1, B = 1.5, 0.75
RRF_K = 60


@dataclass
class Index:
    """``postings``: ``id, term, tf``; ``docs``: ``id, dl, norm``; ``terms``: ``term, df``; ``corpus``: one row ``n, avgdl``."""

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    corpus: DataFrame


def build_index(docs: DataFrame, tokens: Column, id_col: str = "id") -> Index:
    """Index of the token column; documents without tokens count in ``n`` and the mean length. Null ids aren't allowed; ids are unique.

    Texts are tokenised once; postings, lengths and norms of the weights are written to the shared folder, so that both arms of a
    search and any number of searches read them.
    """
    each = materialise(docs.select(F.col(id_col).alias("id"), tokens.alias("tokens")), "tokens")
    postings = materialise(each.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    lengths = each.select("id", F.size("tokens").alias("dl"))
    corpus = lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    weights = postings.join(terms, "term").join(F.broadcast(corpus)).select("id", ((1.0 + F.log("tf")) * _idf()).alias("w"))
    norms = weights.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return Index(postings, materialise(lengths.join(norms, "id", "left"), "docs"), terms, materialise(corpus, "corpus"))


def save_index(index: Index, folder: str) -> None:
    """Writes the four tables; postings and terms are sorted by term, so that a search reads few row groups."""
    index.postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/postings")
    index.terms.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/terms")
    index.docs.write.mode("overwrite").parquet(f"{folder}/docs")
    index.corpus.write.mode("overwrite").parquet(f"{folder}/corpus")


def load_index(spark: SparkSession, folder: str) -> Index:
    return Index(*(spark.read.parquet(f"{folder}/{t}") for t in ("postings", "docs", "terms", "corpus")))


def _idf() -> Column:
    return F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0


def query_terms(queries: DataFrame, tokens: Column, id_col: str = "qid") -> DataFrame:
    """``qid, term, qm``: the terms of each query with their multiplicity."""
    return queries.select(F.col(id_col).alias("qid"), F.explode(tokens).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qm"))


def top_k(scored: DataFrame, k: int, score: str = "score", by: str = "qid", tie: str = "id", rank: str = "rank") -> DataFrame:
    """The best ``k`` of each query, ties by id."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def bm25(index: Index, q: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """``qid, id, score`` of every pair with a common term. ``allowed``: ids that may be found, with statistics unchanged."""
    asked = q.join(index.terms, "term").join(F.broadcast(index.corpus))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    asked = asked.select("qid", "term", "qm", idf.alias("idf"), "avgdl")
    postings = index.postings if allowed is None else index.postings.join(allowed.select("id").distinct(), "id", "left_semi")
    tf = F.col("tf").cast("double")
    part = F.col("qm") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    met = postings.join(asked, "term").join(index.docs, "id")
    return met.groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")


def tfidf(index: Index, q: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """``qid, id, score``: cosine of weights (1 + ln tf)(ln((n + 1)/(df + 1)) + 1); unknown query terms count nowhere."""
    asked = q.join(index.terms, "term").join(F.broadcast(index.corpus)).withColumn("idf", _idf())
    asked = asked.select("qid", "term", "idf", ((1.0 + F.log("qm")) * F.col("idf")).alias("qw"))
    qnorms = asked.groupBy("qid").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    postings = index.postings if allowed is None else index.postings.join(allowed.select("id").distinct(), "id", "left_semi")
    dots = postings.join(asked, "term").groupBy("qid", "id").agg(F.sum((1.0 + F.log("tf")) * F.col("idf") * F.col("qw")).alias("dot")).where("dot > 0")
    return dots.join(index.docs, "id").join(qnorms, "qid").select("qid", "id", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 6).alias("score"))


def fuse(first: DataFrame, second: DataFrame) -> DataFrame:
    """``qid, id, rank_a, rank_b, rrf, fused_rank`` of two ranked arms; an arm that lacks the document has a null rank."""
    both = first.select("qid", "id", F.col("rank").alias("rank_a")).join(second.select("qid", "id", F.col("rank").alias("rank_b")), ["qid", "id"], "full_outer")
    one = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf", F.round(one("rank_a") + one("rank_b"), 9))
    w = Window.partitionBy("qid").orderBy(F.desc("rrf"), F.asc_nulls_last("rank_a"), F.asc_nulls_last("rank_b"), F.asc("id"))
    return both.withColumn("fused_rank", F.row_number().over(w))


# Weights of the severities in reranking.
SEVERITY_WEIGHT = {"SEV_CRITICAL": 1.3, "SEV_HIGH": 1.15, "SEV_MEDIUM": 1.0, "SEV_LOW": 0.9}


def rerank(fused: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, id, final_score``: fused candidates by hits of the query's own terms in title and keywords, severity, agreement of the arms and fusion score.

    ``docs``: ``id, title, keyword_text, severity``; ``queries``: ``qid, terms`` (different tokens of two characters or more, else all).
    """
    met = fused.join(docs, "id").join(queries, "qid")
    n = F.greatest(F.size("terms"), F.lit(1))
    hits = lambda c: F.size(F.filter("terms", lambda t: F.contains(F.coalesce(F.col(c), F.lit("")), t))) / n
    weight = F.coalesce(F.element_at(F.create_map(*(x for k, v in SEVERITY_WEIGHT.items() for x in (F.lit(k), F.lit(v)))), F.coalesce("severity", F.lit(""))), F.lit(1.0))
    only = F.coalesce("rank_a", "rank_b")
    dual = F.when(F.col("rank_a").isNotNull() & F.col("rank_b").isNotNull(), 1.0 / (1.0 + 0.2 * ((F.col("rank_a") + F.col("rank_b")) / 2.0))).otherwise(0.5 / (1.0 + 0.2 * only))
    score = 0.40 * hits("title") + 0.30 * hits("keyword_text") + 0.10 * (weight - 0.9) / 0.4 + 0.20 * dual + 0.5 * F.col("rrf")
    return met.select("qid", "id", F.round(score, 5).alias("final_score"), "rank_a", "rank_b", "fused_rank")


def expand(queries: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``qid, question, added, expanded``: terms of all ``rules`` (pattern, terms separated by blanks) that fire, in rule order, each once, without those the question holds.

    The rules are literal patterns, each compiled once; a theta join with a table of patterns would compile per row.
    """
    hits = [F.when(F.col("question").rlike(p), F.split(F.lit(t), " ")).otherwise(F.array().cast("array<string>")) for p, t in rules]
    terms = F.filter(F.array_distinct(F.flatten(F.array(*hits))), lambda t: ~F.contains(F.col("question"), t))
    out = queries.withColumn("added", terms)
    return out.withColumn("expanded", F.when(F.size("added") > 0, F.concat_ws(" ", "question", F.array_join("added", " "))).otherwise(F.col("question")))


def contained(entries: DataFrame, vocabulary: list[str], columns: dict[str, int]) -> DataFrame:
    """``id, word, points``: for each word of a vocabulary of known size, the sum of the points of the columns that hold it; rows without points are left out.

    A join on ``contains`` would be a nested loop over queries; a query's words are equi-joined with this instead.
    """
    words = F.array(*(F.struct(F.lit(w).alias("word"), sum((F.when(F.contains(F.coalesce(c, F.lit("")), F.lit(w)), p).otherwise(0) for c, p in columns.items()), F.lit(0)).alias("points")) for w in vocabulary))
    return entries.select("id", F.explode(F.filter(words, lambda x: x["points"] > 0)).alias("x")).select("id", "x.word", "x.points")


def occurrences(text: Column, needle: str) -> Column:
    """Number of occurrences that don't overlap."""
    return (F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / F.lit(len(needle))
