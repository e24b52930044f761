"""BM25 retrieval over a table of documents, and its evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as T


def postings(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """doc_id, term, tf, length: one row per document and term. The length rides along, so scoring joins nothing for it."""
    t = docs.select(F.col(doc).alias("doc_id"), T.tokens(text).alias("terms"))
    each = t.select("doc_id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return each.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def term_statistics(found: DataFrame) -> DataFrame:
    """term, df: documents of each term."""
    return found.groupBy("term").agg(F.count("*").alias("df"))


def corpus_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: n documents, avgdl."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(T.tokens(text))).alias("avgdl"))


def idf(df: Column, n: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame, query: str = "query_id", text: str = "text", boost: dict[str, float] | None = None) -> DataFrame:
    """query_id, term, weight: a term that a query repeats counts as often; controlled terms weigh more."""
    boost = {t: V.TERM_BOOST for t in [*V.TONES, *V.THEMES]} if boost is None else boost
    each = queries.select(F.col(query).alias("query_id"), F.explode(T.tokens(text)).alias("term"))
    weight = F.lit(1.0)
    for value in sorted(set(boost.values())):
        weight = F.when(F.col("term").isin([t for t, v in boost.items() if v == value]), value).otherwise(weight)
    return each.groupBy("query_id", "term").agg((F.count("*") * F.first(weight)).alias("weight"))


def scores(docs: DataFrame, queries: DataFrame, query: str = "query_id", k1: float = V.BM25_K1, b: float = V.BM25_B, boost: dict[str, float] | None = None) -> DataFrame:
    """query_id, doc_id, score for every pair that shares a term (all positive)."""
    return scores_from(postings(docs), corpus_statistics(docs), queries, query, k1, b, boost)


def scores_from(found: DataFrame, corpus: DataFrame, queries: DataFrame, query: str = "query_id", k1: float = V.BM25_K1, b: float = V.BM25_B, boost: dict[str, float] | None = None) -> DataFrame:
    """The scores of queries against postings and corpus statistics, such as those of a saved index.

    The query side is small and grouped by term first; only postings of its terms survive the
    semi-join, before statistics of terms and corpus are joined.
    """
    terms = query_terms(queries, query, boost=boost)
    hit = found.join(terms.select("term").distinct(), "term", "left_semi")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    n, avgdl = (corpus.select(c).scalar() for c in ("n", "avgdl"))
    norm = F.when(avgdl > 0, 1 - b + b * F.col("length") / avgdl).otherwise(1.0)
    weighed = hit.join(df, "term").join(terms, "term")
    part = F.col("weight") * idf(F.col("df"), n) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * norm)
    return weighed.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def top(scored: DataFrame, k: int = V.TOP_K) -> DataFrame:
    """The k best documents of each query; ties go to the smaller doc_id."""
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return scored.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def recall(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, relevant, hits, recall (six digits) for each query that has gold (query_id, doc_id)."""
    met = ranked.select("query_id", "doc_id").distinct().withColumn("met", F.lit(True))
    each = gold.join(met, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count("*").alias("relevant"), F.count("met").alias("hits"))
    return each.select("query_id", "relevant", "hits", F.round(F.col("hits") / F.col("relevant"), 6).alias("recall"))


def macro(recalls: DataFrame) -> DataFrame:
    """One row: cases and the mean of their recalls, each case weighing the same (0 without cases)."""
    return recalls.agg(F.count("*").alias("cases"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("macro_recall"))


def save_index(docs: DataFrame, path: str) -> None:
    """Write postings (in order of term within a file, so scans skip by term) and each document's length under the path."""
    postings(docs).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    docs.select("doc_id", F.size(T.tokens("text")).alias("length")).write.mode("overwrite").parquet(f"{path}/lengths")


def load_index(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """postings and corpus statistics of a saved index; statistics are made anew from the lengths."""
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths").agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))
