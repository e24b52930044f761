"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents: a stage
that drops documents leaves the others as they are, and the one that removes repeated passages
rewrites `text` and `n_chars` of the documents that lose words. Rows with a null id pass like
others; exact repetitions of a row are one document from the second stage on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import decontaminate, jaccard, language_id, packing, substring_dedup
from wordloom.llm.common import learns, shared_dir
from wordloom.llm.queries import tokenizer_file


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without any language: null texts and texts without a letter."""
    model = language_id.fit(docs.filter(learns("doc_id", 3, 1)))
    found = language_id.predict(docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns if c in ("lang_pred", "score")}), model)
    kept = found.filter(F.col("lang_pred") != language_id.UNKNOWN)
    return kept.drop("lang_pred", "score").withColumnsRenamed({f"own_{c}": c for c in docs.columns if c in ("lang_pred", "score")})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that Jaccard links (five words, 0.8) connect.

    Documents are joined and told apart by one key, a hash of id and text, so their texts are shuffled once.
    """
    found = jaccard.similar(docs, shingle=5, num=80).withColumn("one", F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    # Each group's least document, by map-side minima: the rows of a large group never meet in one task.
    kept = found.filter("root is not null").groupBy("root").agg(F.min("one").alias("one")).select("one.doc_id", "one.text_key")
    kept = kept.unionByName(found.filter("root is null").select("doc_id", "text_key"))
    kept = kept.select(F.xxhash64("doc_id", F.coalesce("text_key", F.lit(0))).alias("__key")).distinct()
    keyed = docs.withColumn("__text", F.xxhash64(F.col("text").cast("string")))
    keyed = keyed.withColumn("__key", F.xxhash64("doc_id", F.coalesce("__text", F.lit(0))))
    return keyed.join(kept, "__key", "left_semi").dropDuplicates(["__key", "doc_id", "__text"]).drop("__key", "__text")


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of 50-word windows that a document with a smaller id also holds; documents left without a word go."""
    found = substring_dedup.deduplicate(docs).filter("n_removed > 0").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("kept_text").alias("__kept"))
    keyed = docs.withColumn("__text", F.xxhash64(F.col("text").cast("string")))
    both = keyed.join(found.dropDuplicates(["__id", "__key"]), (F.col("doc_id") == F.col("__id")) & (F.col("__text") == F.col("__key")), "left")
    both = both.filter("__kept is null or __kept <> ''")
    kept = lambda c, new: F.when(F.col("__kept").isNotNull(), new).otherwise(F.col(c)).alias(c)
    new = {"text": F.col("__kept"), "n_chars": F.length("__kept")}
    return both.select(*[kept(c, new[c].cast(docs.schema[c].dataType)) if c in new else F.col(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a ten-word window of a benchmark item."""
    return decontaminate.without_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("decontaminate", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL has no tokenizer and no kernel regression; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
