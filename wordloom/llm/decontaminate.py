"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of `size` words (an item of fewer words, but not none, is one
window). Shingles are ordered by rarity, as counted over all documents. For full containment the
necessary prefix of a window is its single rarest word: a document can only hold the window where
it holds that word. So every document word that is some window's rarest word gives a candidate;
the word's place in the window and the document's length bound where the window can lie, and the
slice there is compared word by word. Documents are read once for the counts and once for the
join, and are never shuffled: only hits and one row per document leave the scan.

The windows are sent to all tasks in blocks of BLOCK_WINDOWS rows, so what is broadcast has a
fixed bound; a larger benchmark takes more passes.

Edge cases: null texts have no words; an empty benchmark hits nothing; repeated rows are returned
as often as they come; a null item_id counts as no named item, but its windows still hit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SIZE = 10
BLOCK_WINDOWS = 200_000
#: Stands at the end of every document's words, so that each document leaves the scan at least once.
_END = " "

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column | str) -> Column:
    """Lower-cased (A-Z) words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+: runs of ASCII letters, digits and all beyond ASCII."""
    c = F.col(text) if isinstance(text, str) else text
    blank = F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(blank, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """item_id, win (its words) for every window of every item."""
    w = items.select(F.col("item_id"), words(F.col("text").cast("string")).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - size + 1, F.lit(1)))
    return w.select("item_id", "ws", F.explode(starts).alias("i")).select("item_id", F.slice("ws", F.col("i"), size).alias("win"))


def _blocks(found: DataFrame, limit: int) -> list[DataFrame]:
    """The windows in parts that are small enough to be sent to all tasks."""
    n = found.count()
    k = max(1, -(-n // (limit // 2)))  # hashed parts vary around their mean
    return [found.filter(F.pmod(F.xxhash64("win"), F.lit(k)) == i) if k > 1 else found for i in range(k)]


def contaminated(docs: DataFrame, items: DataFrame, size: int = SIZE, block: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_words (spans of hit words)."""
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    # The same window may be in many items and items may repeat: each distinct window is sought once.
    distinct = windows(items, size).groupBy("win").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    parts = _blocks(distinct, block)
    per_part = [_hits(docs, part, size, first=(i == 0)) for i, part in enumerate(parts)]
    hits = reduce(DataFrame.unionByName, per_part)
    key = ["doc_id", "text_hash", "n_words"]
    per_doc = hits.groupBy(*key).agg(
        F.count_if("is_end").alias("copies"),
        F.collect_set(F.when(~F.col("is_end"), F.struct("at", "len"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"),
    )
    # Hit words: the union of [at, at + len), summed over spans in order of their places.
    union = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<at:int,end:int>>").alias("runs")),
        lambda a, s: F.struct(
            F.greatest(a["upto"], s["at"] + s["len"]).alias("upto"),
            (a["n"] + F.greatest(F.lit(0), s["at"] + s["len"] - F.greatest(a["upto"], s["at"]))).alias("n"),
            F.when(
                (F.size(a["runs"]) > 0) & (s["at"] <= a["upto"]),
                F.concat(
                    F.slice(a["runs"], 1, F.greatest(F.size(a["runs"]) - 1, F.lit(0))),
                    F.array(F.struct(F.element_at(a["runs"], -1)["at"].alias("at"), F.greatest(a["upto"], s["at"] + s["len"]).alias("end"))),
                ),
            )
            .otherwise(F.concat(a["runs"], F.array(F.struct(s["at"].alias("at"), (s["at"] + s["len"]).alias("end")))))
            .alias("runs"),
        ),
    )
    out = per_doc.withColumn("u", union).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("u.n").cast("long").alias("n_hit"),
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
        (F.col("u.n") > 0).alias("contaminated"),
        F.col("u.runs").alias("hit_words"),
    )


def _counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, n: how often the windows' words occur in all documents."""
    return docs.select(F.explode(words("text")).alias("word")).join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))


def _hits(docs: DataFrame, part: DataFrame, size: int, first: bool) -> DataFrame:
    """doc_id, text_hash, n_words, at (from 0), len, items, is_end for each occurrence of a window, and one end row a document (in the first part)."""
    spread = part.select("win", "items", F.posexplode("win").alias("place", "word"))
    counts = _counts(docs, spread.select("word").distinct())
    ranked = spread.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = ranked.withColumn("r", F.row_number().over(W.partitionBy("win").orderBy("n", "word", "place"))).filter("r = 1")
    # One row a prefix word: its windows, each with the word's place.
    prefix = rarest.select("word", F.struct("win", "items", F.col("place").alias("place")).alias("w"))
    if first:
        blank = F.struct(F.array().cast("array<string>").alias("win"), F.array().cast("array<string>").alias("items"), F.lit(0).alias("place"))
        prefix = prefix.unionByName(docs.sparkSession.range(1).select(F.lit(_END).alias("word"), blank.alias("w")))
    scanned = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words("text").alias("ws"))
    each = scanned.select("doc_id", "text_hash", "ws", F.posexplode(F.concat("ws", F.array(F.lit(_END)))).alias("pos", "word"))
    at = F.col("pos") - F.col("w.place")
    length = F.size("w.win")
    fits = (at >= 0) & (at + length <= F.size("ws"))
    met = each.join(F.broadcast(prefix), "word").filter(
        F.when(F.col("word") == _END, F.lit(True)).otherwise(fits & (F.slice("ws", F.when(fits, at + 1).otherwise(F.lit(1)), length) == F.col("w.win")))
    )
    return met.select("doc_id", "text_hash", F.size("ws").alias("n_words"), at.alias("at"), length.alias("len"), F.col("w.items").alias("items"), (F.col("word") == _END).alias("is_end"))


def without_hits(docs: DataFrame, items: DataFrame, most: float = 0.0, size: int = SIZE) -> DataFrame:
    """docs without the documents of which more than the share `most` of words is hit."""
    found = contaminated(docs, items, size).filter(F.col("n_hit") > most * F.col("n_words")).select("doc_id").distinct()
    return docs.join(found.withColumnRenamed("doc_id", "__hit"), docs["doc_id"].eqNullSafe(F.col("__hit")), "left_anti")
