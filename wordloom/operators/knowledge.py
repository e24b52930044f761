"""A knowledge base of documents: what is taken in, how it is cut, what a search shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as T


def decision(path: Column, size: Column, text: Column) -> Column:
    """struct(included, reason): the first rule that fits a file decides."""
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    plain = suffix == ".txt"
    head = F.split(F.left(text, F.lit(V.SCAN_CHARS)), "\n")
    chapter_lines = F.size(F.filter(head, lambda x: x.rlike(f"(?U){V.CHAPTER_LINE}")))
    terms = T.count(F.left(text, F.lit(V.SCAN_CHARS)), V.ANALYSIS_WORDS)
    novel = suffix.isin(".md", ".txt") & ~path.rlike(V.ANALYSIS_PATH) & (chapter_lines >= V.CHAPTER_LINES) & (terms < V.ANALYSIS_TERMS)
    out = lambda keep, reason: F.struct(F.lit(keep).alias("included"), F.lit(reason).alias("reason"))
    return (
        F.when(F.array_contains(F.split(path, "/"), "原文"), out(False, "origin_folder"))
        .when(name.endswith(".progress.json"), out(False, "collector_cache"))
        .when(plain & name.rlike(V.BOOK_AUTHOR), out(False, "book_author_name"))
        .when(plain & name.contains("原文"), out(False, "origin_name"))
        .when(plain & name.rlike(V.FRONT_CHAPTERS), out(False, "front_chapters"))
        .when(plain & name.rlike(V.SINGLE_CHAPTER), out(False, "single_chapter"))
        .when(~suffix.isin(*V.SUFFIXES), out(False, "suffix"))
        .when(plain & (size > V.FILE_BYTES), out(False, "too_large"))
        .when(novel, out(False, "novel_text"))
        .otherwise(out(True, "included"))
    )


def chunks(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, index, heading, text: blocks that end at headings, blank lines or their length; long ones are cut with overlap.

    A fold over the lines of one document, in its own row; blocks of just a heading are left out.
    """
    clean = F.transform(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n"), lambda x: F.btrim(F.regexp_replace(x, "[ \t　]+", " ")))
    start = F.struct(F.array().cast("array<struct<text:string,heading:string>>").alias("out"), F.lit("").alias("held"), F.lit(0).alias("size"), F.lit("").alias("heading"), F.lit("").alias("pending"))

    def given(a: Column) -> Column:
        full = (F.btrim(a["held"]) != "") & (F.btrim(a["held"]) != F.btrim(a["pending"]))
        return F.when(full, F.concat(a["out"], F.array(F.struct(a["held"].alias("text"), a["heading"].alias("heading"))))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        head = x.rlike(r"^#{1,6}\s+\S")
        cut = (x == "") | head
        out = F.when(cut, given(a)).otherwise(a["out"])
        heading = F.when(head, F.btrim(F.regexp_replace(x, "^#+", ""))).otherwise(a["heading"])
        held = F.when(cut, x).when(a["held"] == "", x).otherwise(F.concat(a["held"], F.lit("\n"), x))
        size = F.when(x == "", 0).when(head, F.length(x) + 1).otherwise(a["size"] + F.length(x) + 1)
        pending = F.when(x == "", "").when(head, x).otherwise(a["pending"])
        state = F.struct(out.alias("out"), held.alias("held"), size.alias("size"), heading.alias("heading"), pending.alias("pending"))
        done = F.struct(given(state).alias("out"), F.lit("").alias("held"), F.lit(0).alias("size"), state["heading"].alias("heading"), F.lit("").alias("pending"))
        return F.when(state["size"] >= V.CHUNK_TARGET, done).otherwise(state)

    blocks = F.aggregate(clean, start, step, given)
    stride = V.CHUNK_MAX - V.CHUNK_OVERLAP
    pieces = lambda b: F.when(F.length(b["text"]) <= V.CHUNK_MAX, F.array(b)).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.ceil((F.length(b["text"]) - V.CHUNK_MAX) / stride)),
            lambda i: F.struct(F.btrim(F.substring(b["text"], (i * stride + 1).cast("int"), F.lit(V.CHUNK_MAX))).alias("text"), b["heading"].alias("heading")),
        )
    )
    found = F.filter(F.flatten(F.transform(blocks, pieces)), lambda b: b["text"] != "")
    return docs.select(*keep, F.posexplode(found).alias("index", "c")).select(*keep, "index", F.col("c.heading").alias("heading"), F.col("c.text").alias("text"))


def chunk_id(path: Column, index: Column) -> Column:
    return F.concat(F.lit("kb-"), F.left(F.sha1(path.cast("binary")), F.lit(12)), F.format_string("-%04d", index))


def manifest(files: DataFrame) -> DataFrame:
    """path, included, reason of every file (path, size, text)."""
    return files.select("path", decision(F.col("path"), F.col("size"), F.col("text")).alias("d")).select("path", "d.*")


def rendered(hits: DataFrame) -> DataFrame:
    """query_id, block: the hits of each query, numbered, with source and heading, clipped (bounded by top-k)."""
    text = F.when(F.length("text") > V.SNIPPET_CHARS, F.concat(F.left("text", F.lit(V.SNIPPET_CHARS)), F.lit("…"))).otherwise(F.col("text"))
    line = F.concat(F.col("rank").cast("string"), F.lit(". 来源 "), "source", F.lit(" "), F.when(F.col("heading") != "", F.concat(F.lit("《"), "heading", F.lit("》"))).otherwise(""), F.lit("\n   "), text)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return hits.groupBy("query_id").agg(F.array_join(ordered, "\n").alias("block"))
