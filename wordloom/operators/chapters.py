"""Books into chapters, chapters into measures, measures into a book's structure."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as T


def numbered(rows: DataFrame, key: str, at: str, name: str, block: int = 65_536) -> DataFrame:
    """rows with each one's number (from 1) among its key's, in order of the integer `at`, which names a row.

    Only ids are ranked: inside blocks of ids first, then the blocks' sizes are summed up, so a key
    with a third of all rows is not one task, and no text is sorted.
    """
    ids = rows.select(F.col(key).alias("k"), F.col(at).alias("at"), F.floor(F.col(at) / block).alias("b"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("k").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = ids.groupBy("k", "b").agg(F.count("*").alias("n")).select(F.col("k").alias("k2"), F.col("b").alias("b2"), before.alias("before"))
    inside = ids.withColumn("rn", F.row_number().over(W.partitionBy("k", "b").orderBy("at")))
    ranked = inside.join(sizes, F.col("k").eqNullSafe(F.col("k2")) & (F.col("b") == F.col("b2"))).select(F.col("at").alias(at), (F.col("before") + F.col("rn")).cast("int").alias(name))
    return rows.join(ranked.hint("merge"), at)


def heading(line: Column) -> tuple[Column, Column]:
    """(order, title) of a heading line; order is null where the line is none."""
    m = lambda i: F.regexp_extract(line, V.HEADING, i)
    title, separated = m(4), m(3) != ""
    prose = F.when(separated, title.contains("。") | ((F.length(title) > V.UNSEPARATED_CHARS) & title.rlike("[，,]"))).otherwise(
        (F.length(title) > V.UNSEPARATED_CHARS) | title.rlike("[，,。！？!?…]")
    )
    fits = line.rlike(V.HEADING) & (F.length(title) <= V.HEADING_CHARS) & ~prose
    return F.when(fits, T.numeral(m(1))), F.when(fits, title)


def split(books: DataFrame, book: str = "book") -> DataFrame:
    """book, pos, ord, title, line_no, start, stop, text: one row per heading; a repeated number keeps both chapters.

    Everything happens inside a book's own row (arrays of lines and offsets), so no shuffle is needed.
    """
    # Each line with its end; offsets are sums of lengths before it.
    rows = F.regexp_extract_all("text", F.lit("([^\n]*\n|[^\n]+\\z)"), 1)
    start = F.struct(F.lit(0).alias("upto"), F.lit(1).alias("n"), F.array().cast("array<struct<line_no:int,start:int,ord:int,title:string>>").alias("heads"))

    def step(a: Column, line: Column) -> Column:
        order, title = heading(T.stripped(line))
        head = F.struct(a["n"].alias("line_no"), a["upto"].alias("start"), order.alias("ord"), title.alias("title"))
        heads = F.when(line.contains("第"), F.when(order.isNotNull(), F.concat(a["heads"], F.array(head))).otherwise(a["heads"])).otherwise(a["heads"])
        return F.struct((a["upto"] + F.length(line)).alias("upto"), (a["n"] + 1).alias("n"), heads.alias("heads"))

    found = books.select(F.col(book).alias("book"), "text", F.aggregate(rows, start, step, lambda a: a["heads"]).alias("heads"))
    each = found.select("book", "text", "heads", F.posexplode("heads").alias("pos", "h"))
    stop = F.coalesce(F.get("heads", F.col("pos") + 1)["start"], F.length("text"))
    each = each.select("book", "pos", "h.*", stop.alias("stop"), "text")
    return each.select("book", "pos", "ord", "title", "line_no", "start", "stop", F.substring(F.col("text"), F.col("start") + 1, F.col("stop") - F.col("start")).alias("text"))


def warnings(chapters: DataFrame) -> DataFrame:
    """book, repeated (numbers met before, with the last line they stood on), contiguous (1..n), preamble_chars."""
    by_number = W.partitionBy("book", "ord").orderBy("pos")
    seen = chapters.withColumn("before", F.lag("line_no").over(by_number))
    return seen.groupBy("book").agg(
        F.count("before").alias("repeated"),
        F.sum("before").alias("repeated_lines"),
        F.bool_and(F.col("ord") == F.col("pos") + 1).alias("contiguous"),
        F.min("start").alias("preamble_chars"),
    )


def body(text: Column) -> tuple[Column, Column]:
    """(text after the title line, its offset)."""
    at = F.position(F.lit("\n"), text)
    return F.substring(text, at + 1, F.length(text)), at


def triggers(text: Column, among: Column | None = None) -> Column:
    """Names of the conflict rules whose words the text holds, in order; `among` tells which rules a longer text around it holds at all."""
    may = lambda i: F.lit(True) if among is None else F.get(among, F.lit(i))
    return F.filter(F.array(*[F.when(may(i) & T.holds(text, p), k) for i, (k, p) in enumerate(V.TRIGGERS.items())]), lambda x: x.isNotNull())


def _among(texts: pa.Array) -> pa.Array:
    """Which rules a text holds at all: a hundred words looked for in whole texts, which Spark's patterns and `contains` take most of a chapter's time for."""
    rules = [re.compile(p) for p in V.TRIGGERS.values()]
    return pa.array([[x is not None and r.search(x) is not None for r in rules] for x in texts.to_pylist()], pa.list_(pa.bool_()))


def _flags(x: Column) -> dict[str, Column]:
    """What a sentence is besides its triggers."""
    return {
        "n": F.length(T.unspaced(x)),
        "dialogue": x.rlike(V.DIALOGUE),
        "exclaim": T.holds(x, "！|!"),
        "question": T.holds(x, "？|?"),
        "unpunct": ~T.ends_in(x, "。！？!?…"),
    }


def _anchors(body: Column, base: Column, among: Column) -> Column:
    """The first sentences with triggers and their places: a fold over the sentences that keeps only these."""
    kind = "array<struct<start:int,end:int,n:int,dialogue:boolean,exclaim:boolean,question:boolean,unpunct:boolean,triggers:array<string>>>"
    start = F.struct(base.cast("int").alias("upto"), F.array().cast(kind).alias("out"))

    def step(a: Column, p: Column) -> Column:
        x = T.stripped(p)
        at = a["upto"] + F.length(p) - F.length(F.ltrim(p, F.lit(T.BLANKS)))
        found = F.struct(at.alias("start"), (at + F.length(x)).alias("end"), *[v.alias(k) for k, v in _flags(x).items()], triggers(x, among).alias("triggers"))
        hit = (F.size(a["out"]) < V.ANCHORS) & (F.size(triggers(p, among)) > 0)
        return F.struct((a["upto"] + F.length(p)).alias("upto"), F.when(hit, F.concat(a["out"], F.array(found))).otherwise(a["out"]).alias("out"))

    return F.aggregate(T.sentence_parts(body), start, step, lambda a: a["out"])


def measures(chapters: DataFrame, *keep: str) -> DataFrame:
    """The chapters' measures: lengths and shares of sentences, hooks, anchors; one row a chapter, no shuffle."""
    inside, base = body(F.col("text"))
    s = chapters.select(*keep, "text", inside.alias("body"), base.alias("base"))
    s = s.withColumn("among", F.arrow_udf(_among, "array<boolean>")("body"))
    hit = lambda x: F.size(triggers(x, F.col("among"))) > 0
    s = s.withColumn("s", F.transform(T.sentence_texts("body"), lambda x: F.struct(*[v.alias(k) for k, v in _flags(x).items()], hit(x).alias("hit"))))
    n = F.size("s")
    part = lambda test: F.when(n > 0, F.size(F.filter("s", test)) / n).otherwise(F.lit(0.0))
    half = (F.size("lengths") / 2).cast("int")
    median = F.when(F.size("lengths") == 0, 0.0).when(F.size("lengths") % 2 == 1, F.get("lengths", half).cast("double")).otherwise((F.get("lengths", half - 1) + F.get("lengths", half)) / 2.0)
    suspense = "|".join(V.TRIGGERS[k] for k in V.SUSPENSE)
    s = s.withColumn("lengths", F.array_sort(F.transform("s", lambda x: x["n"]))).withColumn("hits", F.size(F.filter("s", lambda x: x["hit"])))
    return s.select(
        *keep,
        F.length(T.unspaced("text")).alias("char_count"),
        n.alias("sentence_count"),
        T.mean(F.transform("lengths", lambda x: x.cast("double"))).alias("avg_sentence_chars"),
        median.alias("median_sentence_chars"),
        F.coalesce(F.array_min("lengths"), F.lit(0)).alias("min_sentence_chars"),
        F.coalesce(F.array_max("lengths"), F.lit(0)).alias("max_sentence_chars"),
        part(lambda x: x["n"] <= V.SHORT_SENTENCE).alias("short_sentence_ratio"),
        part(lambda x: x["n"] > V.LONG_SENTENCE).alias("long_sentence_ratio"),
        part(lambda x: x["dialogue"]).alias("dialogue_sentence_ratio"),
        part(lambda x: x["exclaim"]).alias("exclaim_ratio"),
        part(lambda x: x["question"]).alias("question_ratio"),
        part(lambda x: x["unpunct"]).alias("no_punct_sentence_ratio"),
        F.size(F.filter(F.split("body", "\n"), lambda p: T.stripped(p) != "")).alias("paragraph_count"),
        F.left("body", F.lit(V.WINDOW_CHARS)).rlike(suspense).alias("opening_hook_signal"),
        F.right("body", F.lit(V.WINDOW_CHARS)).rlike(suspense).alias("closing_hook_signal"),
        _anchors(F.col("body"), F.col("base"), F.col("among")).alias("anchors"),
        F.least("hits", F.lit(V.ANCHORS)).alias("anchor_count"),
        (F.col("hits") > V.ANCHORS).alias("anchors_overflow"),
    )


def structure(measured: DataFrame) -> DataFrame:
    """A book's totals and sentence-weighted means (book, ord and the measures in; one row a book out).

    Chapters are summed by book and median first, with map-side sums; both the totals and the lower
    weighted median come from those few rows, so the measures are made once and no text moves.
    """
    weighed = {"avg_sentence_chars": "avg_sentence_chars", "dialogue_sentence_ratio": "avg_dialogue_ratio", "short_sentence_ratio": "short_sentence_ratio", "long_sentence_ratio": "long_sentence_ratio"}
    some = measured.groupBy("book", F.col("median_sentence_chars").alias("middle")).agg(
        F.count("*").alias("chapters"),
        F.sum("char_count").alias("chars"),
        F.sum("anchor_count").alias("anchors"),
        F.sum("sentence_count").alias("w"),
        *[F.sum(F.col(c) * F.col("sentence_count")).alias(f"sum_{c}") for c in weighed],
    )
    upto = F.sum("w").over(W.partitionBy("book").orderBy("middle").rowsBetween(W.unboundedPreceding, 0))
    some = some.withColumn("upto", upto).withColumn("total", F.sum("w").over(W.partitionBy("book")))
    total, chars = F.sum("w"), F.sum("chars")
    return some.groupBy("book").agg(
        F.sum("chapters").alias("chapters"),
        chars.alias("total_chars"),
        (chars / F.sum("chapters")).alias("avg_chapter_chars"),
        *[F.when(total > 0, F.sum(f"sum_{c}") / total).otherwise(0.0).alias(name) for c, name in weighed.items()],
        F.when(chars > 0, F.sum("anchors") / chars * 1000).otherwise(0.0).alias("per_thousand_conflicts"),
        F.coalesce(F.min(F.when((F.col("w") > 0) & (F.col("upto") >= F.col("total") / 2), F.col("middle"))), F.lit(0.0)).alias("median_sentence_chars"),
    )


def lower_weighted_median(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """The first value whose cumulative weight reaches half; equal values are summed first, so a window holds distinct values only."""
    sums = rows.filter(F.col(weight) > 0).groupBy(key, value).agg(F.sum(weight).alias("w"))
    upto = W.partitionBy(key).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    run = sums.select(key, value, F.sum("w").over(upto).alias("upto"), F.sum("w").over(W.partitionBy(key)).alias("total"))
    return run.filter(F.col("upto") >= F.col("total") / 2).groupBy(key).agg(F.min(value).alias(value))


def densities(measured: DataFrame) -> DataFrame:
    """book, ord, density: conflicts a thousand characters; of a repeated number the last chapter counts."""
    one = measured.groupBy("book", "ord").agg(F.max_by(F.struct("anchor_count", "char_count"), "pos").alias("c"))
    return one.select("book", "ord", F.when(F.col("c.char_count") > 0, F.col("c.anchor_count") / F.col("c.char_count") * 1000).otherwise(0.0).alias("density"))


def quiet(measured: DataFrame) -> DataFrame:
    """book, ord of chapters below half of their book's density, in order of first occurrence (at)."""
    book = measured.groupBy("book").agg((F.sum("anchor_count") / F.sum("char_count") * 1000).alias("mean"))
    low = measured.filter("char_count > 0").join(book, "book").filter(F.col("anchor_count") / F.col("char_count") * 1000 < F.col("mean") / 2)
    return low.groupBy("book", "ord").agg(F.min("pos").alias("at"))


def flagged(measured: DataFrame, flag: str) -> DataFrame:
    """book, ords: numbers of flagged chapters, each once, in order of first occurrence."""
    first = measured.filter(flag).groupBy("book", "ord").agg(F.min("pos").alias("at"))
    return first.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ord"))), lambda x: x["ord"]).alias("ords"))
