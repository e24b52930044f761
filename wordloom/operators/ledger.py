"""Hooks that chapters open and later chapters resolve, and the context a new chapter is written in."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import hashed as H
from ..functions import text as T
from ..sources import shared


#: Chapters of a block in which hooks are looked for, hooks of a cell, chapters of a block of open intervals.
BLOCK_CHAPTERS, CELL_HOOKS, OPEN_BLOCK = 1024, 32_768, 64


def _needed(n: int, threshold: float) -> int:
    """The least number of a hook's n tokens whose share reaches the threshold."""
    c = math.ceil(threshold * n)
    while c and (c - 1) / n >= threshold:
        c -= 1
    while c / n < threshold:
        c += 1
    return c


def _earliest(threshold: float):
    """For hooks and a block of chapters (later, h): each hook's first later chapter of the block that shares enough of its tokens."""

    def run(key: tuple, hooks: pa.Table, chapters: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if hooks.num_rows and chapters.num_rows:
            order = np.argsort(chapters["later"].to_numpy(), kind="stable")
            later = chapters["later"].to_numpy()[order]
            lists = chapters["h"].combine_chunks().take(pa.array(order))
            place = np.repeat(np.arange(len(order)), np.diff(lists.offsets.to_numpy()))
            tokens = lists.flatten().to_numpy(zero_copy_only=False)
            by = np.argsort(tokens, kind="stable")
            tokens, place = tokens[by], place[by]
            asked = hooks["h"].combine_chunks()
            stops, wanted = asked.offsets.to_numpy() - asked.offsets[0].as_py(), asked.flatten().to_numpy(zero_copy_only=False)
            lo, hi = np.searchsorted(tokens, wanted, "left"), np.searchsorted(tokens, wanted, "right")
            present = np.concatenate([[0], np.cumsum(hi > lo)])
            sizes, which = np.unique(np.diff(stops), return_inverse=True)
            needs = np.array([_needed(n, threshold) for n in sizes.tolist()], np.int64)[which]
            # Where fewer tokens than needed stand in the whole block, none of its chapters can do.
            able = np.flatnonzero(np.diff(present[stops]) >= needs)
            for opened, need, first, stop in zip(hooks["opened"].to_numpy()[able].tolist(), needs[able].tolist(), stops[:-1][able].tolist(), stops[1:][able].tolist()):
                n = stop - first
                shared = np.zeros(len(later), np.int32)
                for a, b in zip(lo[first:stop].tolist(), hi[first:stop].tolist()):
                    shared[place[a:b]] += 1
                from_ = int(np.searchsorted(later, opened, "right"))
                met = int(np.argmax(shared[from_:] >= need)) if from_ < len(later) else 0
                if from_ + met < len(later) and shared[from_ + met] >= need:
                    found.append((opened, int(later[from_ + met]), int(shared[from_ + met]) / n))
        opened, first, ratio = zip(*found) if found else ((), (), ())
        book = pa.array([key[0].as_py()] * len(found), hooks.schema.field("book").type)
        return pa.table([book, pa.array(opened, hooks.schema.field("opened").type), pa.array(first, chapters.schema.field("later").type), pa.array(ratio, pa.float64())], names=["book", "opened", "later", "ratio"])

    return run


def resolutions(hooks: DataFrame, candidates: DataFrame, threshold: float = V.RESOLVE_THRESHOLD) -> DataFrame:
    """book, opened, resolved, ratio: the earliest later chapter that shares enough of a hook's distinct tokens.

    hooks (book, ord, hook), candidates (book, ord, text, or h where a stored table has the ids of
    the texts' tokens already, each once and in order). Chapters go into blocks of
    BLOCK_CHAPTERS numbers, each counted as a small inverted index; a hook meets its own block and
    the next one first, and only if neither resolves it the blocks after them. A block is sent once
    for each cell of hooks that meet it: hooks of CELL_HOOKS numbers at first, then CELL_HOOKS of
    those that are left. A block sends one row a hook at most, so no pairs are made as rows. Hooks
    without a token or a match stay open (null). Tokens are compared by their ids.
    """
    spark = hooks.sparkSession
    block = lambda c: F.floor(F.col(c) / BLOCK_CHAPTERS).cast("int")
    # Written once each: neither the chapters nor the hooks' texts are read again by a later round.
    h = shared.saved(hooks.filter(T.stripped("hook") != "").select("book", F.col("ord").alias("opened"), H.token_ids("hook", distinct=True).alias("h")), shared.fresh(spark, "hooks"))
    stored = "h" in candidates.columns
    c = candidates.select("book", F.col("ord").alias("later"), F.col("h") if stored else H.token_ids("text", distinct=True).alias("h"), block("ord").alias("block"))
    c = c if stored else shared.saved(c, shared.fresh(spark, "hooked"))
    ends = c.groupBy("book").agg(F.max("block").alias("end"), F.min("block").alias("least"))
    asked = h.filter(F.size("h") > 0).join(ends, "book").withColumn("start", F.greatest(block("opened"), "least"))
    schema = "book {}, opened {}, later {}, ratio double".format(*[d.schema[k].dataType.simpleString() for d, k in ((h, "book"), (h, "opened"), (c, "later"))])
    keys = ["book", "block", "cell"]

    def met(asked: DataFrame) -> DataFrame:
        each = asked.filter("start <= end").withColumn("block", F.explode(F.sequence("start", "end"))).select(*keys, "opened", "h")
        # A few rows for a block of a thousand chapters.
        near = c.join(F.broadcast(each.select(*keys).distinct()), ["book", "block"]).select(*keys, "later", "h")
        near = near.select(*[F.col(x).alias(f"_{x}") for x in near.columns]).toDF(*near.columns)  # names of its own: both sides come from the hooks
        return each.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInArrow(_earliest(threshold), schema)

    first = asked.withColumn("end", F.least("end", F.col("start") + 1)).withColumn("cell", F.floor(F.col("opened") / CELL_HOOKS).cast("int"))
    soon = shared.saved(met(first), shared.fresh(spark, "resolved"))
    rest = asked.join(soon.select("book", "opened").distinct(), ["book", "opened"], "left_anti").withColumn("start", F.col("start") + 2).filter("start <= end")
    rest = shared.saved(rest, shared.fresh(spark, "unresolved"))
    cells = rest.groupBy("book").agg(F.ceil(F.count("*") / CELL_HOOKS).cast("int").alias("cells"))
    late = rest.join(cells, "book").withColumn("cell", F.pmod(F.xxhash64("opened"), "cells").cast("int"))
    best = soon.unionByName(met(late)).groupBy("book", "opened").agg(F.min(F.struct("later", "ratio")).alias("m"))
    return h.select("book", "opened").join(best, ["book", "opened"], "left").select("book", "opened", F.col("m.later").alias("resolved"), F.col("m.ratio").alias("ratio"))


def spans(ledger: DataFrame) -> DataFrame:
    """book, median and longest span of resolved hooks, and how many are open."""
    span = F.col("resolved") - F.col("opened")
    return ledger.groupBy("book").agg(F.median(span).alias("median_span"), F.max(span).alias("longest_span"), F.count_if(F.col("resolved").isNull()).alias("open_hooks"))


def open_at(ledger: DataFrame, at: DataFrame, size: int = OPEN_BLOCK) -> DataFrame:
    """book, ord, opened: hooks that are open when each chapter of `at` (book, ord) begins.

    Chapters go into blocks of `size` numbers and a hook to the blocks in which it is open, so a
    hook meets only chapters at the two ends of its interval in vain, and a long book is many keys.
    """
    sent = _in_blocks(ledger, at, size).select("book", "block", "from", "to", "opened")
    met = at.withColumn("block", _block("ord", size)).join(sent, ["book", "block"])
    return met.filter(F.col("ord").between(F.col("from"), F.col("to"))).select("book", "ord", "opened")


def _block(c: str, size: int) -> Column:
    return F.floor(F.col(c) / size).cast("int")


def _in_blocks(ledger: DataFrame, at: DataFrame, size: int) -> DataFrame:
    """The ledger's hooks with from and to, the chapters in which they are open, a row for each block of `size` numbers between."""
    ends = at.groupBy("book").agg(F.max("ord").alias("end"), F.min("ord").alias("least"))
    spans = ledger.join(ends, "book").withColumn("from", F.greatest(F.col("opened") + 1, "least")).withColumn("to", F.least(F.coalesce("resolved", "end"), "end"))
    return spans.filter("from <= to").withColumn("block", F.explode(F.sequence(_block("from", size), _block("to", size))))


def open_lists(ledger: DataFrame, at: DataFrame, what: str = "opened", size: int = OPEN_BLOCK) -> DataFrame:
    """book, ord, hooks: as `open_at`, but a chapter's hooks (or `what` the ledger has of each) as one list in order of opening; chapters without are left out.

    A block's hooks are gathered once for its chapters, and each chapter takes its own from them, so
    a chapter and a hook are never a row.
    """
    each = _in_blocks(ledger, at, size).groupBy("book", "block").agg(F.array_sort(F.collect_list(F.struct("opened", F.col(what).alias("what"), "from", "to"))).alias("spans"))
    met = at.withColumn("block", _block("ord", size)).join(each, ["book", "block"])
    open_ = F.transform(F.filter("spans", lambda x: F.col("ord").between(x["from"], x["to"])), lambda x: x["what"])
    return met.select("book", "ord", open_.alias("hooks")).filter(F.size("hooks") > 0)


def previous_summaries(chapters: DataFrame, outlines: DataFrame, summaries: DataFrame) -> DataFrame:
    """book, ord, previous, source: the chapter before as written, else as outlined, else none."""
    s = summaries.select("book", (F.col("ord") + 1).alias("ord"), F.col("gist").alias("written"))
    o = outlines.select("book", (F.col("ord") + 1).alias("ord"), F.nullif(T_join("core_event", "ending_hook"), F.lit("")).alias("outlined"))
    both = chapters.select("book", "ord").join(s, ["book", "ord"], "left").join(o, ["book", "ord"], "left")
    source = F.when(F.col("written").isNotNull(), "written").when(F.col("outlined").isNotNull(), "outline").otherwise("none")
    return both.select("book", "ord", F.coalesce("written", "outlined", F.lit("")).alias("previous"), source.alias("source"))


def T_join(*parts: str, by: str = "\n"):
    """Non-blank parts, joined."""
    return F.array_join(F.filter(F.array(*[F.coalesce(F.col(p), F.lit("")) for p in parts]), lambda x: F.btrim(x) != ""), by)


def known_orders(outlines: DataFrame, summaries: DataFrame) -> DataFrame:
    """book, ord that either side knows (a full outer union of keys)."""
    return outlines.select("book", "ord").union(summaries.select("book", "ord")).distinct()


def missing_summaries(manuscripts: DataFrame, summaries: DataFrame) -> DataFrame:
    """book, ord of chapters with text but no summary."""
    return manuscripts.filter(T.stripped("text") != "").select("book", "ord").join(summaries.select("book", "ord"), ["book", "ord"], "left_anti")


def mechanical_summary(chapters: DataFrame, otherwise: Column | None = None, breaks: str = T.LINE_BREAKS, blanks: str = T.BLANKS) -> DataFrame:
    """book, ord, gist: the core event and the last line, or `otherwise` (the number and title, if it is not given)."""
    last = F.left(F.coalesce(F.element_at(F.concat(F.array(F.lit("")), T.lines("text", breaks, blanks)), -1), F.lit("")), F.lit(80))
    parts = F.filter(F.array(T.bared(F.coalesce("core_event", F.lit("")), blanks), last), lambda x: x != "")
    none = F.format_string("第 %d 章 %s", "ord", "title") if otherwise is None else otherwise
    gist = F.when(F.size(parts) > 0, F.left(F.array_join(parts, "；"), F.lit(200))).otherwise(none)
    return chapters.select("book", "ord", gist.alias("gist"))


def plot_points(chapters: DataFrame, most: int = V.PLOT_POINTS) -> DataFrame:
    """book, ord, index, start, quote, summary, tone, themes: rule summaries, evenly sampled to `most` sentences."""
    # One line feed at the very end doesn't cut a sentence off; a run before any other one is no sentence.
    raw = F.filter(F.regexp_extract_all(F.regexp_replace("body", r"\n\z", ""), F.lit(f"({V.SUMMARY_PIECE})"), 1), lambda s: ~s.endswith("\n"))
    body = chapters.withColumn("base", F.position(F.lit("\n"), F.col("text"))).withColumn("body", F.expr("substring(text, base + 1)"))
    found = body.select("book", "ord", F.filter(F.transform(raw, T.stripped), lambda s: s != "").alias("s"))
    n = F.size("s")
    picks = F.when(n > most, F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get("s", F.floor(i * (n / most)).cast("int")))).otherwise(F.col("s"))
    each = found.select("book", "ord", F.posexplode(picks).alias("i", "s"))
    return each.select("book", "ord", (F.col("i") + 1).alias("index"), F.left("s", F.lit(V.QUOTE_CHARS)).alias("quote"), F.left("s", F.lit(V.GIST_CHARS)).alias("summary"), T.tone("s").alias("tone"), T.themes("s").alias("themes"))
