"""Rules that a chapter must pass, alone and against the chapters before it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as T


def word_band(target: Column | int) -> tuple[Column, Column]:
    t = F.lit(target) if isinstance(target, int) else target
    return (t * V.BAND_LOW).cast("int"), (t * V.BAND_HIGH).cast("int")


def in_band(text: Column, target: Column | int) -> Column:
    low, high = word_band(target)
    return T.count(text, V.CJK).between(low, high)


def truncated(text: Column) -> Column:
    """Whether the last character that is no blank is not a closing mark (an empty text is truncated)."""
    tail = F.right(T.tail(text), F.lit(1))
    return ~F.lit(V.CLOSING).contains(tail) | (tail == "")


def _most_frequent(text: str, n: int) -> tuple[int, int]:
    """(times, start) of a text's most frequent n-gram, the earliest of several. Equal hashes are compared letter by letter."""
    c = _codes(text)
    h = _hashes(c, n)
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    letters = np.arange(n)
    if not np.array_equal(c[order[same][:, None] + letters], c[order[same + 1][:, None] + letters]):
        h = np.unique(np.lib.stride_tricks.sliding_window_view(c, n), axis=0, return_inverse=True)[1].reshape(-1)
        order = np.argsort(h, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]]]))
    times = np.diff(np.append(starts, len(h)))
    return int(times.max()), int(order[starts[times == times.max()]].min())


def repeated(compact: Column, n: int = V.REPEAT_CHARS) -> Column:
    """struct(times, span): the most frequent n-gram of a text without blanks (the earliest of several); null for texts of less than 3 n characters.

    Counted inside the text's own row, so no gram is shuffled.
    """

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts.to_pylist():
            if x is None or len(x) < n * V.REPEAT_COUNT:
                out.append(None)
            else:
                times, at = _most_frequent(x, n)
                out.append({"times": times, "span": x[at : at + n]})
        return pa.array(out, pa.struct([("times", pa.int64()), ("span", pa.string())]))

    return F.arrow_udf(run, "struct<times: long, span: string>")(compact)


def repeats(docs: DataFrame, key: str = "doc_id", n: int = V.REPEAT_CHARS) -> DataFrame:
    """key, times, span: the most frequent n-gram of each text without blanks (the earliest of several), for texts of 3 n characters."""
    found = docs.select(key, repeated(T.unspaced("text"), n).alias("r"))
    return found.select(key, "r.times", "r.span").filter("times is not null")


def adjacent_duplicate(text: Column) -> Column:
    """Whether a line of eight characters or more equals the line before (only in texts long enough to be checked for repeats)."""
    start = F.struct(F.lit("").alias("before"), F.lit(False).alias("same"))
    same = F.aggregate(T.lines(text), start, lambda a, x: F.struct(x.alias("before"), (a["same"] | ((x == a["before"]) & (F.length(x) >= V.ADJACENT_CHARS))).alias("same")), lambda a: a["same"])
    return (F.length(T.unspaced(text)) >= V.REPEAT_CHARS * V.REPEAT_COUNT) & same


def self_reference(text: Column) -> Column:
    """The first phrase in which a model speaks of itself, outside lines with double quotes."""
    free = F.filter(T.lines(text), lambda x: ~T.holds(x, '“|"'))
    hits = F.transform(free, lambda x: F.coalesce(*[F.nullif(F.regexp_extract(x, f"({p})", 1), F.lit("")) for p in V.SELF_REFERENCE]))
    return F.get(F.filter(hits, lambda x: x.isNotNull()), 0)


def placeholder(text: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, f"({p})", 1), F.lit("")) for p in V.PLACEHOLDERS])


def mojibake(text: Column) -> Column:
    return text.contains("�")


def engineering_words(text: Column) -> Column:
    return F.filter(F.array(*map(F.lit, V.ENGINEERING_WORDS)), lambda w: F.contains(text, w))


def evidence(text: Column, most: int = 40) -> Column:
    return F.left(T.stripped(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(most))


def shown(text: Column, rule: Column) -> Column:
    """The pieces of a chapter that show a failure of the rule: at most three, clipped, none that is blank.

    For rules about a phrase the phrase itself, for engineering words what stands around the first
    occurrence of each, for a truncated text its end, for a repeated line that line.
    """
    tail = F.right(T.tail(text), F.lit(60))
    at = lambda w: F.position(w, text)
    around = lambda w: F.substring(text, F.greatest(at(w) - 15, F.lit(1)), at(w) + 25 - F.greatest(at(w) - 15, F.lit(1)))
    rows = T.lines(text)
    follows = F.filter(F.transform(rows, lambda x, i: F.when((F.length(x) >= V.ADJACENT_CHARS) & (x == F.get(rows, i - 1)), x)), lambda x: x.isNotNull())
    pieces = (
        F.when(rule == "truncated", F.array(tail))
        .when(rule == "tier1_engineering_words", F.transform(F.slice(engineering_words(text), 1, 3), around))
        .when(rule == "self_reference", F.array(self_reference(text)))
        .when(rule == "placeholder", F.array(placeholder(text)))
        .when(rule == "adjacent_duplicate", F.slice(follows, 1, 1))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.filter(F.transform(pieces, lambda x: evidence(x)), lambda x: F.coalesce(x != "", F.lit(False)))


def windowed(chapters: DataFrame, size: int = V.RECENT) -> DataFrame:
    """book, ord, prev: pairs of each chapter with the earlier ones at most `size` numbers before.

    A range join by number, as an equi-join on blocks of `size` numbers (a chapter's window lies in
    its own block and the one before), so books of any length spread over tasks.
    """
    ids = chapters.select("book", "ord").distinct().withColumn("block", F.floor(F.col("ord") / size))
    earlier = ids.select("book", F.col("ord").alias("prev"), F.explode(F.array("block", F.col("block") + 1)).alias("block"))
    return ids.join(earlier, ["book", "block"]).filter(F.col("prev").between(F.col("ord") - size, F.col("ord") - 1)).select("book", "ord", "prev")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n-gram, in order."""
    c = codes.astype(np.uint64)
    h = np.zeros(max(len(c) - n + 1, 0), np.uint64)
    for i in range(n):
        h = (h ^ c[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _nearest(size: int, n: int, keep: list[str]):
    """For one block of chapters and the last `size` numbers before it: each own chapter against its last `size` numbers."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["ord"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        ords, own = table["ord"].to_pylist(), table["own"].to_pylist()
        grams = [np.unique(_hashes(_codes(t or ""), n)) for t in table["t"].to_pylist()]
        names, ids = np.unique(np.concatenate(grams), return_inverse=True)
        ids = np.split(ids.reshape(-1), np.cumsum([len(g) for g in grams])[:-1])
        # How many chapters of the window hold a gram, and which grams the chapter at hand holds.
        held, mine = np.zeros(len(names), np.int32), np.zeros(len(names), bool)
        first = upto = 0
        out, rows = [], []
        for i, ord_ in enumerate(ords):
            while upto < i and ords[upto] < ord_:
                held[ids[upto]] += 1
                upto += 1
            while first < upto and ords[first] < ord_ - size:
                held[ids[first]] -= 1
                first += 1
            if not own[i]:
                continue
            best, worst, k = 0.0, None, len(ids[i])
            mine[ids[i]] = True
            for j in range(first, upto) if k else ():
                hit = int(np.count_nonzero(mine[ids[j]]))
                both = hit / (k + len(ids[j]) - hit)
                if both > best:
                    best, worst = both, ords[j]
            mine[ids[i]] = False
            rows.append(i)
            out.append((k, best, worst, int(np.count_nonzero(held[ids[i]])) / k if k else 0.0))
        kinds = [pa.int64(), pa.float64(), table.schema.field("ord").type, pa.float64()]
        found = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, kinds)]
        kept = table.select(["book", "ord", *keep]).take(pa.array(rows, pa.int64()))
        return pa.table([*kept.columns, *found], names=[*kept.column_names, "grams", "overlap", "worst", "containment"])

    return run


#: Chapters of a block, as a multiple of the chapters before that each is compared with.
BLOCK = 4


def cross_chapter(chapters: DataFrame, size: int = V.RECENT, keep: tuple[str, ...] = (), compact: Column | None = None) -> DataFrame:
    """book, ord, keep, overlap, worst, containment, freshness against the last `size` chapters.

    overlap: the greatest Jaccard similarity of 5-gram sets with one of them (worst: the earliest
    such); containment: the share of grams in their union; freshness: one less that share. A text
    travels to its own block of 4 `size` numbers and, if it is one of the last `size`, to the next
    one, where one kernel makes gram sets and compares them; a group is a block and the `size`
    numbers before it, however long the book. Columns in `keep` travel with the own text only.
    """
    block = lambda c: F.floor(c / (BLOCK * size))
    mine = F.col("block") == block(F.col("ord"))
    both = F.array_distinct(F.array(block(F.col("ord")), block(F.col("ord") + size)))
    sent = chapters.select("book", "ord", (T.unspaced("text") if compact is None else compact).alias("t"), *keep).withColumn("block", F.explode(both))
    sent = sent.select("book", "ord", "t", "block", mine.alias("own"), *[F.when(mine, F.col(c)).alias(c) for c in keep])
    types = {f.name: f.dataType.simpleString() for f in sent.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in ("book", "ord", *keep)) + f", grams long, overlap double, worst {types['ord']}, containment double"
    found = sent.groupBy("book", "block").applyInArrow(_nearest(size, V.GRAM, list(keep)), schema)
    return found.select("book", "ord", *keep, "overlap", "worst", "containment", F.when(F.col("grams") == 0, 0.0).otherwise(F.bround(1 - F.col("containment"), 4)).alias("freshness"))


def verdict(rules: Column, empty: Column) -> Column:
    """pass without failures; reject for lost characters or an empty text; else repair."""
    return F.when(F.size(rules) == 0, "pass").when(F.array_contains(rules, "mojibake") | empty, "reject").otherwise("repair")


def check(chapters: DataFrame, drift: DataFrame | None = None, target: int = V.TARGET_CHARS, length_gate: bool = False, summaries: DataFrame | None = None) -> DataFrame:
    """book, ord, rules (hard failures in order), advisories, verdict and soft scores of every chapter.

    drift: (book, ord, rule) of drifting rules; summaries: (book, ord) of chapters that have one (all, if not given).
    """
    text, gone, missing = F.col("text"), F.lit(None).cast("array<string>"), F.lit(False)
    # What a text alone tells is told before it travels, and nothing is joined to it.
    alone = {
        "short": ~in_band(text, target),
        "truncated": truncated(text),
        "adjacent": adjacent_duplicate(text),
        "self_reference": self_reference(text).isNotNull(),
        "placeholder": placeholder(text).isNotNull(),
        "mojibake": mojibake(text),
        "engineering": F.size(engineering_words(text)) > 0,
        "empty": T.stripped(text) == "",
        "cjk_chars": T.count(text, V.CJK),
    }
    told = chapters.select("book", "ord", T.unspaced("text").alias("text"), *[v.alias(k) for k, v in alone.items()])
    told = told.withColumn("times", repeated(F.col("text"))["times"])
    rows = cross_chapter(told, keep=(*alone, "times"), compact=F.col("text"))
    if drift is not None:
        rows = rows.join(drift.groupBy("book", "ord").agg(F.array_sort(F.collect_set(F.concat(F.lit("drift_"), "rule"))).alias("drifts")), ["book", "ord"], "left")
        gone = F.col("drifts")
    if summaries is not None:
        rows = rows.join(summaries.select("book", "ord", F.lit(True).alias("has_summary")).distinct(), ["book", "ord"], "left")
        missing = F.col("has_summary").isNull()
    rule = lambda test, name: F.when(test, F.lit(name))
    often = F.coalesce(F.col("times") >= V.REPEAT_COUNT, F.lit(False))
    hard = [
        rule(F.col("short") & F.lit(length_gate), "chapter_length"),
        rule(F.col("truncated"), "truncated"),
        rule(often, "repeat_span"),
        rule(~often & F.col("adjacent"), "adjacent_duplicate"),
        rule(F.col("self_reference"), "self_reference"),
        rule(F.col("placeholder"), "placeholder"),
        rule(F.col("mojibake"), "mojibake"),
        rule(F.col("engineering"), "tier1_engineering_words"),
        rule(F.col("overlap") >= V.JACCARD_MAX, "cross_chapter_similarity"),
    ]
    rules = F.concat(F.array_compact(F.array(*hard)), F.coalesce(gone, F.array().cast("array<string>")), F.array_compact(F.array(rule(missing, "summary_missing"))))
    return rows.withColumn("rules", rules).select(
        "book",
        "ord",
        "rules",
        (F.col("short") & ~F.lit(length_gate)).alias("length_advisory"),
        verdict(F.col("rules"), F.col("empty")).alias("verdict"),
        "cjk_chars",
        "freshness",
        F.bround("containment", 4).alias("freshness_containment"),
        (F.col("containment") >= V.CONTAINMENT_REPORT).alias("containment_warn"),
        F.bround("overlap", 4).alias("cross_chapter_overlap"),
    )
