"""Deconstructions as files: chapters and totals as JSON Lines, read back under a schema, and two Markdown views.

A view is a table of lines (book, section, at, line); a book is never one row, so one with a third
of all chapters is written by as many tasks as its lines need. The author's view shows where in a
chapter a suspected conflict stands; the knowledge-base view reads numbers only: no column with
text of a book but its title and the techniques that the caller names can reach it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from ..functions import fixed as V
from . import projects

#: Chapters of a block in which the first of a book's flagged ones are found.
BLOCK = 65_536

ANCHORS = "array<struct<start:int,end:int,n:int,dialogue:boolean,exclaim:boolean,question:boolean,unpunct:boolean,triggers:array<string>>>"
CHAPTERS = (
    "book string, pos long, ord long, title string, char_count long, sentence_count long, avg_sentence_chars double, median_sentence_chars double, min_sentence_chars long, max_sentence_chars long, "
    "short_sentence_ratio double, long_sentence_ratio double, dialogue_sentence_ratio double, exclaim_ratio double, question_ratio double, no_punct_sentence_ratio double, paragraph_count long, "
    f"opening_hook_signal boolean, closing_hook_signal boolean, anchors {ANCHORS}, anchor_count long, anchors_overflow boolean"
)
BOOKS = (
    "book string, chapters long, total_chars long, avg_chapter_chars double, avg_sentence_chars double, avg_dialogue_ratio double, short_sentence_ratio double, long_sentence_ratio double, "
    "per_thousand_conflicts double, median_sentence_chars double"
)


def write(structure: DataFrame, measured: DataFrame, path: str) -> None:
    """One line a book under path/books, one line a chapter (anchors nested) under path/chapters."""
    for rows, ddl, name in ((structure, BOOKS, "books"), (measured, CHAPTERS, "chapters")):
        schema = StructType.fromDDL(ddl)
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.option("ignoreNullFields", False).json(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(books, chapters, refused) of what `write` wrote.

    refused (part, line): lines that are no JSON object, hold a value of another type, or lack their
    book (a chapter: its place). They are in neither table, and nothing raises.
    """

    def of(ddl: str, name: str, needed: list[str]) -> tuple[DataFrame, DataFrame]:
        lines = spark.read.text(f"{path}/{name}").select("value", F.from_json("value", f"{ddl}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
        sound = F.col("r").isNotNull() & F.col("r._bad").isNull()
        for c in needed:
            sound = sound & F.col(f"r.{c}").isNotNull()
        return lines.filter(sound).select("r.*").drop("_bad"), lines.filter(~sound).select(F.lit(name).alias("part"), F.col("value").alias("line"))

    (books, bad_books), (chapters, bad_chapters) = of(BOOKS, "books", ["book"]), of(CHAPTERS, "chapters", ["book", "pos"])
    return books, chapters, bad_books.unionByName(bad_chapters)


def number(value: Column, digits: int = 0) -> Column:
    """A number that is not negative with so many digits after the point, ties to the even digit."""
    scale = 10**digits
    n = F.bround(value * scale).cast("long")
    return n.cast("string") if digits == 0 else F.format_string(f"%d.%0{digits}d", F.floor(n / scale).cast("long"), n % scale)


def first_orders(rows: DataFrame) -> DataFrame:
    """book, n, first: how many distinct orders a book has and the first few by place; rows (book, ord, at).

    Blocks of places give their own first ones, so no book's list is gathered.
    """
    one = rows.groupBy("book", "ord").agg(F.min("at").alias("at")).withColumn("block", F.floor(F.col("at") / BLOCK))
    n = one.groupBy("book").agg(F.count("*").alias("n"))
    heads = one.withColumn("k", F.row_number().over(W.partitionBy("book", "block").orderBy("at"))).filter(F.col("k") <= V.ORDERS_SHOWN)
    heads = heads.withColumn("k", F.row_number().over(W.partitionBy("book").orderBy("at"))).filter(F.col("k") <= V.ORDERS_SHOWN)
    first = heads.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "ord"))), lambda x: x["ord"]).alias("first"))
    return n.join(first, "book")


def _orders(n: Column, first: Column) -> Column:
    shown = F.array_join(F.transform(first, lambda x: x.cast("string")), "、")
    return F.when(n <= V.ORDERS_SHOWN, shown).otherwise(F.format_string(f"共 %d 章（前 {V.ORDERS_SHOWN} 章：%s…）", n, shown))


def _row(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"| {label} | "), value, F.lit(" |"))


def table(structure: DataFrame, orders: dict[str, DataFrame] | None = None, spans: DataFrame | None = None) -> DataFrame:
    """book, at, line: the rows of the table of measures.

    orders: rows (book, ord, at) of the chapters that each label of V.ORDER_ROWS counts; a book
    without any has no such row. spans (book, median_span, longest_span, open_hooks) likewise.
    """
    cells = [F.lit(V.TABLE_HEAD)] + [_row(label, F.concat(F.lit(before), number(F.col(c) * factor, digits), F.lit(after))) for c, label, digits, factor, before, after in V.TABLE_ROWS]
    out = structure.select("book", F.posexplode(F.array(*cells)).alias("at", "line"))
    for i, (kind, label) in enumerate(V.ORDER_ROWS.items(), len(cells)):
        if orders and kind in orders:
            out = out.unionByName(first_orders(orders[kind]).select("book", F.lit(i).alias("at"), _row(label, _orders(F.col("n"), F.col("first"))).alias("line")))
    if spans is not None:
        first = len(cells) + len(V.ORDER_ROWS)
        show = {"median_span": number(F.col("median_span"), 1), "longest_span": number(F.col("longest_span")), "open_hooks": F.col("open_hooks").cast("string")}
        rows = F.array(*[_row(label, F.concat(F.coalesce(show[c], F.lit(V.NO_SPAN)), F.lit(unit))) for c, label, unit in V.LEDGER_ROWS])
        out = out.unionByName(spans.select("book", F.posexplode(rows).alias("p", "line")).select("book", (F.col("p") + first).alias("at"), "line"))
    return out


def _lines(section: int, rows: DataFrame, at: Column | str, line: Column | str) -> DataFrame:
    line = F.col(line) if isinstance(line, str) else line
    at = F.col(at) if isinstance(at, str) else at
    return rows.select("book", F.lit(section).cast("long").alias("section"), at.cast("long").alias("at"), line.alias("line"))


def _numeric(rows: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, all of them numbers."""
    if wrong := [c for c in columns if not isinstance(rows.schema[c].dataType, NumericType)]:
        raise TypeError(f"the knowledge-base view takes numbers only, not {', '.join(wrong)}")
    return rows.select("book", *columns)


def kb_view(structure: DataFrame, densities: DataFrame, ledger: DataFrame, orders: dict[str, DataFrame] | None = None, spans: DataFrame | None = None, techniques: DataFrame | None = None) -> DataFrame:
    """book, section, at, line of the view for a knowledge base: numbers, and the named techniques (book, at, technique).

    densities (book, ord, density), ledger (book, opened, resolved). Columns that are no numbers
    raise before anything is read; other columns are not read.
    """
    structure = _numeric(structure, *[c for c, *_ in V.TABLE_ROWS])
    densities, ledger = _numeric(densities, "ord", "density"), _numeric(ledger, "opened", "resolved")
    orders = {k: _numeric(v, "ord", "at") for k, v in (orders or {}).items()}
    spans = None if spans is None else _numeric(spans, *[c for c, *_ in V.LEDGER_ROWS])
    books = structure.select("book")
    dense = densities.filter("density is not null")
    parts = [
        _lines(0, books, F.lit(0), F.concat(F.lit(V.KB_TITLE), F.col("book").cast("string"))),
        _lines(1, books, F.lit(0), F.lit(V.KB_MEASURED_TITLE)),
        _lines(2, table(structure, orders, spans), "at", "line"),
        _lines(3, dense.select("book").distinct(), F.lit(-1), F.lit(V.DENSITY_HEAD)),
        _lines(3, dense, "ord", F.concat(F.lit("| "), F.col("ord").cast("string"), F.lit(" | "), number(F.col("density"), 2), F.lit(" |"))),
        _lines(4, ledger.select("book").distinct(), F.lit(-1), F.lit(V.LEDGER_HEAD)),
        _lines(
            4,
            ledger,
            "opened",
            F.format_string("| %d | %s | %s |", F.col("opened").cast("long"), F.coalesce(F.col("resolved").cast("long").cast("string"), F.lit(V.UNRESOLVED)), F.coalesce((F.col("resolved") - F.col("opened")).cast("long").cast("string"), F.lit(V.NO_SPAN))),
        ),
        _lines(5, books, F.lit(-1), F.lit(V.TECHNIQUES_HEAD)),
    ]
    if techniques is None:
        parts.append(_lines(5, books, F.lit(0), F.lit(V.NO_TECHNIQUES)))
    else:
        parts.append(_lines(5, techniques, "at", F.concat(F.lit("- "), F.col("technique"))))
        parts.append(_lines(5, books.join(techniques.select("book").distinct(), "book", "left_anti"), F.lit(0), F.lit(V.NO_TECHNIQUES)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def author_view(structure: DataFrame, measured: DataFrame, orders: dict[str, DataFrame] | None = None, spans: DataFrame | None = None) -> DataFrame:
    """book, section, at, line of the author's view: the table, then per chapter its measures and the places of its anchors."""
    percent = lambda c: F.concat(number(F.col(c) * 100, 2), F.lit("%"))
    signal = lambda c: F.when(F.col(c), "有").otherwise("无")
    said = [
        F.format_string("- 字数 %d ｜ 句数 %d ｜ 平均句长 %s ｜ 段落 %d", "char_count", "sentence_count", number(F.col("avg_sentence_chars"), 2), "paragraph_count"),
        F.format_string(
            "- 句长分布：中位 %s ｜ 最短 %d ｜ 最长 %d ｜ 短句占比 %s ｜ 长句占比 %s",
            number(F.col("median_sentence_chars"), 1), "min_sentence_chars", "max_sentence_chars", percent("short_sentence_ratio"), percent("long_sentence_ratio"),
        ),
        F.format_string("- 对话句占比 %s ｜ 感叹号句占比 %s ｜ 问号句占比 %s ｜ 无句末标点句占比 %s", *[percent(c) for c in ("dialogue_sentence_ratio", "exclaim_ratio", "question_ratio", "no_punct_sentence_ratio")]),
        F.format_string("- 开篇悬念信号：%s ｜ 章尾悬念信号：%s", signal("opening_hook_signal"), signal("closing_hook_signal")),
    ]
    places = F.transform("anchors", lambda a: F.format_string("- 偏移 %d-%d ｜ 触发规则：%s", a["start"], a["end"], F.array_join(a["triggers"], "+")))
    head = F.format_string("## 第%d章 %s", "ord", F.coalesce("title", F.lit("")))
    # The heading is one value, so that a chapter without an order still keeps its lines.
    found = F.when(F.size("anchors") > 0, F.concat(F.array(F.format_string("**疑似冲突点 %d 处**（坐标为章内偏移）：", F.size("anchors"))), places)).otherwise(F.array().cast("array<string>"))
    chapter = F.array_join(F.concat(F.array(head, *said), found), "\n")
    books = structure.select("book")
    parts = [
        _lines(0, books, F.lit(0), F.concat(F.lit(V.AUTHOR_TITLE), F.col("book").cast("string"))),
        _lines(1, books, F.lit(0), F.lit(V.MEASURED_TITLE)),
        _lines(2, table(structure, orders, spans), "at", "line"),
        _lines(3, measured, "pos", chapter),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def write_view(view: DataFrame, path: str) -> None:
    """path/book=.../part-*.txt: a book's files in order of name are its document. Lines are dealt out by range, so a large book is many tasks."""
    order = ["book", "section", "at"]
    view.repartitionByRange(*order).sortWithinPartitions(*order).select("book", "line").write.partitionBy("book").text(path)


def part_documents(parts: dict[str, DataFrame]) -> DataFrame:
    """project, doc_id, doc_type, ord, title, text of all usable parts of a project: {kind of V.PARTS: (project, state, fields...)}.

    Chapters have an `ord`, which their doc_id carries. Fields that are lists are joined by blanks; blank ones are left out.
    """

    def of(kind: str, rows: DataFrame) -> DataFrame:
        prefix, doc_type, fields = V.PARTS[kind]
        lists = {f.name for f in rows.schema if f.dataType.typeName() == "array"}
        text = projects.joined(*[F.array_join(c, " ") if c in lists else F.col(c) for c in fields])
        ord_ = F.col("ord").cast("long") if "ord" in rows.columns else F.lit(None).cast("long")
        title = F.lit(V.POSITIONING_TITLE) if kind == "positioning" else F.col(fields[0])
        doc_id = F.concat(F.lit(prefix), ord_.cast("string")) if "ord" in rows.columns else F.lit(prefix)
        return rows.filter(projects.runs.usable(F.col("state"))).select("project", doc_id.alias("doc_id"), F.lit(doc_type).alias("doc_type"), ord_.alias("ord"), title.alias("title"), text.alias("text"))

    found = [of(k, v) for k, v in parts.items()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def summary_documents(summaries: DataFrame) -> DataFrame:
    """project, doc_id, doc_type, ord, title, text, characters, themes, tones of chapters' summaries.

    summaries: project, ord, title, gist, characters, plot_points (array of summary, characters,
    theme_tags, tone; a quote beside them is never read). Labels are distinct and sorted.
    """
    points = F.coalesce("plot_points", F.array())
    told = F.transform(points, lambda p: projects.joined(p["summary"], F.array_join(p["characters"], " "), F.array_join(p["theme_tags"], " "), p["tone"]))
    people = F.coalesce("characters", F.array())
    text = F.array_join(F.filter(F.concat(F.array("title", "gist"), told, F.array(F.array_join(people, " "))), lambda x: F.btrim(x) != ""), "\n")
    sorted_ = lambda c: F.array_sort(F.array_distinct(c))
    return summaries.select(
        "project",
        F.concat(F.lit(V.SUMMARY_DOC), F.col("ord").cast("string")).alias("doc_id"),
        F.lit(V.SUMMARY_TYPE).alias("doc_type"),
        F.col("ord").cast("long").alias("ord"),
        "title",
        text.alias("text"),
        sorted_(people).alias("characters"),
        sorted_(F.flatten(F.transform(points, lambda p: p["theme_tags"]))).alias("themes"),
        sorted_(F.transform(points, lambda p: p["tone"])).alias("tones"),
    )
