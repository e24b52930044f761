"""Quotes, evidence, order lists, versions, summaries, semantic results and saved indexes, against values written out."""

import json

import pytest
from pyspark.sql import functions as F

from wordloom.operators import gates, projects, quotes, retrieval, style
from wordloom.sources import files
from wordloom.streaming import runs as streams

TEXT = "他说：好的…走吧。ＡＢＣ门开了，风进来。好的。"


@pytest.mark.parametrize(
    ("quote", "want"),
    [
        ("门开了", (12, 15, 1)),
        (" 门开了 ", (12, 15, 1)),
        ("abc", None),
        ("ABC门", (9, 13, 2)),
        ("好的...走", (3, 7, 2)),
        ("门开了 ，风", (12, 17, 2)),
        ("门开了风进来", (12, 19, 3)),
        ("了风进", None),
        ("好的", None),
        ("没有这句", None),
        ("", None),
        (None, None),
    ],
)
def test_placed(spark, quote, want):
    got = spark.createDataFrame([(TEXT, [quote])], "text string, q array<string>").select(quotes.placed("text", "q").alias("p")).first().p
    assert [tuple(got[0]) if got[0] else None] == [want]
    if want and want[2] == 1:
        assert TEXT[want[0] : want[1]] == quote.strip()


def test_offsets_after_a_mark_that_folds_longer(spark):
    """An ellipsis folds to three marks; offsets behind it are still those of the text."""
    text = "……" * 40 + "雨 停了以后"
    got = spark.createDataFrame([(text, ["雨停了"])], "text string, q array<string>").select(quotes.placed("text", "q").alias("p")).first().p[0]
    assert text[got.start : got.stop] == "雨 停了" and got.level == 2


def test_placed_takes_nulls_empty_tables_and_long_texts(spark):
    rows = [(1, None, ["甲"]), (2, "", ["甲"]), (3, "甲乙", None), (4, "字" * 300_000 + "终 点", ["终点", "字字"])]
    d = spark.createDataFrame(rows, "id int, text string, q array<string>")
    got = {r.id: [p and tuple(p) for p in r.p] for r in d.select("id", quotes.placed("text", "q").alias("p")).collect()}
    assert got == {1: [None], 2: [None], 3: [], 4: [(300_000, 300_003, 2), None]}
    assert d.limit(0).select(quotes.placed("text", "q").alias("p")).count() == 0


def test_audit(spark):
    long = "长" * 31
    rows = [(1, f"他说“门开了”，“{long}”。  又\"没有\"。", TEXT), (2, None, TEXT), (3, "“没有”", None), (4, "“门开了”“门开了”", TEXT)]
    got = {r.id: r for r in quotes.audited(spark.createDataFrame(rows, "id int, said string, text string"), "said", "text").collect()}
    note = " （含 1 处可复核短引，坐标见本章锚点表）"
    assert got[1].cleaned == "他说“门开了”，。 又（待确认）。" + note and (got[1].removed, got[1].unplaced) == (1, 1)
    assert [tuple(a) for a in got[1].anchors] == [(12, 15, 3)]
    assert (got[2].cleaned, got[2].anchors, got[2].removed, got[2].unplaced) == ("", [], 0, 0)
    assert got[3].cleaned == "（待确认）" and got[4].cleaned == "“门开了”“门开了”" + note


def test_gate_evidence(spark):
    def shown(text, rule):
        return spark.createDataFrame([(text,)], "text string").select(gates.shown(F.col("text"), F.lit(rule)).alias("x")).first().x

    assert shown("开头。" + "字" * 70 + "  \n", "truncated") == ["字" * 40] and shown(" ", "truncated") == []
    line = "这一行有八个字以上。"
    assert shown(f"头\n{line}\n{line}\n{line}", "adjacent_duplicate") == [line]
    assert shown("没有问题。", "mojibake") == [] and shown("没有问题。", "tier1_engineering_words") == []


@pytest.mark.parametrize(("orders", "want"), [([], "无"), (None, "无"), ([1, 3], "1、3"), (list(range(1, 13)), "1、2、3、4、5、6、7、8、9、10、11、12"), (list(range(1, 15)), "共 14 章（前 12 章：1、2、3、4、5、6、7、8、9、10、11、12…）")])
def test_orders_shown(spark, orders, want):
    assert spark.createDataFrame([(orders,)], "o array<int>").select(projects.orders_shown("o").alias("x")).first().x == want


def test_versions_and_restoring(spark):
    a, b, now = "20240101-000000-000001", "20240102-000000-000001", "20240103-000000-000001"
    history = spark.createDataFrame([("p", 1, b, "二"), ("p", 1, a, "一"), ("p", 1, "../x", "坏"), ("p", 2, a, "旧")], "project string, ord int, stamp string, text string")
    assert {(r.project, r.ord): r.stamps for r in projects.versions(history).collect()} == {("p", 1): [a, b], ("p", 2): [a]}
    texts = spark.createDataFrame([("p", 1, "今"), ("p", 3, "三")], "project string, ord int, text string")
    wanted = spark.createDataFrame([("p", 1, a), ("p", 2, a), ("p", 3, a), ("p", 3, "../x")], "project string, ord int, stamp string")
    after, kept = projects.restored(texts, history, wanted, now)
    assert {(r.ord, r.text) for r in after.collect()} == {(1, "一"), (2, "旧"), (3, "三")}
    assert {(r.ord, r.text) for r in kept.filter(F.col("stamp") == now).collect()} == {(1, "今")} and kept.count() == 5


def test_summaries(spark):
    rows = [("p", "ch002.json", '{"gist": "乙"}'), ("p", "ch1.json", '{"gist": "甲"}'), ("p", "ch003.json", "{"), ("p", "ch004.json", None)]
    got = projects.summaries(spark.createDataFrame(rows, "project string, name string, text string"), "gist string").collect()
    assert [tuple(r) for r in got] == [("p", 2, "乙")]


def test_semantic_results(spark):
    chapters = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "book string, ord int")
    results = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z")], "book string, ord int, event string")
    rows, ended = projects.enriched(chapters, results, first=2)
    assert {(r.book, r.ord, r.event) for r in rows.collect()} == {("a", 1, "x"), ("a", 2, None), ("a", 3, None), ("b", 1, None)}
    assert {tuple(r) for r in ended.collect()} == {("a", 2, 1, False), ("b", 1, 1, True)}


def test_saved_index_scores_alike(spark, tmp_path):
    docs = spark.createDataFrame([(1, "路灯亮了"), (2, "路灯没有亮"), (3, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "路灯亮")], "query_id long, text string")
    retrieval.save_index(docs, str(tmp_path / "index"))
    found, corpus = retrieval.load_index(spark, str(tmp_path / "index"))
    rows = lambda d: {(r.query_id, r.doc_id): round(r.score, 9) for r in d.collect()}
    assert rows(retrieval.scores_from(found, corpus, asked)) == rows(retrieval.scores(docs, asked)) and corpus.first().n == 3
    one = retrieval.macro(spark.createDataFrame([(1.0,), (0.5,)], "recall double")).first()
    assert (one.cases, one.macro_recall) == (2, 0.75)
    assert tuple(retrieval.macro(spark.createDataFrame([], "recall double")).first()) == (0, 0.0)


def test_baselines(spark):
    got = {r.block: r for r in style.baselines(spark).collect()}
    assert (got["style"].books, got["style"].holdout_books, got["style"].ai_chapters, len(got["style"].rules)) == (67, 20, None, 6)
    assert (got["dialogue"].chapters, got["dialogue"].ai_chapters, got["dialogue"].rules[0]) == (31889, 11, "对白破折号占比")


def test_listed_paths_without_regard_to_case(spark, tmp_path):
    (tmp_path / "Sub").mkdir()
    for name in ("b.txt", "A.txt", "Sub/c.md", "a2.txt"):
        (tmp_path / name).write_text("x")
    assert [r.path.rsplit(tmp_path.name + "/", 1)[1] for r in files.listed(spark, str(tmp_path)).collect()] == ["A.txt", "a2.txt", "b.txt", "Sub/c.md"]


def test_drift_of_a_stream_keeps_to_the_horizon(spark, tmp_path):
    """Book a has five high values within twelve numbers, b's five are spread wider; both arrive in two batches."""
    schema = "book string, ord long, rule string, value double"
    rows = [("a", i, "em_dash", 30.0) for i in range(1, 6)] + [("b", 5 * i, "em_dash", 30.0) for i in range(1, 6)]
    for i, part in enumerate((rows[:3] + rows[5:8], rows[3:5] + rows[8:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = streams.drifting(stream).writeStream.outputMode("append").format("memory").queryName("drift_horizon").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [tuple(r) for r in spark.table("drift_horizon").collect()] == [("a", 5, "em_dash", 30.0)]
    assert streams.progress(query)["rows"] == 10


def test_gold(spark, tmp_path):
    point = {"index": 1, "summary": "开门", "tone": "紧张", "theme_tags": ["悬念"]}
    (tmp_path / "corpus.json").write_text(json.dumps({"book_title": "甲", "summaries": [{"order": 2, "title": "二", "gist": "讲门", "plot_points": [point]}]}, indent=1), "utf-8")
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [{"case_id": "c1", "query": "门", "relevant_orders": [2, 3]}, {"case_id": "c2", "query": "雨", "relevant_orders": []}]}, indent=1), "utf-8")
    got = files.read_gold_corpus(spark, str(tmp_path / "corpus.json")).collect()
    assert [(r.ord, r.title, r.gist, r.points[0].summary, r.points[0].theme_tags) for r in got] == [(2, "二", "讲门", "开门", ["悬念"])]
    assert [tuple(r) for r in files.read_gold_cases(spark, str(tmp_path / "cases.json")).collect()] == [("c1", "门", [2, 3]), ("c2", "雨", [])]


@pytest.mark.parametrize(
    ("metric", "want"),
    [
        ("破折号密度", "他等了很久——没有人来。"),
        ("对白破折号占比", "「走——快走！」"),
        ("对白条数每千字", "（全章引号台词 2 条）"),
        ("段均句数", "天黑了。风停了。灯还亮着。"),
        ("没有这个指标", ""),
    ],
)
def test_style_evidence(spark, metric, want):
    text = "天黑了。风停了。灯还亮着。\n他等了很久——没有人来。\n“好的。”他说。\n“走——快走！”"
    row = spark.createDataFrame([(metric, text)], "metric string, text string").select(style.evidence(F.col("metric"), F.col("text")).alias("x")).first()
    assert row.x == want
