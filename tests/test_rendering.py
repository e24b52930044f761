"""Deconstructions written, read back and rendered; parts as documents; tool calls."""

import os

import pytest
from pyspark.sql import functions as F

from wordloom.functions import fixed as V
from wordloom.operators import chapters as C
from wordloom.operators import rendering as D
from wordloom.operators import tools as A

SECRET = "他为什么要走？我怕得浑身发抖！“你到底是谁？”他问。天黑了。"


@pytest.fixture(scope="module")
def made(spark):
    rows = [("甲", i, i + 1, f"题{i}", f"题{i}\n{SECRET * (i % 3)}") for i in range(30)] + [("乙", 0, 1, None, "乙\n天亮了。")]
    measured = C.measures(spark.createDataFrame(rows, "book string, pos int, ord int, title string, text string"), "book", "pos", "ord", "title").cache()
    return C.structure(measured), measured


def test_round_trip(spark, made, tmp_path):
    structure, measured = made
    D.write(structure, measured, str(tmp_path / "d"))
    books, chapters, refused = D.load(spark, str(tmp_path / "d"))
    assert refused.count() == 0
    rows = lambda df: sorted((r.asDict(True) for r in df.collect()), key=lambda r: (r["book"], r.get("pos", 0)))
    assert rows(chapters.select(measured.columns)) == rows(measured)
    assert rows(books.select(structure.columns)) == rows(structure)


def test_lines_that_do_not_fit_are_refused(spark, made, tmp_path):
    path = str(tmp_path / "d")
    D.write(*made, path)
    with open(os.path.join(path, "chapters", "part-x.json"), "w", encoding="utf-8") as f:
        f.write('{"book": "丙"}\nno json\n[1]\n{"book": "丙", "pos": "first"}\n{"pos": 3}\n{"book": "丙", "pos": 0, "extra": 1}\n')
    _, chapters, refused = D.load(spark, path)
    assert [r.pos for r in chapters.filter("book = '丙'").collect()] == [0]
    assert sorted(r.line for r in refused.collect()) == sorted(['{"book": "丙"}', "no json", "[1]", '{"book": "丙", "pos": "first"}', '{"pos": 3}'])


def test_empty_deconstruction(spark, made, tmp_path):
    structure, measured = (df.limit(0) for df in made)
    D.write(structure, measured, str(tmp_path / "d"))
    assert [df.count() for df in D.load(spark, str(tmp_path / "d"))] == [0, 0, 0]
    assert D.author_view(structure, measured).count() == 0


def kb(made, **more):
    structure, measured = made
    spark = structure.sparkSession
    ledger = spark.createDataFrame([("甲", 1, 4), ("甲", 2, None)], "book string, opened int, resolved int")
    orders = {"opening_hook_signal": measured.filter("opening_hook_signal").select("book", "ord", F.col("pos").alias("at"))}
    return D.kb_view(structure, C.densities(measured), ledger, orders, **more)


def test_kb_view_holds_numbers_only(spark, made):
    lines = [r.line for r in kb(made).orderBy("book", "section", "at").collect()]
    text = "\n".join(lines)
    assert not any(s in text for s in ("为什么", "发抖", "到底", "天黑", "天亮"))
    assert "| 1 | 4 | 3 |" in lines and "| 2 | 未回收 | — |" in lines
    assert "| 开篇有悬念信号 | 共 20 章（前 12 章：2、3、5、6、8、9、11、12、14、15、17、18…） |" in lines
    own = [r for r in made[0].collect() if r.book == "甲"][0]
    assert f"| 总字数（去空白） | {own.total_chars} |" in lines
    assert f"| 对话句占比 | {own.avg_dialogue_ratio * 100:.2f}% |" in lines
    # A book without hooks has no such table, and each book says that no technique is known.
    other = [r.line for r in kb(made).filter("book = '乙'").collect()]
    assert V.LEDGER_HEAD not in other and V.NO_TECHNIQUES in other


def test_text_cannot_enter_the_kb_view(spark, made):
    structure, measured = made
    told = measured.select("book", "ord", F.lit(SECRET).alias("density"))
    with pytest.raises(TypeError):
        D.kb_view(structure, told, spark.createDataFrame([], "book string, opened int, resolved int"))


def test_techniques_and_spans(spark, made):
    techniques = spark.createDataFrame([("甲", 1, "second"), ("甲", 0, "first")], "book string, at int, technique string")
    spans = spark.createDataFrame([("甲", 2.5, 4, 3), ("乙", None, None, 1)], "book string, median_span double, longest_span int, open_hooks long")
    lines = [(r.book, r.line) for r in kb(made, techniques=techniques, spans=spans).orderBy("book", "section", "at").collect()]
    own = [x for b, x in lines if b == "甲"]
    assert own[-3:] == [V.TECHNIQUES_HEAD, "- first", "- second"]
    assert "| 钩子回收间隔中位数 | 2.5 章 |" in own and ("乙", "| 最长吊钩间隔 | — 章 |") in lines and ("乙", V.NO_TECHNIQUES) in lines


def test_author_view_gives_places_that_hold(made, spark, tmp_path):
    structure, measured = made
    view = D.author_view(structure, measured)
    rows = {(r.book, r.at): r.line for r in view.filter("section = 3").collect()}
    assert len(rows) == 31 and rows[("乙", 0)].startswith("## 第1章 \n- 字数 5 ｜ 句数 1")
    chapter = rows[("甲", 2)]
    text = "题2\n" + SECRET * 2
    places = [tuple(map(int, line[len("- 偏移 ") :].split(" ｜")[0].split("-"))) for line in chapter.split("\n") if line.startswith("- 偏移")]
    assert places and f"**疑似冲突点 {len(places)} 处**" in chapter
    assert {text[a:b] for a, b in places} <= {"他为什么要走？", "我怕得浑身发抖！", "“你到底是谁？”他问。"}
    assert "发抖" not in "".join(rows.values())
    D.write_view(view, str(tmp_path / "v"))
    folder = next(tmp_path.joinpath("v").glob("book=甲"))
    written = "".join(f.read_text(encoding="utf-8") for f in sorted(folder.glob("part-*")))
    want = [r.line for r in view.filter("book = '甲'").orderBy("section", "at").collect()]
    assert written == "\n".join(want) + "\n"


def test_first_orders_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 4)
    rows = spark.createDataFrame([("甲", 100 - i, i) for i in range(40)] + [("甲", 100, 50), ("乙", 1, 9)], "book string, ord int, at int")
    got = {r.book: (r.n, list(r.first)) for r in D.first_orders(rows).collect()}
    assert got == {"甲": (40, [100 - i for i in range(12)]), "乙": (1, [1])}


def test_parts_and_summaries_as_documents(spark):
    one = lambda **f: spark.createDataFrame([tuple(f.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in f.items()))
    parts = {
        "positioning": one(project=1, state="human-confirmed", genre="玄幻", audience=" ", core_premise=None, selling_points=["快", "爽"], tone_target="热"),
        "volume": one(project=1, state="draft", volume_title="卷", volume_goal="a", main_conflict="b", ending_hook="c"),
        "chapters": one(project=1, state="auto-accepted", ord=3, title="题", core_event="事", opening_hook="", ending_hook="钩"),
        "protagonist": one(project=1, state="human-confirmed", name="李", background="b", personality="", desire="d", flaw="f", signature_ability="s"),
        "golden_finger": one(project=1, state="human-confirmed", name="戒", form="f", ability="a", cost_limitation="c", growth_path=""),
    }
    got = {r.doc_id: (r.doc_type, r.ord, r.title, r.text) for r in D.part_documents(parts).collect()}
    assert got == {
        "positioning": ("positioning", None, "题材定位", "玄幻\n快 爽\n热"),
        "outline-chapter-3": ("chapter_outline", 3, "题", "题\n事\n钩"),
        "protagonist": ("protagonist", None, "李", "李\nb\nd\nf\ns"),
        "golden-finger": ("golden_finger", None, "戒", "戒\nf\na\nc"),
    }
    ddl = "project int, ord int, title string, gist string, characters array<string>, plot_points array<struct<summary:string,characters:array<string>,theme_tags:array<string>,tone:string,quote:string>>"
    rows = [(1, 2, "题", "要", ["乙", "甲", "乙"], [("点", ["甲"], ["复仇", "悬念"], "紧张", SECRET), ("二", [], ["复仇"], "热血", SECRET)]), (1, 3, None, "", None, None)]
    told = D.summary_documents(spark.createDataFrame(rows, ddl))
    a, b = sorted(told.collect(), key=lambda r: r.ord)
    assert (a.doc_id, a.text) == ("summary-chapter-2", "题\n要\n点\n甲\n复仇 悬念\n紧张\n二\n复仇\n热血\n乙 甲 乙")
    assert (list(a.characters), list(a.themes), list(a.tones)) == (["乙", "甲"], ["复仇", "悬念"], ["热血", "紧张"])
    assert (b.text, list(b.characters), list(b.themes), list(b.tones)) == ("", [], [], [])


def test_the_quote_is_never_read(spark, tmp_path):
    ddl = "project int, ord int, title string, gist string, characters array<string>, plot_points array<struct<summary:string,characters:array<string>,theme_tags:array<string>,tone:string,quote:string>>"
    spark.createDataFrame([(1, 2, "题", "要", ["乙"], [("点", ["甲"], ["悬念"], "紧张", SECRET)])], ddl).write.parquet(str(tmp_path / "s"))
    found = D.summary_documents(spark.read.parquet(str(tmp_path / "s")))
    assert SECRET not in str(found.collect())


def test_tool_arguments():
    assert A.problem_of("get_outline", '{"order": 3, "more": 1}') == (None, {"order": 3})
    assert A.problem_of("get_outline", '{"order": " 3 "}') == A.problem_of("get_outline", '{"order": 3.0}') == (None, {"order": 3})
    assert A.problem_of("list_open_foreshadows", None) == A.problem_of("list_open_foreshadows", " ") == (None, {})
    for tool, args, problem in [
        (None, "{}", "unknown tool None"),
        ("drop_all", "{}", "unknown tool drop_all"),
        ("get_outline", "{", "arguments are no JSON"),
        ("get_outline", "[" * 5000, "arguments are no JSON"),
        ("get_outline", "[1]", "arguments are no object"),
        ("get_outline", "", "order: absent"),
        ("get_outline", '{"order": true}', "order: not a whole number"),
        ("get_outline", '{"order": 3.5}', "order: not a whole number"),
        ("get_outline", '{"order": NaN}', "order: not a whole number"),
        ("search_own_book", '{"query": 3}', "query: not a text"),
        ("search_own_book", '{"query": null}', "query: not a text"),
    ]:
        assert A.problem_of(tool, args) == (problem, {})


def test_tool_calls_end_as_rows(spark):
    calls = spark.createDataFrame(
        [
            (1, "甲", 3, "get_outline", '{"order": 2}'),
            (2, "甲", 3, "get_outline", '{"order": 9}'),
            (3, "甲", 3, "list_open_foreshadows", None),
            (4, "甲", None, "list_open_foreshadows", "{}"),
            (5, "甲", 3, "search_own_book", '{"query": "lantern oath"}'),
            (6, "乙", 3, "search_own_book", '{"query": "lantern"}'),
            (7, "甲", 3, "search_methodology", '{"query": "twist"}'),
            (8, "甲", 3, "search_methodology", '{"query": "zebra"}'),
            (9, "甲", 3, "get_outline", '{"order": []}'),
            (10, "甲", 3, "format_disk", "{}"),
            (11, None, None, None, None),
        ],
        "call_id int, book string, ord int, tool string, args string",
    )
    outlines = spark.createDataFrame([("甲", 2, "题", "事", None, "钩")], "book string, ord int, title string, core_event string, opening_hook string, ending_hook string")
    ledger = spark.createDataFrame([("甲", 1, None), ("甲", 2, 3), ("甲", 3, None)], "book string, opened int, resolved int")
    hooks = spark.createDataFrame([("甲", 1, "一"), ("甲", 2, "二"), ("甲", 3, "三")], "book string, ord int, hook string")
    docs = spark.createDataFrame([("甲", "a", "volume", "A", "the lantern\nburns"), ("甲", "b", "volume", "B", "an oath and a lantern"), ("乙", "c", "volume", "C", "nothing here")], "book string, doc_id string, doc_type string, title string, text string")
    kb = spark.createDataFrame([(1, "x.md", "# Twist\n\nhow to twist " + "y" * 400)], "doc_id int, source string, text string")
    tools = {
        "get_outline": lambda c: A.outlines_read(c, outlines),
        "list_open_foreshadows": lambda c: A.hooks_listed(c, ledger, hooks),
        "search_own_book": lambda c: A.book_searched(c, docs),
        "search_methodology": lambda c: A.methods_searched(c, kb),
    }
    got = {r.call_id: r for r in A.answered(A.checked(calls).cache(), tools).collect()}
    assert len(got) == 11
    assert got[1].output == "第2章《题》｜核心事件：事｜开篇钩：｜章尾钩：钩" and got[1].ok and got[1].hint is None
    assert got[2].output == "没有第 9 章细纲（当前细纲共 1 章）。"
    assert got[3].output == "- 第1章埋：一\n- 第2章埋：二" and got[4].output == V.NO_HOOKS
    assert got[5].output == "- [volume] B：an oath and a lantern\n- [volume] A：the lantern burns"
    assert got[6].output == V.NO_HITS and got[8].output == V.NO_METHOD
    assert got[7].output.startswith("- 来源 x.md ：# Twist how to twist y") and got[7].output.endswith("…")
    assert (got[9].ok, got[9].output, got[9].retryable) == (False, "order: not a whole number", True)
    assert (got[10].ok, got[10].output, got[10].retryable) == (got[11].ok, "unknown tool format_disk", got[11].retryable) == (False, "unknown tool format_disk", False)
