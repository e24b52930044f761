"""Hand-made texts for what the tables lack: CJK dialogue, headings, encodings, streams, chunks."""

import zipfile

import pytest

from wordloom.functions import text as T
from wordloom.operators import chapters, gates, knowledge, ledger, retrieval, runs, style
from wordloom.plans import deconstruct
from wordloom.sources import files
from wordloom.streaming import runs as streams


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "text string").select(expression.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, T.tokens("text"), "卷5页 木船，ＢＯＡＴ７") == ["卷", "5", "页", "木船", "boat7"]
    assert one(spark, T.tokens("text"), "一二三 a1é") == ["一二", "二三", "a1"] and one(spark, T.tokens("text"), "") == []


@pytest.mark.parametrize(("token", "value"), [("11", 11), ("十一", 11), ("二十", 20), ("两百", 200), ("两千零三", 2003), ("一万三千", 13000), ("x", None)])
def test_numerals(spark, token, value):
    assert one(spark, T.numeral("text"), token) == value


def test_sentences_keep_quotes_together(spark):
    got = one(spark, T.sentences("text"), "“门开着。”老周在院里喊。　快看！“灯还没灭。")
    assert [(s.at, s.text) for s in got] == [(0, "“门开着。”老周在院里喊。"), (14, "快看！"), (17, "“灯还没灭。")]
    assert len(one(spark, T.sentences("text"), "长" * 40_000)) == 1


def test_paragraphs_and_located(spark):
    assert one(spark, T.paragraphs("text"), "他走了\n没回来。\n====\n好。\n尾") == ["他走了没回来。", "好。", "尾"]
    assert one(spark, T.located("text", T.F.lit("b")), "abc") == 1 and one(spark, T.located("text", T.F.lit("a")), "aba") is None


def test_split_and_structure(spark):
    text = "前言\n第一章 开始\n他难道不知道？\n更新时间：今天\n第二章 中间\n走。\n第二章 又来\n第十章这是一个很长很长的正文句子没有分隔\n停！"
    parts = deconstruct.deconstruct(spark.createDataFrame([("b", text)], "book string, text string"))
    rows = parts["chapters"].orderBy("pos").collect()
    assert [(r.ord, r.title, r.line_no) for r in rows] == [(1, "开始", 2), (2, "中间", 5), (2, "又来", 7)]
    assert "".join(r.text for r in rows) == text[3:]
    warned = parts["warnings"].first()
    assert (warned.repeated, warned.contiguous, warned.preamble_chars) == (1, False, 3)
    assert [r.opening_hook_signal for r in parts["measures"].orderBy("pos").collect()] == [True, False, False]
    assert parts["structure"].first().chapters == 3


def test_gates(spark):
    rows = [("b", 1, "好" * 40 + "。"), ("b", 2, ""), ("b", 3, "作为一个AI，我不行。"), ("b", 4, "坏�字。"), ("b", 5, "正常的一句话。")]
    got = {r.ord: (r.rules, r.verdict) for r in gates.check(spark.createDataFrame(rows, "book string, ord int, text string")).collect()}
    assert got[1] == (["repeat_span"], "repair") and got[2] == (["truncated"], "reject") and got[3] == (["self_reference"], "repair")
    assert got[4] == (["mojibake"], "reject") and got[5] == ([], "pass")


def test_drift_needs_five_chapters(spark):
    rows = [("b", i, 20.0, 0.0, 0.0) for i in range(1, 7)] + [("c", i, 20.0, 0.0, 0.0) for i in range(1, 5)] + [("d", i * 4, 20.0, 0.0, 0.0) for i in range(1, 7)]
    prints = spark.createDataFrame(rows, "book string, ord int, em_dash double, period_per_paragraph double, simile_density double")
    assert sorted((r.book, r.ord, r.rule) for r in style.drift(prints).collect()) == [("b", 5, "em_dash"), ("b", 6, "em_dash")]


def test_fingerprint_runs(spark):
    got = style.fingerprint(spark.createDataFrame([("东西的颜色的边缘的温度。不是他，而是她。",)], "text string")).first()
    assert got.de_repeat == 3 and got.not_x_but_y == 1 and not got.passed


def test_hooks(spark):
    hooks = spark.createDataFrame([("b", 1, "神秘的红色钥匙"), ("b", 2, "！！"), ("b", 3, " ")], "book string, ord int, hook string")
    later = spark.createDataFrame([("b", 1, "神秘的红色钥匙"), ("b", 4, "他找到神秘的红色钥匙"), ("b", 5, "神秘的红色钥匙")], "book string, ord int, text string")
    assert {(r.opened, r.resolved) for r in ledger.resolutions(hooks, later).collect()} == {(1, 4), (2, None)}


def test_bm25_order(spark):
    docs = spark.createDataFrame([(1, "路灯 路灯"), (2, "路灯 桥"), (3, "桥"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "路灯")], "query_id long, text string")
    assert [r.doc_id for r in retrieval.top(retrieval.scores(docs, queries)).orderBy("rank").collect()] == [1, 2]


def test_chunks(spark):
    text = "# 标题\n\n正文一\n正文二\n\n# 只有标题\n\n" + "长" * 2500
    got = knowledge.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id").orderBy("index").collect()
    assert [(r.heading, len(r.text)) for r in got] == [("标题", 7), ("只有标题", 1200), ("只有标题", 1200), ("只有标题", 260)]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("中文".encode("gbk"))
    (tmp_path / "b.md").write_bytes("﻿笔记".encode())
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>一 &amp; 二</w:t></w:p><w:p>三</w:p>")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "中文", "b.md": "笔记", "c.docx": "一 & 二\n三\n"}
    files.write_knowledge_base(spark, str(tmp_path), str(tmp_path / "kb"))
    assert spark.read.parquet(str(tmp_path / "kb/chunks")).count() == 3


def test_stream_resumes(spark, tmp_path):
    schema = "run_id long, ord long, status string, at long"
    for i in range(2):
        spark.createDataFrame([(1, 1, f"s{i}", i), (1, i + 2, "committed", i)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        query = streams.into_ledger(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "mark"))
        query.awaitTermination(120)
    assert sorted(tuple(r) for r in streams.ledger(spark, str(tmp_path / "out")).select("ord", "status").collect()) == [(1, "s1"), (2, "committed"), (3, "committed")]


def test_runs(spark):
    records = spark.createDataFrame([("a", 1, "committed", ""), ("a", 2, "in_progress", ""), ("b", 1, "in_progress", "")], "run_id string, ord int, status string, error string")
    assert {(r.run_id, r.ord, r.status) for r in runs.reclaimed(records, "b", "dead").collect()} == {("a", 1, "committed"), ("a", 2, "failed"), ("b", 1, "in_progress")}


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and chapters


def test_quotes_of_the_whole_text(spark):
    assert one(spark, T.quotes("text"), "字" * 300 + "“二”，“一”。“ 二 ”‘’\"三\"“没有收尾\n下一行") == ["二", "一", "三", "没有收尾"]
    assert one(spark, T.quotes("text"), "没有") == []


def test_export_reaches_the_last_written_chapter(spark, tmp_path):
    from wordloom import queries

    rows = [(i, " " if i in (7, 41) else f"正文{i}", "b") for i in range(1, 42)] + [(100, "短", "c")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.queries()["s19_export_written"](spark, str(tmp_path)).collect()
    assert sorted((r.project, r.ord) for r in got) == [("b", i) for i in range(1, 41) if i != 7] + [("c", 1)]
    assert {r.ord: r.title for r in got if r.project == "b"}[31] == "第31章"


def test_context_is_retrieved_by_bm25(spark):
    """Against BM25 written out; the only chapter that is like chapter 9 stands eight chapters back."""
    import math
    import re

    from wordloom.operators import projects

    def tokens(x):
        return [g for r in re.findall("[一-鿿]+|[a-z0-9]+", x) for g in ([r] if len(r) == 1 or r < "一" else [r[i : i + 2] for i in range(len(r) - 1)])]

    lines = {1: "红色钥匙失落井底", 9: "红色钥匙再次出现", **{i: f"平静日子{chr(0x4E10 + i)}{chr(0x4E40 + i)}" for i in range(2, 9)}}
    outlines = [(b, i, x, x + add, "开篇", "") for b, add in (("b", "事"), ("c", "红色")) for i, x in lines.items()]
    gists = [(b, i, "章", lines[i] + "之后") for b in "bc" for i in (1, 3, 9)]
    heroes = [("b", None, "林川"), ("c", None, "红色")]
    frames = [spark.createDataFrame(rows, f"book string, ord int, title string{more}") for rows, more in ((outlines, ", core_event string, opening_hook string, ending_hook string"), (heroes, ""), (gists, ", gist string"))]
    index = projects.indexed(dict(zip(("outline-chapter", "protagonist", "summary-chapter"), frames)))
    got = {}
    for r in projects.retrieved(frames[0], index, frames[1], 4).orderBy("rank").collect():
        got.setdefault((r.book, r.ord), []).append(r.doc_id)
    for book, hero in (("b", "林川"), ("c", "红色")):
        docs = [(f"outline-chapter-{i}", i, f"{a}\n{a}\n{e}\n{h}") for b, i, a, e, h, _ in sorted(outlines) if b == book] + [("protagonist", None, f"{hero}\n{hero}")]
        docs += [(f"summary-chapter-{i}", i, f"{a}\n{a}\n{g}") for b, i, a, g in sorted(gists) if b == book]
        bags = [tokens(d[2]) for d in docs]
        mean = sum(map(len, bags)) / len(bags)
        for _, i, a, e, h, _ in [o for o in outlines if o[0] == book]:
            scored = []
            for at, ((name, own, _), bag) in enumerate(zip(docs, bags)):
                score = 0.0
                for w in tokens(f"{a}\n{e}\n{h}\n{hero}"):
                    df, tf = sum(w in x for x in bags), bag.count(w)
                    score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(bag) / mean))
                if own != i and score > 0:
                    scored.append((-round(score, 9), at, name))
            assert got.get((book, i), []) == [x[2] for x in sorted(scored)[:4]]
    assert got["b", 9][0] in ("outline-chapter-1", "summary-chapter-1")


def test_knowledge_is_searched(spark, tmp_path):
    from wordloom import queries

    pages = [(2, "u", "# 节奏\n\n慢热的开篇"), (7, "u", "路灯之下\n\n另一段"), (3, "u", "路灯之下"), (0, "u", "路灯之下")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, "路灯"), (2, "节奏")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.queries()["p08_knowledge_search"](spark, str(tmp_path)).collect()
    assert {(r.query_id, r.rank, r.source, r.heading) for r in got} == {(1, 1, "笔记/7.md", ""), (2, 1, "笔记/2.md", "节奏")}


def test_findings_have_evidence_and_score(spark):
    text = "\n".join(f"他在屋里坐着等{c}，外面的雨一直下得很大很大很大。后来他站起身走到窗边看着外面的雨——没有说话。" for c in "甲乙丙丁戊己庚辛壬癸" * 6)
    chapters = spark.createDataFrame([(1, text), (2, "短。")], "id int, text string")
    found = style.findings(chapters, "id")
    got = {r.metric: r.evidence for r in style.shown(found, chapters, "id").collect()}
    assert got["破折号密度"] == text.split("\n")[0][:60] and set(got) == {r.metric for r in found.collect()}
    one_of = lambda m, x: one(spark, style.evidence(T.F.lit(m), T.F.col("text")), x)
    assert one_of("对白破折号占比", "“好。”“我——”") == "「我——」" and one_of("对白条数每千字", "“好。”“我——”") == "（全章引号台词 2 条）"
    assert one_of("分句均字", "他站起身走了出去，走吧。") == "走吧" and one_of("段p90字", "他走了。\n好。").startswith("（整章没有")
    assert one_of("段p90字", "他走了。她来了。") == "（最长多句段只有 6 字）他走了。她来了。" and one_of("句均字", "他走了。") == ""
    scores = {r.id: (r.rules, r.findings, r.score) for r in style.scored(chapters, found, "id").collect()}
    assert scores[2] == (0, 0, 0.0) and scores[1] == (6, len(got), round(len(got) / 6, 4))
