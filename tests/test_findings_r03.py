"""What the findings of the third round named: no gram is shuffled, texts travel once, no pattern reads a run twice."""

from __future__ import annotations

import re
import time
from collections import Counter

import pyspark.sql.functions as F

from wordloom.functions import fixed as V
from wordloom.functions import text as T
from wordloom.operators import gates as G
from wordloom.operators import ledger as L
from wordloom.operators import transactions as X


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_repeats_shuffle_nothing_and_count_right(spark):
    texts = ["天" * 50, "abcdefghijkl" * 3 + "mnopqrstuvwx" * 3, "the cat sat on the mat " * 4, "短", "xyz　 " * 30, "𝒳一二" * 20]
    found = G.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    assert "Exchange" not in plan(found)
    got = {r.doc_id: (r.times, r.span) for r in found.collect()}
    want = {}
    for i, x in enumerate(texts):
        x = "".join(x.split())
        grams = [x[j : j + 12] for j in range(len(x) - 11)]
        if len(x) >= 36:
            span, times = max(Counter(grams).items(), key=lambda g: (g[1], -grams.index(g[0])))
            want[i] = (times, span)
    assert got == want


def test_a_gate_moves_texts_once(spark):
    rows = spark.createDataFrame([("a", i, f"第{i}章 {'门开了。' * 3}{i}") for i in range(1, 200)], "book string, ord int, text string")
    found = G.check(rows)
    assert plan(found).count("Exchange") == 1 and "Join" not in plan(found)
    assert found.count() == 199


def test_windows_reach_over_blocks(spark):
    same = {79: "甲" * 4 + "乙丙丁戊己", 80: "x" * 30, 99: "甲" * 4 + "乙丙丁戊己", 100: "甲" * 4 + "乙丙丁戊己"}
    rows = spark.createDataFrame([("a", i, same.get(i, f"{i:09d}" * 2)) for i in range(60, 121)], "book string, ord int, text string")
    got = {r.ord: (r.worst, r.overlap, r.containment) for r in G.cross_chapter(rows).collect()}
    assert sorted(got) == list(range(60, 121))
    assert got[99] == (79, 1.0, 1.0) and got[100] == (99, 1.0, 1.0) and got[80][1] == 0.0


def test_kept_manuscripts_travel_once(spark):
    records = spark.createDataFrame([("a", 1, "committed", 2), ("a", 2, "failed", None)], "book string, ord int, status string, chosen int")
    texts = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 2, "y"), ("a", 2, 1, "z")], "book string, ord int, attempt int, text string")
    before = spark.createDataFrame([("a", 2, "old", "draft")], "book string, ord int, text string, status string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        after = X.manuscripts_after(records, texts, before)
        assert plan(after).count("Exchange") == 3  # one for each table
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted(after.collect()) == [("a", 1, "y", "auto-accepted"), ("a", 2, "old", "draft")]


def test_plot_points_read_a_run_once(spark):
    texts = ["题\n" + "门" * 150_000 + "\n他走了。", "题\n一。二！？三\n四…五\n", "题\n一\n\n", "题\n一\r\n", "题\n 一 　\n二"]
    begun = time.time()
    found = L.plot_points(spark.createDataFrame([("a", i, x) for i, x in enumerate(texts)], "book string, ord int, text string"))
    got = {}
    for r in found.orderBy("ord", "index").collect():
        got.setdefault(r.ord, []).append(r.quote)
    assert time.time() - begun < 30
    for i, x in enumerate(texts[1:4], 1):
        body = x[2:].replace("\r\n", "\n") if i == 3 else x[2:]
        assert got.get(i, []) == [s.strip() for s in re.findall(V.SUMMARY_SENTENCE, body) if s.strip()]
    assert got[0] == ["他走了。"] and got[4] == ["二"]


def test_text_functions_keep_their_values(spark):
    odd = ["", " 　\x85a b \n", "\xa0", "x\ny \r\n", "甲乙，丙。丁㐀x"]
    d = spark.createDataFrame([(x,) for x in odd], "text string")
    rows = d.select("text", T.stripped("text").alias("s"), T.tail("text").alias("t"), T.count("text", V.CJK_STYLE).alias("n"), F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("s0"), F.regexp_replace("text", r"(?U)\s+$", "").alias("t0"), F.regexp_count("text", F.lit(V.CJK_STYLE)).alias("n0"))
    assert all((r.s, r.t, r.n) == (r.s0, r.t0, r.n0) for r in rows.collect())


def test_scores_and_evidence_need_no_join(spark):
    from wordloom.operators import style as S

    line = "他说：“你来了——快，坐！”她的手心一凉，后背发紧。"
    texts = ["\n".join([line] * 30), "短。", "\n".join(["天，地。人，你，我。"] * 60)]
    ch = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = S.findings(ch, "id").cache()
    one, two = S.scores(ch, "id"), S.evident(ch, "id")
    assert "Exchange hashpartitioning" not in plan(one) + plan(two)
    assert sorted(one.collect()) == sorted(S.scored(ch, found, "id").collect())
    assert sorted(two.collect()) == sorted(S.shown(found, ch, "id").select("id", "metric", "evidence").collect()) != []


def test_measures_fold_only_what_has_triggers(spark):
    from wordloom.operators import chapters as C

    text = "题\n 　他冷笑道。“难道？为什么！” 没事。\n" + "究竟如何？" * 60
    got = C.measures(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), "id").orderBy("id").collect()
    first = got[0].anchors[0]
    assert (first.start, first.end, first.triggers) == (text.index("他"), text.index("。") + 1, ["轻视·打脸前置"])
    for a in got[0].anchors:
        assert any(w in text[a.start : a.end] for rule in a.triggers for w in V.TRIGGERS[rule].split("|"))
    assert (got[0].anchor_count, len(got[0].anchors), got[0].anchors_overflow) == (50, 50, True)
