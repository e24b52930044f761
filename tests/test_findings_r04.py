"""Findings of the fourth round: odd texts in queries that have SQL, style measures by one kernel."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wordloom.functions import fixed as V
from wordloom.functions import prose as N
from wordloom.functions import text as T
from wordloom.operators import style as S

ODD = [
    "", " ", "\n\n", "#", "## ", "　", "\t \x0b", "\xa0", " x ", "a\rb", "a\r\nb\r\n", "a\x0cb\n", "a\x0bb\x0b", "x\x85y z", "x\x1cy\x1d", "# a\n#", None,
    "one line " * 60, "“a” b。\n" * 90, "first\n  last \xa0\n　\n", "é" * 301, "𝒜" * 301, " " + "y" * 300 + " ", "z" * 14 + " tail", "\x00a\x00",
]


def _same(spark, folder, name, texts=ODD):
    d = spark.createDataFrame([(i, f"src{i % 3}", x) for i, x in enumerate(texts)], "doc_id long, source string, text string")
    d.coalesce(1).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    found = entry.queries()[name](spark, str(folder))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    wanted = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in wanted.description]
    assert sorted(found.columns) == sorted(names)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in found.select(*[f"`{x}`" for x in names]).collect()), key=key) == sorted(wanted.fetchall(), key=key)


@pytest.mark.parametrize("name", ["x21_mechanical_summary", "x24_snippet"])
def test_odd_texts_are_as_in_sql(spark, tmp_path, name):
    _same(spark, tmp_path, name)


def test_snippets_of_tools_still_say_that_they_have_no_body(spark):
    d = spark.createDataFrame([("",), (" #\n",), ("#" * 301,), ("# a",), ("\xa0b\u2028 c",), ("x" * 301,)], "text string")
    found = [r[0] for r in d.coalesce(1).select(T.flat_snippet("text")).collect()]
    assert found == ["（该片段无正文）"] * 3 + ["# a", "b c", "x" * 300 + "…"]


def _texts():
    """Texts of letters and marks that the queries take for Chinese ones, some with words and marks of their own."""
    deal = random.Random(4)
    pieces = [*"abcdefghijklmnopqrstuvwxyz", "y" * 2, "w", "v", "vv", "vvv", "x", "xx", "xxx", ".", "!", " ", ",", "\n", "\n  ", "\n\n", "\n====\n", "\n*\n", "as", "像是", "心里", "情绪", "老师父", "二三", "五",
              "12", "1.2.3", "4.", "K", "”", "「", "」", "―", "……", "。", "？", "㐀", "䶿", "鿿", "豈", "𠀀", "知道", "你们", "感到", "意识到", "仿佛预示"]
    weights = [deal.randint(1, 9) for _ in pieces]
    texts = ["".join(deal.choices(pieces, weights, k=deal.choice([1, 40, 400, 1500, 6000]))) for _ in range(60)]
    return [*texts, "", None, "\n", "a" * 3000, "ab. " * 300 + "y", "w" + "yabw. " * 200, ("a" * 399 + "\n") * 9, "Haab, y" + "he said.\n" * 99]


@pytest.mark.parametrize("name", ["x11_style_measures", "x29_style_scores", "x28_limits_judged", "a23_baselines_judged"])
def test_style_is_as_in_sql(spark, tmp_path, name):
    _same(spark, tmp_path, name, [x for x in _texts() if x is not None])


def test_measures_of_the_kernel_are_those_of_expressions(spark):
    d = spark.createDataFrame(list(enumerate(_texts())), "i int, text string").coalesce(1)
    m = N.measures("text")
    talk = [F.bround(F.get(m["dialogue"], F.lit(i)), 9).alias(k) for i, k in enumerate(V.DIALOGUE_RULES)]
    found = {r.i: r for r in d.select("i", m["dialogue_checked"].alias("dialogue_checked"), *talk).collect()}
    for r in S.dialogue(d, "i").select("i", "dialogue_checked", *[F.bround(k, 9).alias(k) for k in V.DIALOGUE_RULES]).collect():
        assert found[r.i] == r or (r.dialogue_checked is None or not r.dialogue_checked) and not found[r.i].dialogue_checked
    assert any(r.dialogue_checked for r in found.values())


@pytest.mark.parametrize("name", ["x11_style_measures", "x22_style_evidence", "x29_style_scores", "a23_baselines_judged"])
def test_texts_are_neither_cut_by_expressions_nor_shuffled(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and plan.count("regexp_count") == 0
    assert all("text#" not in line for line in plan.split("\n") if "Exchange" in line)


def test_evidence_keeps_the_number_of_its_chapter(spark, tmp_path):
    d = spark.createDataFrame([(0, "src", "abc"), (1, "src", "aaaaaaaaaaaa. " * 40), (2, "src", ("ab, " * 60 + "cab!\n") * 6), (3, "src", None)], "doc_id long, source string, text string")
    d.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.ord, r.metric) for r in entry.queries()["x22_style_evidence"](spark, str(tmp_path)).collect()}
    assert {r[0] for r in found} == {3} and (3, "分句均字") in found


def test_evidence_of_the_kernel_is_that_of_expressions(spark):
    d = spark.createDataFrame(list(enumerate(x and x.translate(str.maketrans("abcdefghijklmnopqrstuvwxyz .,!", "胸而我怕的一是手像第他啊个不难你她觉口动道—”…“章，。、！")) for x in _texts())), "i int, text string").coalesce(1)
    made = S.shows(d, "i").select("i", F.inline("found"))
    found = {(r.i, r.metric): r.evidence for r in made.collect()}
    wanted = made.join(d, "i").select("i", "metric", S.evidence(F.col("metric"), F.col("text")).alias("e")).collect()
    assert {(r.i, r.metric): r.e for r in wanted} == found and len({m for _, m in found}) > 5
