"""Hooks by narrow rows and lists of open hooks, after the findings of the third round that were left."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom import queries as Q
from wordloom.functions import hashed as H
from wordloom.operators import ledger as L
from wordloom.operators import tools as A

TEXTS = ["", " ", "abc", "ABC ａｂｃ", "道路x1 一 y", "a一2", "K İa ſ İ K.", "𝒜一𝒜二 ÉCO 9 ９", "a\nb.,!z", "Ｋ，．", None, "ǅa Σς ΑΣ vwxyz—"]


def test_token_ids_through_a_table_of_letters(spark):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, text string").coalesce(1)
    for distinct in (False, True):
        through, made = H.token_ids("text", distinct, (Q.LATIN, Q.CHINESE)), H.token_ids(F.translate(F.lower("text"), Q.LATIN, Q.CHINESE), distinct)
        rows = d.select("i", through.alias("a"), made.alias("b")).collect()
        assert all(r.a == r.b for r in rows) and sum(bool(r.a) for r in rows) > 5


@pytest.mark.parametrize("name", ["t03_open_hooks", "e03_tool_calls", "p07_context_retrieved"])
def test_no_chapter_is_written_whole(spark, tmp_path, monkeypatch, name):
    names, kept = [], Q.Tables.kept

    def noted(self, what, df):
        names.append((what, df.columns))
        return kept(self, what, df)

    monkeypatch.setattr(Q.Tables, "kept", noted)
    texts = ["The lamp is out.", "Nobody knows. The end", None, " ", "The lamp is out again", "Nobody came"]
    spark.createDataFrame([(i, x, "s") for i, x in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert Q.queries()[name](spark, str(tmp_path)).count() > 0
    # The chapters' texts were translated, numbered and written before, then cut into tokens from there.
    assert names and all("text" not in columns for _, columns in names)


@pytest.mark.parametrize("size", [64, 5])
def test_lists_of_open_hooks(spark, size):
    rng = np.random.default_rng(4)
    rows = [(b, int(o), None if rng.random() < 0.3 else int(o + rng.integers(1, 60))) for b in "ab" for o in rng.choice(120, 40, replace=False)]
    found = spark.createDataFrame(rows, "book string, opened int, resolved int")
    at = spark.createDataFrame([(b, i) for b in "abc" for i in range(1, 130) if i % 7], "book string, ord int")
    want = {}
    for r in L.open_at(found, at).orderBy("opened").collect():
        want.setdefault((r.book, r.ord), []).append(r.opened)
    assert {(r.book, r.ord): r.hooks for r in L.open_lists(found, at, size=size).collect()} == want


def test_calls_list_hooks_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(L, "open_at", lambda *_: pytest.fail("a call and a hook were a row"))
    calls = spark.createDataFrame([(1, "b", 5), (2, "b", 1), (3, "b", None), (4, "c", 9), (5, "b", 5)], "call_id long, book string, ord int")
    hooks = spark.createDataFrame([("b", 1, "灯"), ("b", 2, "路"), ("b", 3, "门"), ("b", 7, "窗")], "book string, ord int, hook string")
    found = spark.createDataFrame([("b", 1, None), ("b", 2, 3), ("b", 3, 5), ("b", 7, None)], "book string, opened int, resolved int")
    got = {r.call_id: r.output for r in A.hooks_listed(calls, found, hooks).collect()}
    none, both = A.V.NO_HOOKS, "\n".join(A.V.OPEN_HOOK % x for x in ((1, "灯"), (3, "门")))
    assert got == {1: both, 2: none, 3: none, 4: none, 5: both}
