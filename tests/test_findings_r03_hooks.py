"""Hooks, quotes and recall after the findings of the third round that were left: ids of tokens, cells of hooks, places of quotes."""

import unicodedata

from pyspark.sql import functions as F

from wordloom.functions import fixed as V
from wordloom.functions import hashed as H
from wordloom.functions import text as T
from wordloom.operators import ledger as L
from wordloom.operators import quotes as Q
from wordloom.operators import retrieval as R
from wordloom.operators import search as I

TEXTS = ["", " ", "abc", "ABC ａｂｃ", "道路x1 一 y", "一二三", "一二三一二", "一a二", "K İa ſ İ", "𝒜一𝒜二 ÉCO 9 ９", "a\nb", "x" * 5000, "。一。", None, "ǅa Σς"]


def test_token_ids_name_tokens(spark):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, text string").coalesce(1)
    rows = d.select("i", T.tokens("text").alias("t"), H.token_ids("text").alias("h"), H.token_ids("text", distinct=True).alias("u")).collect()
    named = {}
    for r in rows:
        if r.t is None:
            assert r.h is None and r.u is None
            continue
        assert len(r.t) == len(r.h) and r.u == sorted(set(r.h))
        for token, one in zip(r.t, r.h):
            assert named.setdefault(token, one) == one
    assert len(set(named.values())) == len(named)


def test_blocks_are_sent_once_for_all_hooks_that_are_left(spark, monkeypatch):
    # 400 chapters in blocks of 8; three hooks stay open until far away or for ever.
    monkeypatch.setattr(L, "BLOCK_CHAPTERS", 8)
    monkeypatch.setattr(L, "CELL_HOOKS", 16)
    sizes, run = [], L._earliest

    def counted(threshold):
        inner, acc = run(threshold), made

        def kernel(key, hooks, chapters):
            acc.add(chapters.num_rows)
            return inner(key, hooks, chapters)

        return kernel

    made = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(L, "_earliest", counted)
    text = lambda i: "天地 " + ("远山近水" if i == 390 else "此处")
    chapters = spark.createDataFrame([("b", i, text(i)) for i in range(400)], "book string, ord int, text string")
    hooks = spark.createDataFrame([("b", i, "远山近水" if i in (0, 200) else "无人知晓" if i == 100 else "天地") for i in range(400)], "book string, ord int, hook string")
    got = {r.opened: (r.resolved, r.ratio) for r in L.resolutions(hooks, chapters).collect()}
    sizes.append(made.value)
    want = {i: (i + 1, 1.0) if i < 399 else (None, None) for i in range(400)} | {0: (390, 1.0), 200: (390, 1.0), 100: (None, None)}
    assert got == want
    # Each block once or twice at first, then once for the three hooks together, however long the book (13 cells of numbers before).
    assert sizes[0] <= 2 * 400 + 400


def test_chapters_are_folded_by_table(monkeypatch):
    text = "Ａb ﬁn…　½ ㍻，“x”\u200b\U0001d49c\U000e0100𠀀 ﷺ é é\n" + "".join(map(chr, range(0x21, 0xD800, 7)))
    one = lambda c: "".join(x for x in unicodedata.normalize("NFKC", c) if not x.isspace())
    calls = []
    Q._folds()
    monkeypatch.setattr(Q, "_fold", lambda c: calls.append(c) or one(c))
    chapter = Q._Chapter(text)
    for marks in (True, False):
        pairs = [(x, i) for i, c in enumerate(text) for x in one(c) if marks or x not in V.LOOSE_MARKS]
        form, places = chapter.form(marks)
        assert form == "".join(x for x, _ in pairs) and places.tolist() == [i for _, i in pairs]
    # A chapter's letters are not folded one by one (all of them were before), only a quote's.
    assert not calls
    assert chapter.place("fin...") == {"start": 3, "stop": 6, "level": 2}
    assert calls and Q._Chapter("").form(True)[0] == ""


def test_documents_are_not_cut_into_letters(spark):
    docs = spark.createDataFrame([(1, "a-b, c"), (2, "??!"), (3, "我们 a"), (4, None), (5, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "?"), (2, "a"), (3, "们"), (4, ""), (5, None), (6, "-b"), (7, "zz"), (8, "?!")], "item_id long, text string")
    found = I.containing(docs, items)
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {(i.item_id, d) for i in items.collect() for d, x in texts.items() if i.text and x and i.text in x}
    assert {tuple(r) for r in found.select("query_id", "doc_id").collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Each letter of each document was a row before, whether or not an item asked for it.
    assert "array_distinct(split(" not in plan


def test_recall_takes_the_gold_once(spark):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        reads.add(1)
        return x

    gold = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (2, 12), (3, 13)], "query_id long, doc_id long").withColumn("doc_id", seen("doc_id"))
    ranked = spark.createDataFrame([(1, 11), (1, 11), (1, 99), (3, 13), (4, 10)], "query_id long, doc_id long")
    got = {tuple(r) for r in R.recall(ranked, gold).collect()}
    assert got == {(1, 3, 2, 0.666667), (2, 1, 0, 0.0), (3, 1, 1, 1.0)}
    # The containment join behind the gold ran twice before.
    assert reads.value == 5
