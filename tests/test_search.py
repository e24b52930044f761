"""The stored index, containment, hooks and open intervals against full scoring and all pairs."""

import math
from collections import Counter

import numpy as np
import pytest

from wordloom.operators import ledger, projects, retrieval, search


def said(rng, n, words=60):
    """Words of which some are very frequent."""
    return " ".join(f"w{min(int(rng.zipf(1.4)), words)}" for _ in range(n))


def bm25(docs, queries, k, k1=1.5, b=0.75):
    """Full scoring: docs and queries are lists of (id, skip, words)."""
    n, avgdl = len(docs), sum(len(w) for _, _, w in docs) / max(len(docs), 1)
    df = Counter(t for _, _, w in docs for t in set(w))
    out = {}
    for q, q_skip, terms in queries:
        scored = []
        for d, skip, words in docs:
            tf, total = Counter(words), 0.0
            for t, times in Counter(terms).items():
                if tf[t]:
                    norm = 1 - b + b * len(words) / avgdl
                    total += times * math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (k1 + 1) / (tf[t] + k1 * norm)
            if total > 0 and (skip is None or q_skip is None or skip != q_skip):
                scored.append((-round(total, 9), d))
        out[q] = [(d, -s) for s, d in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize(("tokens", "k"), [(250_000, 5), (300, 3), (300, 200)])
def test_search_is_full_scoring(spark, tmp_path, monkeypatch, tokens, k):
    """Blocks of all documents and of a few, more asked for than there are, groups, ties, and an index that is opened again."""
    monkeypatch.setattr(search, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(5)
    docs = [(g, i, i % 9, said(rng, int(rng.integers(0, 60)))) for g in ("a", "b") for i in range(120)]
    docs += [("a", 200 + i, None, "w1 w2 w3 w50") for i in range(20)] + [("a", 300, 1, None), ("a", 301, 1, ""), ("c", 1, 2, "")]
    asked = [(g, i, i % 9 if i % 2 else None, said(rng, int(rng.integers(1, 25)))) for g in ("a", "b", "c", "d") for i in range(20)] + [("a", 90, None, None), ("a", 91, None, "nowhere")]
    d = spark.createDataFrame(docs, "g string, doc_id long, own long, text string").repartition(3)
    q = spark.createDataFrame(asked, "g string, query_id long, own long, text string")
    search.build(d, str(tmp_path / "index"), group="g", skip=d.own)
    got = search.search(search.opened(spark, str(tmp_path / "index")), q, k, group="g", skip=q.own).collect()
    want = {}
    for g in "abcd":
        mine = [(i, s, (t or "").split()) for h, i, s, t in docs if h == g]
        for query, best in bm25(mine, [(i, s, (t or "").split()) for h, i, s, t in asked if h == g], k).items():
            want.update({(g, query, rank + 1): (doc, score) for rank, (doc, score) in enumerate(best)})
    have = {(r.g, r.query_id, r.rank): (r.doc_id, r.score) for r in got}
    assert {key: doc for key, (doc, _) in have.items()} == {key: doc for key, (doc, _) in want.items()} and len(want) > 80
    assert all(abs(have[key][1] - score) < 1e-8 for key, (_, score) in want.items())
    empty = d.limit(0)
    assert search.search(search.build(empty), q, k).count() == 0 and search.search(search.build(d.select("doc_id", "text")), q.limit(0), k).count() == 0


def test_a_block_carries_on_only_what_can_still_win():
    """Once the bound is reached, most documents of frequent terms are not summed, and the best are the same."""
    rng = np.random.default_rng(3)
    n, k = 2000, 5
    lists = [np.sort(rng.choice(n, size, replace=False)) for size in (6, 8, 9, 30, 40, 900, 1500, 1900, 2000, 2000)]
    docs = np.concatenate(lists)
    parts = np.concatenate([rng.uniform(0.5, 1.0, len(x)) for x in lists])
    stops = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    spans = list(zip(stops[:-1].tolist(), stops[1:].tolist()))
    weights = np.array([9.0, 9.0, 9.0, 5.0, 5.0, 0.3, 0.2, 0.1, 0.1, 0.1])
    tops = np.array([parts[a:b].max() for a, b in spans])
    for barred in (None, np.isin(np.arange(n), lists[0][:3])):
        total = np.zeros(n)
        for (a, b), w in zip(spans, weights):
            total[docs[a:b]] += w * parts[a:b]
        if barred is not None:
            total[barred] = 0
        places, scores = search.best_in_block(n, spans, weights, tops, docs, parts, barred, k)
        assert places.tolist() == np.lexsort((np.arange(n), -total))[:k].tolist() and np.allclose(scores, total[places])


def test_own_parts_are_left_out_before_ranking(spark):
    """A book's index of outlines, hero and summaries: a chapter never finds its own parts, however few are left."""
    outlines = spark.createDataFrame([("b", i, f"t{i}", "lamp road", "", "end") for i in range(1, 6)], "book string, ord int, title string, core_event string, opening_hook string, ending_hook string")
    sums = spark.createDataFrame([("b", 2, "t2", "lamp lamp road")], "book string, ord int, title string, gist string")
    heroes = spark.createDataFrame([("b", None, "lin")], "book string, ord int, title string")
    index = projects.indexed({"outline-chapter": outlines, "protagonist": heroes, "summary-chapter": sums})
    got = {}
    for r in projects.retrieved(outlines, index, heroes, 4).collect():
        got.setdefault(r.ord, {})[r.rank] = r.doc_id
    assert set(got) == {1, 2, 3, 4, 5} and all(len(v) == 4 for v in got.values())
    assert all(not name.endswith(f"-{o}") for o, v in got.items() for name in v.values())
    assert got[1][1] == "protagonist" or "summary-chapter-2" in got[1].values()


def test_containing(spark):
    rng = np.random.default_rng(7)
    docs = [(i, said(rng, 30) + ", 路灯亮了一夜。" * (i % 3 == 0) + " Ünïx " * (i % 5 == 0)) for i in range(60)] + [(100, None), (101, ""), (102, "xyz")]
    items = [(1, docs[0][1][3:40]), (2, "灯亮"), (3, "w1"), (4, ", "), (5, "灯"), (6, "yz"), (7, None), (8, ""), (9, "w1 w2"), (10, "not there at all"), (11, "1 w2 w"), (12, "了一夜。路"), (13, "ÜNÏX"), (14, "Ünïx"), (1, docs[0][1][3:40]), (15, "夜。 Ün")]
    got = search.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {(i, d) for i, t in items if t for d, text in docs if text and t in text}
    assert {(r.query_id, r.doc_id) for r in got.collect()} == want and {i for i, _ in want} >= {1, 2, 3, 4, 5, 6, 14, 15}


@pytest.mark.parametrize(("block", "cell"), [(1024, 32_768), (4, 8)])
def test_hooks_against_all_pairs(spark, monkeypatch, block, cell):
    """Every hook against every later chapter, with a token that all share, hooks without tokens, and gaps in the numbers."""
    monkeypatch.setattr(ledger, "BLOCK_CHAPTERS", block)
    monkeypatch.setattr(ledger, "CELL_HOOKS", cell)
    rng = np.random.default_rng(9)
    hooks = [(book, i, "hot " + said(rng, int(rng.integers(1, 7)), 400)) for book in ("a", "b") for i in range(1, 40, 2)] + [("a", 50, "…"), ("a", 51, ""), ("a", 52, None), ("c", 1, "hot w1"), ("a", 900, "hot w1")]
    chapters = [(book, i, "hot " + said(rng, 12, 400)) for book in ("a", "b") for i in [*range(1, 45), 70, 71, 100]] + [("a", 101, None), ("d", 1, "hot w1")]
    want = {}
    for book, opened, hook in hooks:
        own = set((hook or "").replace("…", "").split())
        if (hook or "").strip():
            met = sorted((o, len(own & set((t or "").split())) / len(own)) for b, o, t in chapters if own and b == book and o > opened and len(own & set((t or "").split())) / len(own) >= 0.6)
            want[book, opened] = met[0] if met else (None, None)
    got = ledger.resolutions(spark.createDataFrame(hooks, "book string, ord int, hook string"), spark.createDataFrame(chapters, "book string, ord int, text string")).collect()
    assert {(r.book, r.opened): (r.resolved, r.ratio) for r in got} == want
    assert sum(v[0] is not None for v in want.values()) > 10 and sum(v[0] is None for v in want.values()) > 5


@pytest.mark.parametrize("size", [64, 5])
def test_open_hooks_against_all_pairs(spark, size):
    rng = np.random.default_rng(2)
    rows = [(b, int(o), None if rng.random() < 0.3 else int(o + rng.integers(1, 60))) for b in "ab" for o in rng.integers(0, 120, 40)]
    at = [(b, i) for b in "abc" for i in range(1, 130) if i % 7]
    got = ledger.open_at(spark.createDataFrame(rows, "book string, opened int, resolved int"), spark.createDataFrame(at, "book string, ord int"), size).collect()
    want = sorted((b, n, o) for b, n in at for c, o, r in rows if b == c and o < n and (r is None or r >= n))
    assert sorted(tuple(r) for r in got) == want


def test_scores_and_search_agree(spark):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, said(rng, 20)) for i in range(40)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, said(rng, 6)) for i in range(5)], "query_id long, text string")
    rows = lambda d: {(r.query_id, r.rank): (r.doc_id, round(r.score, 9)) for r in d.collect()}
    assert rows(search.search(search.build(docs), asked)) == rows(retrieval.top(retrieval.scores(docs, asked)))
