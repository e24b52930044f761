"""Searches in books after the findings of the third round that were left: what is put in order, terms as rows of numbers."""

import numpy as np
from pyspark.sql import functions as F

from wordloom.operators import search as I


def test_only_what_reaches_the_best_is_ordered(monkeypatch):
    rng = np.random.default_rng(5)
    n, k = 4000, 10
    lists = [np.flatnonzero(rng.random(n) < x) for x in (0.02, 0.05, 0.1, 0.3, 0.6, 0.9)]
    docs, stops = np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    parts, weights = rng.uniform(0.5, 2, len(docs)), np.array([4.0, 3.0, 2.5, 1.2, 0.5, 0.1])
    spans = list(zip(stops[:-1].tolist(), stops[1:].tolist()))
    tops = np.array([parts[a:b].max() for a, b in spans])
    total = np.zeros(n)
    for (a, b), w in zip(spans, weights):
        total[docs[a:b]] += w * parts[a:b]
    ordered, lexsort = [], np.lexsort
    monkeypatch.setattr(I.np, "lexsort", lambda keys: ordered.append(len(keys[0])) or lexsort(keys))
    begun = np.zeros(n)
    for a, b, w in ((*spans[4], 0.5), (*spans[5], 0.1)):
        begun[docs[a:b]] += w * parts[a:b]
    for barred in (None, np.argsort(-total)[:3]):
        want = total.copy()
        if barred is not None:
            want[barred] = 0
        best = lexsort((np.arange(n), -want))[:k]
        places, scores = I.best_in_block(n, spans, weights, tops, docs, parts, barred, k)
        assert places.tolist() == best.tolist() and np.allclose(scores, want[best])
        places, scores = I.best_in_block(n, spans[:4], weights[:4], tops[:4], docs, parts, barred, k, begun.copy())
        assert places.tolist() == best.tolist() and np.allclose(scores, want[best])
    # Every document with a term was put in order before.
    assert max(ordered) < 10 * k


def test_frequent_and_rare_terms_in_one_search(spark, monkeypatch):
    """Blocks in which terms are rows of numbers give what lists alone give."""
    rng = np.random.default_rng(6)
    said = lambda m: " ".join(f"w{int(x)}" for x in rng.zipf(1.4, m) % 300)
    docs = spark.createDataFrame([(i % 2, i, said(12)) for i in range(600)], "g long, doc_id long, text string")
    asked = spark.createDataFrame([(i % 2, i, said(8)) for i in range(150)] + [(0, 900, "w1"), (1, 901, "nothing")], "g long, query_id long, text string")
    rows = lambda: {(r.query_id, r.rank): (r.doc_id, round(r.score, 8)) for r in I.search(I.build(docs, group="g", skip=F.col("doc_id")), asked, 5, group="g", skip=F.col("query_id")).collect()}
    found = rows()
    monkeypatch.setattr(I, "_DENSE", 0)
    assert len(found) > 700 and found == rows()
