"""The language model and the language classifier against versions written with dictionaries and sets."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import kneser_ney, language_id, packing, queries, warc
from wordloom.llm.queries import tokenizer_file


class KneserNey:
    """Interpolated modified Kneser-Ney of lists of words, by the book."""

    def __init__(self, texts, order):
        self.order, counts = order, Counter()
        for words in texts:
            padded = ["<s>"] * (order - 1) + words + ["</s>"]
            counts.update(tuple(padded[i : i + order]) for i in range(len(padded) - order + 1))
        self.levels = []
        for _ in range(order):
            self.levels.insert(0, counts)
            counts = Counter(gram[1:] for gram in counts)  # continuations: distinct words before
        self.vocabulary = {w for words in texts for w in words} | ({"</s>"} if texts else set())
        self.discounts, self.contexts = [], []
        for level in self.levels:
            n = [sum(c == i for c in level.values()) for i in range(1, 5)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
            raw = [i + 1 - (i + 2) * y * (n[i + 1] / n[i] if n[i] else 0) for i in range(3)]
            self.discounts.append([0.0] + [min(max(x, 0.05), i + 0.95) for i, x in enumerate(raw)])
            by = defaultdict(list)
            for gram, c in level.items():
                by[gram[:-1]].append(c)
            self.contexts.append(by)

    def p(self, history, word):
        out = 1 / (len(self.vocabulary) + 1)
        for k in range(1, self.order + 1):
            context = tuple(history[len(history) - k + 1 :])
            seen, d = self.contexts[k - 1].get(context), self.discounts[k - 1]
            if seen:
                c = self.levels[k - 1][(*context, word)]
                out = (max(c - d[min(c, 3)], 0) + sum(d[min(x, 3)] for x in seen) * out) / sum(seen)
        return out

    def score(self, words):
        padded, start = ["<s>"] * (self.order - 1) + words + ["</s>"], self.order - 1
        return sum(math.log10(self.p(padded[:i], padded[i])) for i in range(start, len(padded)))


def lower(text):
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w).decode() for w in (text or "").encode().split()]


@pytest.fixture(scope="module")
def told():
    rng = np.random.default_rng(8)
    texts = [" ".join(f"W{min(int(rng.zipf(1.5)), 40)}" if rng.random() < 0.5 else f"é{min(int(rng.zipf(1.6)), 20)}" for _ in range(int(rng.integers(0, 40)))) for _ in range(40)]
    return [*texts, None, "", " \t", "w1 w1 w1 w1", texts[3], texts[3]]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_kneser_ney_by_the_book(spark, told, order):
    new = ["w1 unheard w2", "É1 é1 W2", None, "", *told[:6]]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in told], "text string").repartition(3), order)
    book = KneserNey([lower(t) for t in told], order)
    got = kneser_ney.score(spark.createDataFrame([(t,) for t in [*told, *new]], "text string"), model, "text").collect()
    assert len(got) == len(told) + len(new)
    for r in got:
        assert math.isclose(r.score, book.score(lower(r.text)), rel_tol=1e-9), r.text
        assert r.n_known == sum(w in book.vocabulary for w in lower(r.text)) + 1


def test_kneser_ney_query(spark, told, tmp_path):
    """The query on a small table: held-out rows, null and repeated ids, columns with the result's names; and an empty table."""
    rows = [(i, t) for i, t in enumerate(told)] + [(None, "w1 w2"), (3, told[3]), (3, told[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "n_tokens": F.lit(1), "held_out": F.lit(2)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
    learnt = [lower(t) for i, t in rows if not held(i)]
    book, count = KneserNey(learnt, 2), Counter(w for words in learnt for w in [*words, "</s>"])
    n, v = sum(count.values()), len(count)
    got = queries.op1_kneser_ney(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], round(r[6], 6))
    want = []
    for i, t in rows:
        words = [*lower(t), "</s>"]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        want.append((i, held(i), len(words), sum(w in count for w in words), n, base, book.score(lower(t))))
    have = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=key)
    for a, b in zip(have, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op1_kneser_ney(spark, f"{tmp_path}/none").count() == 0


M = 1 << 64


def dimension(gram):
    """A gram's feature, in whole numbers of Python."""
    h = 0
    for c in gram:
        h = (h * 0x2127599BF4325C37 + ord(c)) % M
    x = (h + (len(gram) << 40)) % M
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % M
    return (x ^ (x >> 31)) >> 51


def grams(text):
    """Letter grams of one to three characters that begin or end with a letter; a blank stands for what isn't a letter."""
    s = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    s = " ".join(s) + " " if s else ""
    return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i] != " " or s[i + n - 1] != " "}


def test_features_are_the_gram_sets():
    texts = ["abca", "bcab!", None, "!", "Ça va? Où--est", "  x", "x", "日本語 の", "a b", "", "ΑΒ ß"]
    for order in (texts, texts[::-1], texts[1:] + texts[:1]):
        x, has = language_id.presence(order)
        assert [set(np.flatnonzero(row).tolist()) for row in x] == [{dimension(g) for g in grams(t)} for t in order]
        assert has.tolist() == [bool(grams(t)) for t in order]


def test_classifier_by_hand(spark):
    """Kernels from sets, and ridge regression on the landmarks as a linear system of its own."""
    rng = np.random.default_rng(5)
    alphabets = {"aa": "aeioust", "bb": "klmnorz", "cc": "éèàçuvw"}
    text = lambda k, n: " ".join("".join(rng.choice(list(alphabets[k]), rng.integers(2, 7))) for _ in range(n))
    rows = [(k, text(k, int(rng.integers(3, 20)))) for k in alphabets for _ in range(14)]
    new = [text(k, 4) for k in alphabets for _ in range(5)] + [None, "", "12 3!", "K", rows[0][1]]
    model = language_id.Model(rows, landmarks=5)
    sets = [{dimension(g) for g in grams(t)} for _, t in rows]
    marks = [i for k in sorted(alphabets) for i in [j for j, (lang, _) in enumerate(rows) if lang == k][:5]]
    kernel = lambda a, b: len(a & b) / math.sqrt(max(1, len(a)) * max(1, len(b)))
    k_nm = np.array([[kernel(s, sets[j]) for j in marks] for s in sets])
    k_mm = k_nm[marks]
    y = np.array([[1.0 if lang == k else -1.0 for k in sorted(alphabets)] for lang, _ in rows])
    weight = np.full(len(rows), len(rows) / (14 * 3))
    solved = np.linalg.solve(k_nm.T @ (k_nm * weight[:, None]) + language_id.RIDGE * k_mm, k_nm.T @ (y * weight[:, None]))
    want = []
    for t in new:
        s = {dimension(g) for g in grams(t)}
        value = np.array([kernel(s, sets[j]) for j in marks]) @ solved
        want.append((sorted(alphabets)[value.argmax()], min(max((value.max() + 1) / 2, 0), 1)) if s else ("und", 0.0))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(new)], "doc_id long, text string").withColumns({"score": F.lit("x"), "LANG_PRED": F.lit(1)})
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).select("doc_id", "lang_pred", "score").collect()}
    for i, (lang, score) in enumerate(want):
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-4, (i, got[i], lang, score)
    assert sum(lang == k for (lang, _), k in zip(want, [k for k in alphabets for _ in range(5)])) >= 12


def test_empty_tables_and_null_ids(spark):
    """Matrices keep rows without an id and repeated rows; derivatives of no pages, repeated pages and null ids."""
    from tokenizers import Tokenizer

    rows = [(1, "one two three"), (None, "no id"), (None, None), (1, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = packing.matrices(docs, tokenizer_file(), window=64).collect()
    tokenizer = Tokenizer.from_file(tokenizer_file())
    want = Counter((doc, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for doc, t in rows)
    assert Counter((doc, b - a) for r in held for doc, a, b in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:])) == want
    assert packing.matrices(docs.limit(0), tokenizer_file(), window=64).count() == 0
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (1, "http://a/", "<p>x</p>"), (None, "http://b/", "<p>y</p>")], "page_id long, url string, html string")
    assert Counter((r.page_id, r.type) for r in warc.derive(warc.responses(pages)).collect())[1, "conversion"] == 2
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0
