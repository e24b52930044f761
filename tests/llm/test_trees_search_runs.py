"""The Merkle manifest, the exact top-k search and the periodic runs against brute force, with nulls, ties, repeated rows, clashing names and empty tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import merkle, periodic, queries, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes, fan):
    """The nodes of each level from the leaves to the last one left."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def steps(tree, i, fan):
    """(left, right) of the node's siblings, level by level."""
    found = []
    for level in tree[:-1]:
        lo = i // fan * fan
        found.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + fan])))
        i //= fan
    return found


def manifest_of(rows, fan=3):
    """Per row (leaf, subroot, root, proof), in the order of the rows."""
    groups = {}
    for at, (doc, text, lang, source, n) in enumerate(rows):
        groups.setdefault(source, []).append((doc is not None, doc or 0, leaf_of(doc, source, lang, n, text), at))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s])], fan) for s in names}
    top = levels([trees[s][-1][0] for s in names], fan)
    out = [None] * len(rows)
    for g, s in enumerate(names):
        for i, (_, _, leaf, at) in enumerate(sorted(groups[s])):
            out[at] = (leaf, trees[s][-1][0], top[-1][0], steps(trees[s], i, fan) + steps(top, g, fan))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = [(i, f"text {i}\n" * int(rng.integers(0, 3)), "en", f"s{rng.integers(0, 9)}" if i % 3 else "hot", i) for i in range(400)]
    out += [(500, None, None, None, None), (501, "", "é", "", 0), (None, "no id", "de", "s1", 2), (None, None, None, None, None), (502, "x" * 300_000, "fr", "Ünïcode", 1), (503, "a\nb\n", "fr", "S1", 4)]
    return [*out, out[7], out[7], (7, "another text of the same id", "en", out[7][3], 1)]


@pytest.mark.parametrize(("fan", "height"), [(3, 5), (3, 1), (2, 2)])
def test_manifest(spark, rows, fan, height):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"leaf": F.lit(1), "root": F.lit("x"), "at": F.lit(2)})
    got = merkle.manifest(docs, fan=fan, height=height).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2])
    have = sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in got), key=key)
    want = sorted(((x[0], x[3], *m) for x, m in zip(rows, manifest_of(rows, fan))), key=key)
    # Repeated rows are leaves of their own; which of them is which stays open.
    assert [x[:5] for x in have] == [x[:5] for x in want]
    assert sorted(str(x) for x in have) == sorted(str(x) for x in want)
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_manifest_of_one_row_and_of_many_groups(spark):
    one = merkle.manifest(spark.createDataFrame([(1, "t", "en", "s", 1)], SCHEMA)).first()
    assert one.leaf == one.subroot == one.root == leaf_of(1, "s", "en", 1, "t") and one.proof == []
    rows = [(i, "t", "en", f"s{i}", 1) for i in range(300)]  # a tree of roots over several rounds
    got = {r.doc_id: r for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA), height=2).collect()}
    for row, want in zip(rows, manifest_of(rows)):
        assert (got[row[0]].leaf, got[row[0]].subroot, got[row[0]].root, [tuple(s) for s in got[row[0]].proof]) == want


def test_manifest_columns(spark, rows):
    docs = spark.createDataFrame(rows[:4], SCHEMA).withColumn("extra", F.col("doc_id") * 2)
    assert {(r.doc_id, r.extra) for r in merkle.manifest(docs, keep=["extra"]).collect()} == {(r[0], r[0] * 2) for r in rows[:4]}
    with pytest.raises(ValueError, match="root"):
        merkle.manifest(docs.withColumn("root", F.lit(1)), keep=["root"])


def test_manifest_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.leaf): r for r in queries.op11_merkle_manifest(spark, str(tmp_path)).collect()}
    for row, (leaf, subroot, root, _) in zip(rows, manifest_of(rows)):
        r = got[row[0], leaf]
        tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and "\n" in (row[1] or "")
        assert (r.subroot, r.root, r.verified) == (subroot, root, not tampered) and (r.folded_root == root) != tampered
    assert len({r.proof_sha256 for r in got.values()}) > 300 and sum(not r.verified for r in got.values()) > 50


def test_a_forged_proof_fails(spark, rows):
    """Every digest of a proof is needed: one changed anywhere gives another root."""
    r = next(r for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect() if r.doc_id == 9)
    fold = lambda start, proof: __import__("functools").reduce(lambda a, s: h(s[0], a, s[1]), proof, start)
    assert fold(r.leaf, r.proof) == r.root
    for i, (left, right) in enumerate(r.proof):
        if left or right:
            forged = [*r.proof[:i], (left[::-1], right[::-1]), *r.proof[i + 1 :]]
            assert fold(r.leaf, forged) != r.root


def searched(rows, asked, k, scale=256):
    sound = []
    for vec_id, v in dict.fromkeys((i, None if v is None else tuple(v)) for i, v in rows):
        if vec_id is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            sound.append((vec_id, [int(np.floor(scale * np.float64(np.float32(x)))) for x in v]))
    out = []
    for q, x in sound:
        if asked(q):
            scores = sorted((-sum(a * b for a, b in zip(x, y)), c) for c, y in sound if c != q and len(x) == len(y))
            out += [(q, rank + 1, c, -s) for rank, (s, c) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("lists", "block"), [(2, 4096), (3, 32), (1, 17)])
def test_search(spark, lists, block):
    rng = np.random.default_rng(11)
    rows = [(i, rng.standard_normal(6).round(2).tolist()) for i in range(300)]
    rows += [(300 + i, rows[10][1]) for i in range(60)]  # a vector that many rows hold
    rows += [(400 + i, [1.0 if j == i % 6 else 0.0 for j in range(6)]) for i in range(40)]  # ties
    rows += [(450, None), (451, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (452, [float("nan")] * 6), (453, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (None, rows[0][1]), (454, []), (455, []), (456, [1.0, 2.0]), (460, [3.0, -2.0]), rows[20], rows[20]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"ints": F.lit(1), "key": F.lit(2), "score": F.lit(3), "rank": F.lit(4)}).repartition(4)
    got = topk.search(vectors, vectors.filter("vec_id % 10 = 0"), k=5, lists=lists, block=block).collect()
    assert sorted(tuple(r) for r in got) == searched(rows, lambda i: i % 10 == 0, 5)
    assert topk.search(vectors.limit(0), vectors, 5).count() == 0 and topk.search(vectors, vectors.limit(0), 5).count() == 0


def test_search_of_few_and_of_large_numbers(spark):
    rows = [(0, [1e15, 1e15]), (1, [1e15, -1e15]), (2, [1e14, 3.0])]  # sums beyond doubles, ends of 64 bits
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()
    ints = {i: [int(256 * x) for x in v] for i, v in rows}
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    dot = lambda a, b: clip(sum(x * y for x, y in zip(ints[a], ints[b])))
    want = {(q, c, dot(q, c)) for q in ints for c in ints if q != c}
    assert {(r.query_id, r.vec_id, r.score) for r in got} == want


def test_the_phases_leave_out_most_and_lose_nothing():
    """The cutoff is reached by k + 1 objects at least; what phase 2 leaves out lies below it."""
    rng = np.random.default_rng(12)
    objects = np.floor(32 * rng.standard_normal((4000, 64)))
    asked = objects[:20]
    sums = asked @ objects.T
    for lists in (2, 4):
        cutoff = [int(min(best)) for best in topk.local_lists(asked, objects, 5, lists)]
        assert all((sums[i] >= c).sum() >= 6 for i, c in enumerate(cutoff))
        q, o = topk.sufficient(asked, objects, cutoff, lists)
        left = set(zip(q.tolist(), o.tolist()))
        assert {(i, j) for i, c in enumerate(cutoff) for j in np.flatnonzero(sums[i] >= c).tolist()} <= left
        if lists == 2:
            assert len(left) < 0.15 * sums.size, len(left)


def brute_runs(words, least=24, times=3):
    """Every period's maximal stretches by definition; of one stretch the smallest period."""
    found = {}
    for p in range(1, len(words) // times + 1):
        i = p
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - p]:
                j += 1
            if j - i + p >= max(least, times * p):
                found.setdefault((i - p, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


@pytest.mark.parametrize(("least", "times"), [(24, 3), (6, 2), (9, 3), (10, 4)])
def test_runs_of_words(least, times):
    """Random words of small alphabets, periodic words with exponents from 2 to 10, words of words, and the words of Fibonacci."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, k, n).tolist() for k in (1, 2, 3) for n in (5, 23, 24, 25, 60, 200)]
    for _ in range(150):
        unit = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 12))).tolist()
        middle = (unit * 12)[: int(len(unit) * rng.uniform(2, 10)) + 1]
        texts.append(rng.integers(0, 4, int(rng.integers(0, 30))).tolist() + middle + rng.integers(0, 4, int(rng.integers(0, 30))).tolist() + middle[::-1])
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    texts += [b, (b[:34] * 5 + [9]) * 4]
    seen = 0
    for words in texts:
        codes = np.array(words, np.int64)
        got = periodic.runs_of(codes, codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), least, times)
        assert got == brute_runs(words, least, times), words
        seen += len(got)
    assert seen > 100


def test_strongest_is_exact():
    assert periodic.strongest([]) is None
    assert periodic.strongest([(0, 30, 10), (50, 24, 8), (90, 31, 10)]) == (90, 31, 10)
    assert periodic.strongest([(0, 30, 10), (50, 24, 8)]) == (0, 30, 10)
    big = 10**9
    assert periodic.strongest([(0, 3 * big, big), (5, 3 * big + 4, big + 1)]) == (5, 3 * big + 4, big + 1)


def test_periodic_query(spark, tmp_path):
    rng = np.random.default_rng(21)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 300, n))
    line = word(9)
    rows = [(i, word(int(rng.integers(1, 160)))) for i in range(160)]
    rows += [(200, "\n".join([line] * 5)), (201, f"{word(20)}\t{line} {line}  {line} {line} tail"), (202, None), (203, ""), (204, " \x0b\n"), (None, f"{line} " * 4), (205, "a " * 23), (206, "a " * 24), (207, "é\xa0b " * 30), (208, word(30_000)), (209, f"{word(3000)} " * 4)]
    rows += [rows[0], rows[-11]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "strongest": F.lit("x"), "n_words": F.lit("y")})
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc, text in rows:
        words = (text or "").encode().split()
        n, c = len(words), None if doc is None else zlib.crc32(str(doc).encode())
        if c is not None and c % 10 == 0 and n:
            g = c // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        # by definition, but for the two long texts, whose periods are known
        runs = brute_runs(words) if n < 10_000 else [(0, 12_000, 3000)] if doc == 209 and words[:3000] == words[9000:] else []
        lost = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = b" ".join(w for i, w in enumerate(words) if i not in lost)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        if n < 10_000 or c % 10:
            want.append((-1 if doc is None else doc, len(runs), *best, milli, h(lines), hashlib.sha256(kept).hexdigest()))
    got = [(-1 if r[0] is None else r[0], *r[1:]) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    names = {x[0] for x in want}
    key = lambda x: (x[0], x[6], x[7])
    assert sorted((x for x in got if x[0] in names), key=key) == sorted(want, key=key) and len(got) == len(rows)
    assert sum(x[1] > 0 for x in want) >= 12
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
