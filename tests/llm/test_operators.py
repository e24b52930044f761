"""Each operator against a brute-force version on small texts with nulls, blanks, ties and repeated rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom.llm import common, decontaminate, embedding_dedup, jaccard, kneser_ney, language_id, packing, substring_dedup, url_filter, warc
from wordloom.llm.queries import RULES, tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    passage, base = text(70), text(200)
    near = base.split()
    found = [base, base, " ".join(near[:100] + ["changed"] + near[101:]), passage + " " + text(60), text(30) + "\n" + passage, text(40), None, "", "  \t ", "one two", "One  two", text(5000)]
    found += [text(int(n)) for n in rng.integers(1, 120, 20)]
    out = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(found)]
    return out + [out[5], (None, "no id here", None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_jaccard(docs, rows, none, k, num):
    def shingles(t):
        w = [x.lower() for x in words(t)]
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = [shingles(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    root = components(len(rows), links)
    least = {}
    for r, c in zip(rows, root):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = sorted((r[0] if r[0] is not None else -1, len(s), least.get(c, -1)) for r, s, c in zip(rows, sets, root))
    got = jaccard.similar(docs, k, num).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got) == want
    assert jaccard.similar(none, k, num).count() == 0


def test_jaccard_large_groups_are_exact(spark):
    """More members than a block, with links at the threshold, against all pairs."""
    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(40)]
    texts = []
    for i in range(700):
        w = list(base)
        for at in rng.choice(40, rng.integers(0, 4), replace=False):
            w[at] = f"x{rng.integers(0, 5)}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(38)} for t in texts]
    links = [(i, j) for i in range(700) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    want = components(700, links)
    got = {r.doc_id: r.component_id for r in jaccard.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 90).collect()}
    assert [got[i] for i in range(700)] == want


def test_jaccard_orders_intersect():
    """The three orders' real prefixes dismiss pairs one after the other, and never a linked one."""
    rng = np.random.default_rng(2)
    rows, sets = [], []
    for i in range(240):
        words = rng.choice(40_000, 150, replace=False).tolist() if i % 3 or not i else sorted(sets[-1])[:145] + rng.choice(40_000, 5).tolist()
        sets.append(set(words))
        s = np.unique(common.mixed(np.array(sorted(set(words)), np.uint64)))
        n = len(s)
        p = n - jaccard._needed(n, 80, 100) + 1
        orders = jaccard.short([s[jaccard._first(common.mixed(s ^ np.uint64(seed)), p)] for seed in (1, *jaccard.ORDERS)])
        rows.append((i, n, orders))
    linked = {(i, j) for j in range(240) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    i, j, left = jaccard.candidate_pairs(rows, 80, 100)
    found = set(zip(i.tolist(), j.tolist()))
    assert linked <= found and len(linked) >= 70 and left == sorted(left, reverse=True) and left[-1] == len(found)
    assert left[1] < left[0] / 5 and left[2] < left[1] / 2 and left[3] < left[2], left


def removed(rows, size=50):
    first = {}
    for doc, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - size + 1) if doc is not None else ():
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text, *_ in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - size + 1) if doc is not None else ():
            if first[tuple(w[i : i + size])] < doc:
                gone.update(range(i, i + size))
        out.append((-1 if doc is None else doc, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 4])
def test_substring_dedup(docs, rows, none, batches):
    got = substring_dedup.deduplicate(docs, batches=batches).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == removed(rows)
    if batches == 1:
        assert substring_dedup.deduplicate(none).count() == 0


def test_substring_index_goes_on_in_another_session(spark, rows, tmp_path):
    """Seven batches, the index closed and opened again between them: compaction happens, results are those of brute force."""
    named = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    last = named[-1][0] + 1
    named += [(last + i, rows[i % 2 * 3][1], "en", "s", 1) for i in range(14)]  # whole copies in every later batch
    table = lambda s, x: s.createDataFrame(x, SCHEMA)
    last = max(r[0] for r in named) + 1
    got, path = [], str(tmp_path / "index")
    index = substring_dedup.FingerprintIndex(spark, path, fan_in=2)
    for n in range(7):
        lo, hi = last * n // 7, last * (n + 1) // 7
        if n == 3:
            index.close()
            assert not any(t.name.startswith("fingerprints_") for t in spark.catalog.listTables())
            index = substring_dedup.FingerprintIndex.open(spark.newSession(), path)
        s = index.spark
        got += index.ingest(table(s, [r for r in named if lo <= r[0] < hi]), table(s, [r for r in named if r[0] < hi])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed(named)
    assert index.compactions >= 4 and len(index.runs["fp"]) <= 4
    index.drop()
    assert not (tmp_path / "index").exists()


def test_windows_of_a_hot_passage(spark):
    """One window in most rows is compared by broadcast; the others by their key."""
    rows = [(7, 1, d, d % 3) for d in range(400)] + [(7, 2, 5, 9), (8, 1, 3, 0), (8, 1, 4, 1), (8, 1, 3, 2), (9, 1, 2, 0), (9, 1, 2, 1)] + [(100 + i, 0, i, 0) for i in range(50)]
    scratch = common.Scratch(spark)
    windows = scratch.written(spark.createDataFrame(rows, substring_dedup._WINDOWS))
    got = sorted(tuple(r) for r in substring_dedup.repeated_windows(windows, scratch).collect())
    assert got == sorted([(d, d % 3) for d in range(1, 400)] + [(4, 1)])


def test_packing_round_trip(docs, rows, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    ids = [tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows]
    got = packing.pack(docs, tokenizer_file(), window=256).collect()
    assert sum(r.length for r in got) == sum(map(len, ids))
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert parts[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(parts, parts[1:])) and parts[-1].offset + parts[-1].length <= 256
    assert len(by_sequence) <= math.ceil(sum(map(len, ids)) / 256) + 2
    crc = lambda part: zlib.crc32(np.array(part, "<u4").tobytes())
    want = Counter((-1 if r[0] is None else r[0], s, len(x[s : s + 256]), crc(x[s : s + 256]), len(x)) for r, x in zip(rows, ids) for s in range(0, len(x), 256))
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    assert packing.pack(none, tokenizer_file()).count() == 0


def test_matrices_round_trip(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    pieces = {}
    for r in packing.matrices(docs, tokenizer_file(), window=256).collect():
        ids, places = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert places[a:b].tolist() == list(range(b - a))
            pieces.setdefault(doc, {})[start] = ids[a:b].tolist()
    for doc, text, *_ in rows:
        if doc is not None:
            assert sum((pieces[doc][s] for s in sorted(pieces[doc])), []) == tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_tightest_window_against_a_scan():
    rng = np.random.default_rng(3)
    store, held = packing.TightestWindow(64), []
    for i in range(2000):
        if rng.random() < 0.5:
            capacity = int(rng.integers(1, 64))
            store.put(i, capacity)
            held.append(capacity)
        else:
            length = int(rng.integers(1, 65))
            fits = [c for c in held if c >= length]
            got = store.take(length)
            assert (got[1] if got else None) == (min(fits) if fits else None)
            if fits:
                held.remove(min(fits))


def test_chunk_tokenizer_equals_library():
    from tokenizers import Tokenizer

    texts = ["Don't stop, it's 12345 o'clock", "ΑΣ ΣΑΣ ΐ", "a  b", "e\u0301 é ﬁ İ", "<|endoftext|> x<|startoftext|>", "日本語 テスト", "\u00a0nbsp\u3000wide", "🙂🙂 ok", "%%%*** !!", ""]
    plain, own = Tokenizer.from_file(tokenizer_file()), packing.ChunkTokenizer(tokenizer_file(), limit=3)
    for _ in range(2):
        begin, ids = own.encode(pa.array([*texts, None]))
        assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts] + [[]]


def test_language_id(spark, none):
    rng = np.random.default_rng(2)
    parts = {"aa": ["ka", "ko", "ki"], "bb": ["ze", "zu", "xa"], "cc": ["ün", "öl", "är"]}
    say = lambda k: " ".join("".join(rng.choice(parts[k], 3)) for _ in range(20))
    data = [(i, say(k), k, "s", 0) for i, k in enumerate(list(parts) * 40)]
    data += [(900, None, "aa", None, None), (901, "12 %%", "aa", None, None), (902, "", None, None, None), (903, "kakoki " * 30_000, "aa", "s", 1)]
    d = spark.createDataFrame(data, SCHEMA)
    model = language_id.fit(d.filter(common.learns("doc_id", 3, 1)), 20, 6)
    got = {r.doc_id: r for r in language_id.predict(d.withColumn("score", F.lit("own")), model).collect()}
    held = [i for i, *_ in data if zlib.crc32(str(i).encode()) % 3 == 1 and i < 900]
    assert held and all(got[i].lang_pred == data[i][2] for i in held) and got[903].lang_pred == "aa"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and all(0 <= r.score <= 1 for r in got.values())
    empty = language_id.fit(none)
    assert {r.lang_pred for r in language_id.predict(d, empty).collect()} == {"und"}


def test_presence_kernel_is_the_string_kernel():
    a, b = "abca", "bcab!"
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    x, has = language_id.presence([a, "bcab", None, "!"])
    assert has.tolist() == [True, True, False, False]
    assert (x[0] & x[1]).sum() >= len(grams(a) & grams("bcab")) and b


def test_kneser_ney_sums_to_one(spark):
    texts = ["a b c a b d", "a b c", "b c a x", "", "a a a b c e f", "Q a b c", None]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    vocabulary = sorted({w for t in texts for w in (t or "").lower().split()}) + ["unknown"]
    for order in (1, 2, 3):
        model = kneser_ney.train(train, order)
        assert (model.words.total, model.words.distinct) == (sum(len(words(t)) + 1 for t in texts), len(vocabulary))

        def p(history, word=None):
            t = pa.array([" ".join([*history, word] if word else history)])
            grams, _ = kneser_ney._sequences(*common.word_hashes(t, lower=True), order)
            g = grams[-2:-1] if word else grams[-1:]
            out = 1 / (model.words.distinct + 1)
            for k in range(1, order + 1):
                part = g[:, order - k :]
                c = kneser_ney.context_hash(part)
                n, s, d = model.levels[k - 1].counts(c, part[:, -1])[0], model.levels[k - 1].contexts(c)[0], model.levels[k - 1].discount
                out = max(n - d[min(n, 3)], 0) / s[0] + s[1:] @ d[1:] / s[0] * out if s[0] else out
            return out

        for history in ([], ["a"], ["a", "b"], ["unknown"], ["x"]):
            assert math.isclose(sum(p(history, w) for w in vocabulary) + p(history), 1, rel_tol=1e-9)
        got = kneser_ney.score(train, model, "text").collect()
        for r in got:
            w = (r.text or "").lower().split()
            assert r.n_tokens == len(w) + 1 == r.n_known
            assert math.isclose(r.score, sum(math.log10(p(w[:i], w[i])) for i in range(len(w))) + math.log10(p(w)), rel_tol=1e-9)
            count = Counter(x for t in texts for x in [*(t or "").lower().split(), None])
            n, v = sum(count.values()), len(count)
            assert math.isclose(r.base_score, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, None]), rel_tol=1e-9)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16))
    v = np.concatenate([centres, centres[:10] + 0.1 * rng.standard_normal((10, 16)), np.repeat(centres[:1], 5, 0), centres[3:4] + 0.05 * rng.standard_normal((60, 16))]).astype(np.float32)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [None] * 16, 1), (204, [], 1), (205, [1.0, 2.0], 1), (None, v[0].tolist(), 1), (206, (3 * v[0]).tolist(), None)]
    sound = [i for i, r in enumerate(rows) if r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(rows[i][1]) for i in sound}
    links = [(i, j) for i in sound for j in sound if j < i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    root = components(len(rows), links)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    n = Counter(x for pair in links for x in pair)
    want = {r[0]: (n[i], least[root[i]]) for i, r in enumerate(rows) if r[0] is not None}
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(got) == len(rows) and {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == want
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embedding_blocks(spark, monkeypatch):
    """A group of near copies larger than a block: every link is counted once."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(9)
    v = (rng.standard_normal((1, 8)) + 0.02 * rng.standard_normal((100, 8))).astype(np.float32)
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(99, 0)}


def test_decontaminate(spark, docs, rows, none, monkeypatch):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]
    base = words(rows[0][1])
    items = [(1, b" ".join(base[20:45]).decode()), (2, "one two"), (10, b" ".join(base[30:38]).decode()), (3, None), (4, "nowhere to be found"), (1, b" ".join(base[20:45]).decode()), (5, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for doc, text, *_ in rows:
        w, hit, found = split(text), set(), set()
        for item, t in items:
            x = split(t)
            size = min(10, len(x))
            for i in range(len(x) - size + 1) if x else ():
                for j in range(len(w) - size + 1):
                    if w[j : j + size] == x[i : i + size]:
                        hit.update(range(j, j + size))
                        found.add(str(item))
        want.append((-1 if doc is None else doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    for block in (decontaminate.BLOCK_WINDOWS, 8):
        got = decontaminate.contaminated(docs, bench, block=block).drop("hit_words").collect()
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted(want)
    assert decontaminate.contaminated(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contaminated(none, bench).count() == 0


def test_url_filter(spark):
    urls = ["http://a.Example.org/es/x?y", "https://example.org/en/12", "http://example.org", "x://sub.com/de/1#f", "http://com/fr/", "ftp://notexample.org/es/", "no scheme", None, "", "http://example.net/de/", "http://a.b.com/frx", "http://evilexample.org/es/q"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")

    def judged(url):
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [(len(h + p), len(p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *max(fits)[2:]) if fits else (host, path, None, "allow")

    assert {r.page_id: tuple(r)[1:] for r in url_filter.judge(pages, RULES).collect()} == {i: judged(u) for i, u in enumerate(urls)}
    assert {r.verdict for r in url_filter.judge(pages, [], "block").collect()} == {"block"}


def test_cascade_is_exact(spark):
    """Tight filters with many false positives: membership is exact over the whole universe."""
    universe = spark.range(4000).select(F.col("id").cast("string").alias("key"))
    listed = universe.filter("key % 7 = 0")
    cascade = url_filter.Cascade(listed, universe)
    assert len(cascade.levels) > 2
    assert universe.filter(cascade.has(F.col("key")) != (F.col("key").cast("int") % 7 == 0)).count() == 0


def test_warc(spark, tmp_path):
    html = '<html lang="en"><head><title>A &amp; B</title><style>x</style></head><body><p>One<br>two <b>three</b></p><!-- no --><script>if (a<b) {}</script><a class="k" href="/x">link</a></body></html>'
    pages = spark.createDataFrame([(1, "http://a/", html), (2, None, None), (3, "http://b/", "")], "page_id long, url string, html string")
    source = warc.responses(pages)
    got = {(r.page_id, r.type): r for r in warc.derive(source).collect()}
    assert len(got) == 6
    one, meta = got[1, "conversion"], got[1, "metadata"]
    assert one.block == "A & B\nOne\ntwo three\nlink" and "title: A & B\r\nlanguage: en" in meta.block and "outlink: /x" in meta.block
    assert one.refers_to == meta.refers_to == source.filter("page_id = 1").first().record_id and meta.concurrent_to == one.record_id
    assert one.block_digest == "sha256:" + hashlib.sha256(one.block.encode()).hexdigest() and one.source_payload_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    assert got[2, "conversion"].block == "" and got[2, "conversion"].target_uri is None and one.content_length == len(one.block.encode())
    record = warc.derive(source).filter("page_id = 1 and type = 'conversion'").select(warc.serialised().alias("b")).first().b
    fields, block = next(warc._records(bytes(record)))
    assert fields["warc-refers-to"] == one.refers_to and block.decode() == one.block
    assert fields["warc-source-payload-digest"] == one.source_payload_digest and fields["warc-source-header"] == one.source_headers.split("\r\n")[-1]
    assert bytes(record).decode().count("WARC-Source-Header: ") == 3
    raw = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Target-URI: http://a/\r\nContent-Length: {len(html) + 19}\r\n\r\nHTTP/1.1 200 OK\r\n\r\n{html}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(raw.encode())
    read = warc.read_warc(spark, str(tmp_path / "a.warc")).collect()
    assert [(r.record_id, r.payload) for r in read] == [("<urn:x>", html)]


def test_connected_components(spark):
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    names = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(names)}
    root = components(len(names), [(at[a], at[b]) for a, b in pairs])
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: names[root[i]] for i, x in enumerate(names)}


def test_arrow_batches_are_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 200_000) for i in range(4)], "doc_id long, text string").coalesce(1)
    common.small_batches(spark)

    def largest(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows]})

    assert {r.rows for r in docs.mapInArrow(largest, "rows long").collect()} <= {1, 2, 3, 4}
    small = docs.selectExpr("doc_id", "left(text, 400000) text").crossJoin(spark.range(20).withColumnRenamed("id", "n"))
    seen = [r.rows for r in small.mapInArrow(largest, "rows long").collect()]
    assert sum(seen) == 80 and max(seen) <= 12
