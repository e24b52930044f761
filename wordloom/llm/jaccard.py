"""Exact set-similarity join of documents on word shingles, by multiple-global-order filtering.

Two documents link when den * |A and B| >= num * |A or B| over their distinct shingles. A document
whose set is equal to another's is the same node, so copies cost one node. For every node the
shingles are put in three global orders (rarest word first, by counts over all documents, and two
orders by hash). Linked sets share one of the first n - ceil(t n) + 1 shingles under each of them.
The first order deals prefix shingles out to tasks; inside a shingle's group, block by block of
bounded size, a pair survives if it passes the length and the positional bound. What connected
pairs hold together is a family: a bounded set of nodes, named by a hash of the set, so that the
many shingles of the same near copies make it once. Only sets leave the task, never pairs, and
families are not merged, as chains of chance meetings would tie all documents together. Inside a
family a pair is a candidate only if histograms of the sets allow the link (the sum of smaller
counts is at least the intersection) and if it shares a prefix shingle under each of the three
orders, whose filters are intersected one after the other. Components of candidates are verified on
whole sets, in pairs of blocks of bounded size.

Edge cases: null or blank text has an empty set, links with nothing and is its own component;
fewer words than a shingle form one shingle; repeated rows are returned as often as they come;
null ids are ignored when a component's smallest id is sought; an empty table gives no row; texts of
any length are read whole, a few megabytes of texts at a time; columns beyond doc_id and text are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, U64, connected_components, mixed, partitions, signed, slices, tidy, unite, window_hashes, word_hashes

#: Words whose counts order the shingles: the most frequent ones, so the table sent out is bounded.
RANKED_WORDS = 100_000
#: Rows of one shingle's group compared at once with as many others, and the most rows and characters of a block of texts.
GROUP_BLOCK, FAMILY_ROWS, FAMILY_CHARS = 512, 512, 6_000_000
#: Texts to verify whose keys are sent to all tasks, so that other texts are not shuffled; more are joined.
SENT = 1_000_000
#: Seeds of the second and third order.
ORDERS = (0xA0761D64, 0x51ED270B)


def frequent_words(docs: DataFrame, top: int = RANKED_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the most frequent lower-cased words of all documents, at most `top`.

    Each task counts all its words; those it met only once are left out, as they order last anyway.
    The least count that `top` words reach is read off a histogram of counts, so that the driver
    gets those words and nothing of any other.
    """
    scratch = Scratch(docs.sparkSession)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, c = (np.concatenate(x) for x in zip(*held))
            u, at = np.unique(h, return_inverse=True)
            return u, np.bincount(at, c, len(u)).astype(np.int64)

        for batch in batches:
            for part in slices(batch, text="text"):
                _, h = word_hashes(part.column(0), lower=True)
                held.append(np.unique(h, return_counts=True))
                if sum(len(x[0]) for x in held) > 2_000_000:
                    held[:] = [merged()]
                    if len(held[0][0]) > 1_000_000:
                        u, c = held.pop()
                        yield pa.RecordBatch.from_arrays([pa.array(signed(u[c > 1])), pa.array(c[c > 1])], names=["word", "n"])
        if held:
            u, c = merged()
            yield pa.RecordBatch.from_arrays([pa.array(signed(u[c > 1])), pa.array(c[c > 1])], names=["word", "n"])

    level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    counts = scratch.written(docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).withColumn("level", level))
    least, total = 1 << 30, 0
    for r in counts.groupBy("level").agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():  # a thousand rows at most
        if (total := total + r.words) > top:
            break
        least = r.level
    rows = counts.filter(F.col("level") >= least).select("word", "n").collect()
    scratch.clear()
    words, n = np.array([r[0] for r in rows], np.int64).view(U64), np.array([r[1] for r in rows], np.int64)
    order = np.argsort(words)
    return words[order], n[order]


def shingle_sets(texts: pa.Array, k: int, ranks: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """For each text its distinct shingle hashes, sorted, and each shingle's rank (the count of its rarest word)."""
    begin, h = word_hashes(texts, lower=True)
    count = None
    if ranks is not None and len(ranks[0]):
        at = np.minimum(np.searchsorted(ranks[0], h), len(ranks[0]) - 1)
        count = np.where(ranks[0][at] == h, ranks[1][at], 0)
    elif ranks is not None:
        count = np.zeros(len(h), np.int64)
    windows = window_hashes(h, k)
    rare = None
    if count is not None and len(h) >= k:
        rare = count[: len(h) - k + 1]
        for i in range(1, k):
            rare = np.minimum(rare, count[i : len(h) - k + 1 + i])
    for a, b in zip(begin[:-1], begin[1:]):
        n = b - a
        if n >= k:
            s, first = np.unique(windows[a : b - k + 1], return_index=True)
            yield s, rare[a : b - k + 1][first] if rare is not None else None
        elif n:
            yield window_hashes(h[a:b], int(n)) ^ U64(n), count[a:b].min(keepdims=True) if count is not None else None
        else:
            yield np.empty(0, U64), np.empty(0, np.int64)


def _needed(n: int, num: int, den: int) -> int:
    return -(-num * n // den)


def _first(key: np.ndarray, p: int) -> np.ndarray:
    """Places of the p least keys, in no order."""
    return np.argpartition(key, p - 1)[:p] if p < len(key) else np.arange(len(key))


def _histogram(s: np.ndarray) -> bytes:
    """Counts of the set's hashes in about one bin for eight (a power of two, so that halves fold together); 255: at least that many."""
    bins = max(32, 1 << (max(len(s) // 8, 1) - 1).bit_length())
    return np.minimum(np.bincount((s & U64(bins - 1)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def node_of(s: np.ndarray) -> tuple[int, int]:
    raw = s.tobytes()
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63), xxhash.xxh3_64_intdigest(raw, 1) - (1 << 63)


def short(prefixes: list[np.ndarray]) -> bytes:
    """Prefixes of one length as 16 bits a shingle, or 32 for long ones: what two sets share agrees; what agrees by chance is rare."""
    kind = "<u2" if len(prefixes[0]) <= 256 else "<u4"
    return b"".join((x & U64(0xFFFFFFFF)).astype(kind).tobytes() for x in prefixes)


_SIGNED = "doc_id long, text_key long, n_shingles long, n_chars long, node long, check long, prefix array<long>, orders binary, histogram binary"


def _signatures(k: int, num: int, den: int, ranks):
    """Per row its set's size and hashes; once a task and node also the prefix under the first order (in order), the prefixes
    under all orders (a few bits of each shingle, one order after the other), and a histogram."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("n_chars", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("prefix", pa.list_(pa.int64())), ("orders", pa.binary()), ("histogram", pa.binary())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # nodes whose prefixes this task has given
        for batch in batches:
            for part in slices(batch, text="text"):
                out = []
                for doc, key_, text, (s, rank) in zip(part.column("doc_id").to_pylist(), part.column("text_key").to_pylist(), part.column("text"), shingle_sets(part.column("text"), k, ranks.value)):
                    n = len(s)
                    if not n:
                        out.append((doc, key_, 0, 0, None, None, None, None, None))
                        continue
                    node = node_of(s)
                    prefix = orders = histogram = None
                    if node not in seen:
                        seen.add(node)
                        p = n - _needed(n, num, den) + 1
                        key = (rank.astype(U64) << U64(30)) | (mixed(s) >> U64(34))
                        first = _first(key, p)
                        prefix = signed(s[first[np.argsort(key[first], kind="stable")]])
                        orders = short([s[first], *(s[_first(mixed(s ^ U64(seed)), p)] for seed in ORDERS)])
                        histogram = _histogram(s)
                    out.append((doc, key_, n, len(text.as_py()), *node, prefix, orders, histogram))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return run


def _surviving(x: tuple, y: tuple, num: int, den: int) -> np.ndarray:
    """Which pairs of x's and y's rows pass the length and the positional filter."""
    (xn, xp), (yn, yp) = ([c[:, None] for c in x], [c[None, :] for c in y])
    ok = np.minimum(xn, yn) * den >= np.maximum(xn, yn) * num
    return ok & ((num + den) * np.minimum(xn - xp, yn - yp) >= num * (xn + yn))


def _sets(nodes: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, node) for the members of each component of at least two distinct nodes; a name is a hash of the set."""
    order = np.lexsort((nodes, root))
    r, v = root[order], nodes[order]
    once = np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])])
    r, v = r[once], v[once]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    size = np.diff(np.append(first, len(r)))
    name = mixed(np.add.reduceat(mixed(v.view(U64) ^ U64(0x6A09E667F3BCC909)), first) + size.astype(U64))
    use = np.repeat(size > 1, size)
    return signed(np.repeat(name, size)[use]), v[use]


def _candidates(num: int, den: int):
    """Per shingle (rows sorted by shingle, then set size): the sets of nodes that surviving pairs connect, a block with each other one."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, kept = None, []  # the open shingle's earlier blocks whose sizes may still match

        def compared(rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Compares one shingle's next rows with themselves and with the kept blocks."""
            nonlocal kept
            for at in range(0, len(rows[0]), GROUP_BLOCK):
                new = [c[at : at + GROUP_BLOCK] for c in rows]
                kept = [b for b in kept if b[1][-1] * den >= num * new[1][0]]
                for old in [*kept, new]:
                    i, j = np.nonzero(_surviving(old[1:], new[1:], num, den))
                    if len(i):
                        both = new[0] if old is new else np.concatenate([old[0], new[0]])
                        yield _sets(both, unite(len(both), i, j if old is new else j + len(old[0])))
                kept.append(new)

        for batch in batches:
            t = batch.column("token").to_numpy()
            place = batch.column("place").to_numpy()
            rows = [batch.column("node").to_numpy(), place >> 32, place & 0xFFFFFFFF]
            edges = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.empty(0, np.int64)
            sizes = np.diff(np.append(edges, len(t)))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            two = np.flatnonzero(sizes == 2)
            two = two[(two != len(edges) - 1) & ((two > 0) | (token is None))]
            if len(two):  # most groups, all at once
                x, y = ([c[edges[two] + i] for c in rows] for i in (0, 1))
                ok = (x[0] != y[0]) & (np.minimum(x[1], y[1]) * den >= np.maximum(x[1], y[1]) * num) & ((num + den) * np.minimum(x[1] - x[2], y[1] - y[2]) >= num * (x[1] + y[1]))
                if ok.any():
                    found.append(_sets(np.concatenate([x[0][ok], y[0][ok]]), np.tile(np.arange(ok.sum()), 2)))
            for g in np.flatnonzero((sizes > 2) | (np.arange(len(sizes)) == len(edges) - 1) | (np.arange(len(sizes)) == 0)).tolist():
                at, size, last = edges[g], sizes[g], g == len(edges) - 1
                if token is not None and t[at] != token:
                    token, kept = None, []
                if size <= 2 and token is None and not last:
                    continue  # seen above, or alone
                found += compared([c[at : at + size] for c in rows])
                token = t[at] if last else None
                if not last:
                    kept = []
            if found:
                name, node = (np.concatenate(x) for x in zip(*found))
                rows_ = np.unique(np.stack([name, node], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows_[:, 0])), pa.array(np.ascontiguousarray(rows_[:, 1]))], names=["block", "node"])

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices (exact: counts stay below 2**24)."""
    m = len(sets)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    shared = count[code] > 1
    use = np.cumsum(count > 1) - 1
    code, row = use[code[shared]], row[shared]
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    total = np.zeros((m, m), np.int64)
    step = max(256, min(8192, 16_000_000 // m))
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        lo, hi = np.searchsorted(code, [at, at + step])
        x = np.zeros((m, step), np.float32)
        x[row[lo:hi], code[lo:hi] - at] = 1
        total += np.rint(x @ x.T).astype(np.int64)
    return total


def _shares(lists: list[np.ndarray]) -> np.ndarray:
    """Which pairs of lists hold a common token (symmetric; the diagonal is set where a token is common with any other)."""
    m = len(lists)
    _, code, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(x) for x in lists])
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    out = np.zeros((m, m), bool)
    few = (count[code] > 1) & (count[code] <= 16)
    c, r = code[few], row[few]
    for d in range(1, 16):  # tokens of a few lists: pair by pair
        same = c[d:] == c[:-d]
        if not same.any():
            break
        out[r[:-d][same], r[d:][same]] = True
    many = count[code] > 16
    if many.any():  # the others: products of incidence matrices
        use = np.cumsum(count > 16) - 1
        c, r = use[code[many]], row[many]
        step = 4096
        for at in range(0, int(c[-1]) + 1, step):
            lo, hi = np.searchsorted(c, [at, at + step])
            x = np.zeros((m, step), np.float32)
            x[r[lo:hi], c[lo:hi] - at] = 1
            out |= x @ x.T > 0.5
    return out | out.T


def _allowed(size: np.ndarray, histograms: list[bytes], i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the pairs (i, j), whose sizes differ by less than half, the histograms allow to link."""
    bins = np.array([len(h) for h in histograms])
    least = np.minimum(bins[i], bins[j])
    ok = np.zeros(len(i), bool)
    for b in np.unique(least):
        rows = np.flatnonzero((bins == b) | (bins == 2 * b))
        folded = np.zeros((len(rows), b), np.uint8)
        for at, r in enumerate(rows):
            h = np.frombuffer(histograms[r], np.uint8).reshape(-1, b)
            folded[at] = h[0] if len(h) == 1 else np.where((h == 255).any(0), 255, np.minimum(h.sum(0, dtype=np.int64), 255))
        full = (folded == 255).any(1)
        place = np.zeros(len(bins), np.int64)
        place[rows] = np.arange(len(rows))
        on = np.flatnonzero(least == b)
        step = max(1, 16_000_000 // int(b))
        for at in range(0, len(on), step):
            p, q = place[i[on[at : at + step]]], place[j[on[at : at + step]]]
            low = np.minimum(folded[p], folded[q]).sum(1, dtype=np.int64)
            ok[on[at : at + step]] = (num + den) * low >= num * (size[rows[p]] + size[rows[q]])
            ok[on[at : at + step]] |= full[p] | full[q]
    return ok


def _similar_sizes(size: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.triu(np.minimum(size[:, None], size[None, :]) * den >= np.maximum(size[:, None], size[None, :]) * num, 1)


def _same_width(orders: list[bytes], sizes: list[int], order: int, num: int, den: int) -> list[np.ndarray]:
    """One order's prefixes, of as many bits as the shortest prefix was given."""
    out = []
    for raw, n in zip(orders, sizes):
        p = n - _needed(n, num, den) + 1
        out.append(np.frombuffer(raw, "<u2" if len(raw) == 2 * p * (1 + len(ORDERS)) else "<u4", p, order * len(raw) // (1 + len(ORDERS))))
    narrow = any(x.dtype.itemsize == 2 for x in out)
    return [(x & 0xFFFF if narrow else x).astype(U64) for x in out]


def candidate_pairs(rows: list[tuple], num: int, den: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(i, j, pairs left after the length filter and each of the three orders' prefix filters).

    rows: (node, n_shingles, prefixes under the three orders as of `short`).
    """
    ok = _similar_sizes(np.array([r[1] for r in rows]), num, den)
    left = [int(ok.sum())]
    for order in range(1 + len(ORDERS)):
        on = np.flatnonzero(ok.any(0) | ok.any(1))
        if len(on):
            ok[np.ix_(on, on)] &= _shares(_same_width([rows[x][2] for x in on], [rows[x][1] for x in on], order, num, den))
        left.append(int(ok.sum()))
    return *np.nonzero(ok), left


def _forest(rows: list[tuple], i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    root = unite(len(rows), i, j)
    return [(rows[a][0], rows[b][0]) for a, b in enumerate(root.tolist()) if a != b]


def _bounded(num: int, den: int):
    """Per family: the smaller families (name, node) that pairs whose histograms allow a link hold together."""

    def check(rows: list[tuple]) -> list[tuple[int, int]]:
        size = np.array([r[1] for r in rows])
        i, j = np.nonzero(_similar_sizes(size, num, den))
        may = _allowed(size, [r[2] for r in rows], i, j, num, den)
        name, node = _sets(np.array([r[0] for r in rows], np.int64), unite(len(rows), i[may], j[may]))
        return list(zip(name.tolist(), node.tolist()))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _per_block(batches, ("node", "n_shingles", "histogram"), check, ("block", "node"))

    return run


def _ordered(num: int, den: int):
    """Per family: star edges of the forest of its candidate pairs."""

    def check(rows: list[tuple]) -> list[tuple[int, int]]:
        i, j, _ = candidate_pairs(rows, num, den)
        return _forest(rows, i, j)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _per_block(batches, ("node", "n_shingles", "orders"), check)

    return run


def _per_block(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], check, out_names: tuple[str, str] = ("a", "b")) -> Iterator[pa.RecordBatch]:
    """check(rows) for the rows (one a node, which comes first) of each block of at least two."""
    key, held = None, {}
    for batch in batches:
        out = []
        for k, *row in zip(*(batch.column(c) for c in ("block", *names))):
            if (k := k.as_py()) != key:
                out += check(list(held.values())) if len(held) > 1 else []
                key, held = k, {}
            if (node := row[0].as_py()) not in held:
                held[node] = (node, *(x.as_py() for x in row[1:]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=list(out_names))
    if len(held) > 1 and (out := check(list(held.values()))):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=list(out_names))


def _in_blocks(members: DataFrame, weight: str, most: int) -> DataFrame:
    """members (family, node, ...) once for each pair of blocks that its own block is in: column block."""
    blocks = members.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / FAMILY_ROWS), F.ceil(F.sum(weight) / most)).cast("int").alias("blocks"))
    placed = members.join(blocks, "family").withColumn("own", F.pmod(F.hash("node"), "blocks"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.withColumn("block", F.xxhash64("family", F.least("own", "other"), F.greatest("own", "other"))).drop("own", "other", "blocks")


def _links(k: int, num: int, den: int):
    """Per block pair of a family: star edges of its verified links' spanning forest."""

    def verify(rows: list[tuple]) -> list[tuple[int, int]]:
        sets = [s for s, _ in shingle_sets(pa.array([r[1] for r in rows], pa.large_string()), k)]
        size = np.array([len(s) for s in sets])
        both = _overlaps(sets)
        i, j = np.nonzero(np.triu(den * both >= num * (size[:, None] + size[None, :] - both), 1))
        return _forest(rows, i, j)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _per_block(batches, ("node", "text"), verify)

    return run


def _nodes(signed_: DataFrame) -> DataFrame:
    """node, one (its first document: without id last, id, text_key), n_chars, and the least and greatest second hash of its sets."""
    one = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key"))
    return signed_.filter("n_shingles > 0").groupBy("node").agg(one.alias("one"), F.max("n_chars").alias("n_chars"), F.min("check").alias("lo"), F.max("check").alias("hi"))


def similar(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, root (the component's name, null for empty sets), text_key (xxhash64 of the text) for every row of docs; links at num/den of Jaccard similarity."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    ranks = spark.sparkContext.broadcast(frequent_words(docs))
    signed_ = scratch.written(docs.mapInArrow(_signatures(shingle, num, den, ranks), _SIGNED), keep=True)
    nodes = _nodes(signed_)
    while (clash := nodes.filter("lo <> hi").select("node")).limit(1).count():
        # Different sets under one 64-bit name: both hashes name them anew.
        named = signed_.join(clash.withColumn("anew", F.lit(True)), "node", "left").withColumn("node", F.when(F.col("anew"), F.xxhash64("node", "check")).otherwise(F.col("node")))
        signed_ = scratch.written(named.select(*signed_.columns), keep=True)
        nodes = _nodes(signed_)
    parts = partitions(docs)
    given = signed_.filter("prefix is not null")
    tokens = given.select("node", "n_shingles", F.posexplode("prefix").alias("pos", "token"))
    tokens = tokens.select("token", "node", (F.shiftleft("n_shingles", 32) + F.col("pos")).alias("place"))
    tokens = tokens.repartition(parts, "token").sortWithinPartitions("token", "place", "node")
    families = scratch.written(tokens.mapInArrow(_candidates(num, den), "block long, node long").distinct())
    for step, sketch, made in ((_bounded, "histogram", "block long, node long"), (_ordered, "orders", "a long, b long")):  # the small sketch first
        sketches = given.select("node", "n_shingles", sketch).dropDuplicates(["node"])
        sketched = families.join(sketches, "node").select("block", "node", "n_shingles", sketch)
        sketched = sketched.repartition(parts, "block").sortWithinPartitions("block", "node").mapInArrow(step(num, den), made)
        families = scratch.written(sketched.distinct())
    family = connected_components(families)
    members = _in_blocks(family.join(nodes, "node").select("node", F.col("component").alias("family"), "one", "n_chars"), "n_chars", FAMILY_CHARS)
    members = scratch.written(members.select(F.col("one.doc_id").alias("doc_id"), F.col("one.text_key").alias("text_key"), "node", "block"))
    named = docs.filter("text is not null")
    keys = members.select("text_key").distinct()
    if keys.count() <= SENT:
        named = named.join(F.broadcast(keys), "text_key", "left_semi")
    same = members["doc_id"].eqNullSafe(named["doc_id"]) & (members["text_key"] == named["text_key"])
    texts = members.join(named, same).select("block", "node", "text")
    texts = texts.repartition(parts, "block").sortWithinPartitions("block", "node")
    links = connected_components(texts.mapInArrow(_links(shingle, num, den), "a long, b long"))
    root = nodes.select("node", "one.doc_id").join(links, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("root"))
    least = root.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = scratch.written(root.join(least, "root").select("node", "component_id", "root"), keep=True)
    scratch.clear()
    out = signed_.select("doc_id", "text_key", "n_shingles", "node").join(of_node, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "root", "text_key")
