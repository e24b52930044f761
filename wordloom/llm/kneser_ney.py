"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped by workers.

Counting: each task counts the n-grams of its training texts and gives them in blobs by shard of
their context; a shard's task merges its blobs and writes the distinct n-grams as sorted arrays of
64-bit hashes, with their counts, into one file of the shared folder. The number of shards follows
the bytes of the texts, so a shard's size doesn't. Contexts that are too frequent for one shard are
dealt out by the word as well (every task names those that have a notable share of what it counted,
and no context can be frequent without being so in some task); only their totals, at most eight a
shard, are summed on the driver. Each distinct n-gram adds one to the continuation count of its
suffix, from which the lower orders follow in the same way down to single words. The driver holds
only file names, sums of counts of counts, and frequent contexts.

Scoring: workers map the files (one in a store that cannot be mapped is copied, mapped and
unlinked) and look up each batch's distinct n-grams in sorted order.

Probability of w after context h: max(c(hw) - D(c), 0) / c(h) + gamma(h) P(w | shorter h), with
discounts D1, D2, D3+ from counts of counts, down to single words, which are interpolated with the
uniform distribution over the vocabulary and one unknown word. A context that was never seen
leaves the shorter one's probability as it is.

Edge cases: null and blank texts are a sequence of just the end token; with nothing to learn from
every token has the uniform probability of the unknown word; repeated rows count and score as often
as they occur; a null id is learnt from or held out like the empty id; texts of any length are read
whole, a few megabytes of texts at a time; an empty table scores to an empty one.
"""

from __future__ import annotations

import json
import math
import shutil
import tempfile
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, U64, filesystem, mixed, shared_dir, slices, small_batches, tidy, word_hashes

BEGIN, END = U64(0x6265676E), U64(0x656E6421)
#: n-grams a task holds before it gives them away, and bytes of text a shard is made of.
HELD, SHARD_BYTES = 1_500_000, 12_000_000
#: Files that a worker keeps mapped.
MAPPED = 10_000
#: Order 3 was stopped by the disk limit: see the README.
ORDER = 2


def _sequences(begin: np.ndarray, h: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as a matrix of `order` columns in order of tokens, tokens of each text): BEGIN is padding, each text ends with END."""
    n, pad = len(begin) - 1, order - 1
    count = np.diff(begin)
    length = count + pad + 1
    stop = np.cumsum(length)
    seq = np.full(int(stop[-1]) if n else 0, END, U64)
    doc = np.repeat(np.arange(n), count)
    seq[np.arange(len(h)) - begin[doc] + (stop - length)[doc] + pad] = h
    for i in range(pad):
        seq[stop - length + i] = BEGIN
    ends = np.repeat(stop, length)
    start = np.flatnonzero(np.arange(len(seq)) + order <= ends)
    return np.stack([seq[start + i] for i in range(order)], 1), count + 1


def context_hash(grams: np.ndarray) -> np.ndarray:
    """Hash of all columns but the last (0 for single words)."""
    h = np.zeros(len(grams), U64)
    for i in range(grams.shape[1] - 1):
        h = mixed(h * U64(0x9E3779B97F4A7C15) + grams[:, i])
    return h


def gram_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(context * U64(0xC2B2AE3D27D4EB4F) + word)


def _route(context: np.ndarray, word: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """What decides an n-gram's shard: its context; context and word where the context is hot or empty."""
    spread = context == 0
    if len(hot):
        spread |= np.isin(context, hot)
    return mixed(np.where(spread, gram_hash(context, word), context) + U64(77)) >> U64(32)


def shard_of(context: np.ndarray, word: np.ndarray, shards: int, hot: np.ndarray) -> np.ndarray:
    return ((_route(context, word, hot) * U64(shards)) >> U64(32)).astype(np.int64)


def _planes(column: np.ndarray) -> bytes:
    """The column's bytes, all first ones before all second ones and so on, which compress better."""
    return np.ascontiguousarray(column.view(np.uint8).reshape(len(column), -1).T).tobytes()


def _packed(grams: np.ndarray, count: np.ndarray) -> bytes:
    raw = b"".join([*(_planes(np.ascontiguousarray(grams[:, i])) for i in range(grams.shape[1])), _planes(count.astype("<u4"))])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpacked(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // (8 * width + 4)
    column = lambda at, size, kind: np.ascontiguousarray(raw[at : at + size * n].reshape(size, n).T).view(kind).reshape(n)
    return np.stack([column(8 * n * i, 8, U64) for i in range(width)], 1), column(8 * n * width, 4, "<u4").astype(np.int64)


def _summed(order: np.ndarray, key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the distinct keys' first rows, summed counts), for an order that brings equal keys together."""
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return order[first], np.add.reduceat(count[order], first)


def _row(shard: int, blob: bytes | None, note: str = "", context: int | None = None, n: int | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int32()), pa.array([blob], pa.binary()), pa.array([note]), pa.array([context], pa.int64()), pa.array([n], pa.int64())], names=["shard", "blob", "note", "context", "n"]
    )


def _by_shard(grams: np.ndarray, count: np.ndarray, shards: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    context = context_hash(grams)
    key = gram_hash(context, grams[:, -1])
    route = _route(context, grams[:, -1], hot)
    at, count = _summed(np.argsort((route << U64(32)) | (key >> U64(32))), key, count)
    shard = ((route[at] * U64(shards)) >> U64(32)).astype(np.int64)  # in order, as it grows with the route
    edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    for lo, hi in zip(edges, [*edges[1:], len(at)]):
        yield _row(int(shard[lo]), _packed(grams[at[lo:hi]], count[lo:hi]))


_ROWS = "shard int, blob binary, note string, context long, n long"


def _count(order: int, shards: int, hot: np.ndarray, contexts: int = 0):
    """The texts' n-grams in blobs by shard; with `contexts`, also the frequent contexts of that many words more (context, n)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def given() -> Iterator[pa.RecordBatch]:
            grams = np.concatenate(held)
            yield from _by_shard(grams[:, contexts:], np.ones(len(grams), np.int64), shards, hot)
            if contexts:
                found, n = np.unique(context_hash(grams), return_counts=True)
                for c in np.flatnonzero(n * (8 * shards) >= len(grams)):
                    yield _row(-1, None, "", int(found[c].view(np.int64)), int(n[c]))

        for batch in batches:
            for part in slices(batch, text="text"):
                grams, _ = _sequences(*word_hashes(part.column(0), lower=True), order + contexts)
                held.append(grams)
                size += len(grams)
                if size > HELD:
                    yield from given()
                    held, size = [], 0
        if size:
            yield from given()

    return run


@dataclass
class Part:
    """One shard's file: n-gram keys, contexts, counts beyond a byte, their contexts' totals; then counts and totals as bytes."""

    name: str
    grams: int
    contexts: int
    large: int
    heavy: int

    def views(self, raw: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, kind, n in (("key", U64, self.grams), ("context", U64, self.contexts), ("large", U64, 2 * self.large), ("heavy", U64, 5 * self.heavy), ("count", np.uint8, self.grams), ("stats", np.uint8, 4 * self.contexts)):
            size = n * np.dtype(kind).itemsize
            out[name] = raw[at : at + size].view(kind)
            at += size
        out["large"], out["heavy"], out["stats"] = out["large"].reshape(2, -1), out["heavy"].reshape(-1, 5), out["stats"].reshape(-1, 4)
        return out


def _save(uri: str, name: str, arrays: list[np.ndarray]) -> None:
    fs, path = filesystem(uri)
    with fs.open_output_stream(f"{path}/{name}") as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())


def _mapped(uri: str, name: str) -> np.ndarray:
    fs, path = filesystem(uri)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", np.uint8, "r") if os.path.getsize(f"{path}/{name}") else np.empty(0, np.uint8)
    with tempfile.NamedTemporaryFile() as copy, fs.open_input_stream(f"{path}/{name}") as f:
        shutil.copyfileobj(f, copy)
        copy.flush()
        return np.memmap(copy.name, np.uint8, "r") if copy.tell() else np.empty(0, np.uint8)


def _merge(width: int, shards: int, hot: np.ndarray, uri: str, suffixes: bool):
    """Merges each shard's blobs, writes its file, notes what it wrote, and gives its n-grams' suffixes in blobs."""

    def finish(shard: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        grams, count = (np.concatenate(x) for x in zip(*(_unpacked(b, width) for b in blobs)))
        blobs.clear()
        context = context_hash(grams)
        key = gram_hash(context, grams[:, -1])
        at, count = _summed(np.argsort(key), key, count)
        grams, context, key = grams[at], context[at], key[at]
        by = np.argsort(context)
        c, n = context[by], count[by]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        stats = np.stack([np.add.reduceat(x, first) for x in (n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n >= 3).astype(np.int64))], 1)
        own = c[first]
        spread = np.isin(own, hot) | (own == 0)
        heads = [[h, *row] for h, row in zip(own[spread].tolist(), stats[spread].tolist())]
        own, stats = own[~spread], stats[~spread]
        small, few = np.minimum(count, 255).astype(np.uint8), np.minimum(stats, 255).astype(np.uint8)
        large, heavy = small == 255, (few == 255).any(1)
        name = uuid.uuid4().hex
        wide = np.concatenate([own[heavy][:, None], stats[heavy].astype(U64)], 1)
        _save(uri, name, [key, own, key[large], count[large].astype(U64), wide, small, few])
        of = [int((count == i).sum()) for i in range(1, 5)]
        note = json.dumps([shard, [name, len(key), len(own), int(large.sum()), int(heavy.sum())], of, int(count.sum()), len(count), heads])
        yield _row(shard, None, note)
        if suffixes:
            yield from _by_shard(grams[:, 1:], np.ones(len(grams), np.int64), shards, np.empty(0, U64))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, blobs = None, []
        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist()):
                if shard != open_:
                    if blobs:
                        yield from finish(open_, blobs)
                    open_, blobs = shard, []
                blobs.append(blob)
        if blobs:
            yield from finish(open_, blobs)

    return run


class Level:
    """One order's files, as the driver knows them and as a worker maps them."""

    def __init__(self, notes: list[list], uri: str, shards: int, hot: np.ndarray):
        self.uri, self.shards, self.hot = uri, shards, hot
        self.files = {n[0]: Part(*n[1]) for n in notes}
        of = np.sum([n[2] for n in notes], axis=0) if notes else np.zeros(4)
        self.total, self.distinct = sum(n[3] for n in notes), sum(n[4] for n in notes)
        heads: dict[int, np.ndarray] = {}
        for n in notes:
            for h, *row in n[5]:
                heads[h] = heads.get(h, 0) + np.array(row)
        self.heads = (np.array(sorted(heads), U64), np.array([heads[h] for h in sorted(heads)], np.int64).reshape(-1, 4))
        n1, n2, n3, n4 = (float(max(x, 0)) for x in of)
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        ratio = lambda a, b: a / b if b else 0.0
        d = [1 - 2 * y * ratio(n2, n1), 2 - 3 * y * ratio(n3, n2), 3 - 4 * y * ratio(n4, n3)]
        self.discount = np.array([0.0] + [float(np.clip(x, 0.05, i + 0.95)) for i, x in enumerate(d)])
        self.maps: dict[int, dict[str, np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"maps": {}}

    def _parts(self, shard: np.ndarray, key: np.ndarray) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
        """(views of a shard's file, places of its keys in sorted order) for each shard that has a file."""
        order = np.lexsort((key, shard))
        sorted_ = shard[order]
        edges = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(order) else np.empty(0, np.int64)
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(order)]):
            s = int(sorted_[lo])
            if s not in self.files:
                continue
            if s not in self.maps:
                if len(self.maps) >= MAPPED:
                    self.maps.clear()
                self.maps[s] = self.files[s].views(_mapped(self.uri, self.files[s].name))
            yield self.maps[s], order[lo:hi]

    def counts(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The counts of n-grams (0: none)."""
        key = gram_hash(context, word)
        out = np.zeros(len(key), np.int64)
        for part, at in self._parts(shard_of(context, word, self.shards, self.hot), key):
            keys = part["key"]
            i = np.minimum(np.searchsorted(keys, key[at]), len(keys) - 1)
            n = np.where(keys[i] == key[at], part["count"][i], 0).astype(np.int64)
            big = n == 255
            if big.any():
                n[big] = part["large"][1][np.searchsorted(part["large"][0], key[at][big])].astype(np.int64)
            out[at] = n
        return out

    def contexts(self, context: np.ndarray) -> np.ndarray:
        """(total, counts of 1, 2, 3+) of contexts; zeros where unseen."""
        out = np.zeros((len(context), 4), np.int64)
        for part, at in self._parts(shard_of(context, context, self.shards, np.empty(0, U64)), context):
            keys = part["context"]
            if len(keys):
                i = np.minimum(np.searchsorted(keys, context[at]), len(keys) - 1)
                found = keys[i] == context[at]
                n = part["stats"][i[found]].astype(np.int64)
                big = (n == 255).any(1)
                if big.any():
                    wide = part["heavy"]
                    n[big] = wide[np.searchsorted(np.ascontiguousarray(wide[:, 0]), context[at[found]][big]), 1:].astype(np.int64)
                out[at[found]] = n
        names, rows = self.heads
        if len(names):
            i = np.minimum(np.searchsorted(names, context), len(names) - 1)
            out = np.where((names[i] == context)[:, None], rows[i], out)
        return out


class Model:
    """The levels of an interpolated modified Kneser-Ney model, and the raw counts of single words."""

    def __init__(self, levels: list[Level], words: Level):
        self.levels, self.words = levels, words

    def score(self, texts: pa.Array) -> list[tuple[int, int, float, float]]:
        """(tokens, known tokens, base score, score) of each text, in log10."""
        order = len(self.levels)
        grams, tokens = _sequences(*word_hashes(texts, lower=True), order)
        word, of_word = np.unique(grams[:, -1], return_inverse=True)
        none = np.zeros(len(word), U64)
        c = self.words.counts(none, word)
        v, n = self.words.distinct, self.words.total
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))[of_word]
        p = np.full(len(grams), 1.0 / (v + 1))
        for k in range(1, order + 1):
            level, part = self.levels[k - 1], grams[:, order - k :]
            context = context_hash(part)
            key, first, back = np.unique(gram_hash(context, part[:, -1]), return_index=True, return_inverse=True)
            count = level.counts(context[first], part[first, -1])
            own, back_own = np.unique(context[first], return_inverse=True)
            stats = level.contexts(own)[back_own]
            total = np.maximum(stats[:, 0], 1)
            d = level.discount[np.minimum(count, 3)]
            gamma = np.where(stats[:, 0] > 0, (stats[:, 1:] @ level.discount[1:]) / total, 1.0)
            p = (np.maximum(count - d, 0) / total)[back] + gamma[back] * p
        with np.errstate(divide="ignore"):
            logs = np.log10(p)
        edge = np.cumsum(tokens) - tokens
        sums = [np.add.reduceat(x, edge) for x in ((c > 0)[of_word].astype(np.int64), base, logs)]
        return list(zip(tokens.tolist(), *(x.tolist() for x in sums)))


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """The model of all texts of docs (text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    uri = f"{shared_dir(spark)}/kneser-ney-{uuid.uuid4().hex}"
    fs, path = filesystem(uri)
    fs.create_dir(path, recursive=True)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))
    none = np.empty(0, U64)

    def level(blobs: DataFrame, width: int, hot: np.ndarray, suffixes: bool) -> tuple[Level, DataFrame]:
        dealt = blobs.select("shard", "blob").repartitionById(shards, "shard").sortWithinPartitions("shard")
        merged = scratch.written(dealt.mapInArrow(_merge(width, shards, hot, uri, suffixes), _ROWS))
        notes = [json.loads(r.note) for r in merged.filter("blob is null").select("note").collect()]  # one a shard
        return Level(notes, uri, shards, hot), merged.filter("blob is not null")

    counted = scratch.written(texts.mapInArrow(_count(1, shards, none, order - 1), _ROWS))
    words, _ = level(counted.filter("blob is not null"), 1, none, False)
    # Each counted n-gram is a token, so a context's share of them is its share of the words' total.
    often = counted.filter("blob is null").groupBy("context").agg(F.sum("n").alias("n")).filter(F.col("n") * 8 * shards >= words.total)
    hot = np.array([r.context for r in often.select("context").collect()], np.int64).view(U64)  # at most eight a shard
    levels: list[Level] = []
    blobs = texts.mapInArrow(_count(order, shards, hot), _ROWS)
    for k in range(order, 0, -1):
        found, blobs = level(blobs, k, hot if k == order else none, k > 1)
        levels.append(found)
    scratch.clear()
    return Model(levels[::-1], words)


def score(docs: DataFrame, model: Model, *keep: Column | str) -> DataFrame:
    """The columns `keep`, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(model)  # file names and frequent contexts only
    source = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    kept = source.columns[:-1]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1500, "__text"):
                n, known, base, log = zip(*shipped.value.score(part.column("__text")))
                total = [shipped.value.words.total] * len(n)
                arrays = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(total, pa.int64()), pa.array(base, pa.float64()), pa.array(log, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *arrays], names=[*kept, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
