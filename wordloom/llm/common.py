"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local master may fall back to a temporary folder; a cluster must name the folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(found)
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = os.path.join(tempfile.gettempdir(), "wordloom-checkpoints")
    spark.sparkContext.setCheckpointDir(found)
    return spark.sparkContext.getCheckpointDir()


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


def removed(uri: str) -> None:
    """Deletes a folder that this subpackage wrote; one that is already gone, or lies where only Spark can reach it, is left."""
    try:
        fs, path = filesystem(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return
    if fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound:
        fs.delete_dir(path)


#: Spark's setting by which the shuffle files of a finished write are removed at once, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes inside remove their shuffle files when they end, as nothing reads them again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def saved(df: DataFrame, path: str) -> DataFrame:
    """df written as compressed Parquet and read back."""
    with tidy_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's bound on an Arrow batch in bytes (none unless set), and the bound that this subpackage sets where the session has none.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session by bytes, so that ten thousand long texts are never sent to a worker at once."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


class Scratch:
    """Tables of one call in the shared folder, so that lineage is cut by files that outlive executors.

    `clear` deletes them, but for those written with `keep`, which the call's result still reads.
    """

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, keep: bool = False) -> DataFrame:
        path = f"{shared_dir(self.spark)}/wordloom-{uuid.uuid4().hex}"
        if not keep:
            self.paths.append(path)
        return saved(df, path)

    def clear(self) -> None:
        while self.paths:
            removed(self.paths.pop())


def written(df: DataFrame) -> DataFrame:
    """df written in the shared folder and read back, for good."""
    return Scratch(df.sparkSession).written(df, keep=True)


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def tidy(run):
    """run, after whose end a reused worker gives the memory that it no longer needs back to the machine."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not glibc
                pass

    return tidied


def learns(doc_id: Column | str, modulus: int, held_out: int) -> Column:
    """True for rows to learn from: crc32 of the id as text, modulo `modulus`, is not `held_out` (null id: as the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus != held_out


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words [^\\x20\\x09-\\x0D]+ of a batch of texts (null: none): (begin, codes, vocabulary).

    Text i has the words vocabulary[c] for c in codes[begin[i]:begin[i + 1]]. Arrow's ASCII blanks
    are just these six bytes; `lower` lower-cases A-Z only.
    """
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=begin[1:])
    found = lists.flatten().cast(pa.large_binary()).dictionary_encode()
    codes, vocabulary = found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()
    empty = np.fromiter((i for i, w in enumerate(vocabulary) if not w), np.int64)
    if len(empty):  # at a text's blank ends
        keep = codes != empty[0]
        codes, begin = codes[keep], np.concatenate([[0], np.cumsum(keep)])[begin]
    return begin, codes, vocabulary


def hashed(vocabulary: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in vocabulary), U64, len(vocabulary))


def word_hashes(texts: pa.Array, lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(begin, hashes): the 64-bit hashes of the words of text i are hashes[begin[i]:begin[i + 1]]."""
    begin, codes, vocabulary = split_words(texts, lower)
    h = hashed(vocabulary, seed)
    return begin, h[codes] if len(codes) else np.empty(0, U64)


def slices(batch: pa.RecordBatch, rows: int = 1000, text: str | None = None, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `rows` rows and, where a text column is named, about `most` bytes of it, so that one part fits in memory."""
    if text is None:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        return
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right"))
        stop = min(max(stop, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, element by element."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        m = max(4096, 1 << (n - 1).bit_length())
        up = np.full(m, base, U64)
        down = np.full(m, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        have = _POWERS[base] = (np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64))
        if m > 1 << 22:
            del _POWERS[base]  # an extreme text's table isn't kept
    return have


def window_hashes(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all windows of k consecutive items of h (none if h is shorter)."""
    n = len(h)
    if n < k:
        return np.empty(0, U64)
    if k == 1:
        return mixed(h)
    up, down = _powers(base, n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U64)
        np.cumsum(h * up[:n], dtype=U64, out=total[1:])
        return mixed((total[k:] - total[: n - k + 1]) * down[: n - k + 1])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unite(n: int, a: Iterable[int], b: Iterable[int]) -> np.ndarray:
    """Root of each of n items after uniting a[i] with b[i]; a root is its set's smallest index."""
    root = np.arange(n)
    a, b = np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)
    while len(a):
        ra, rb = root[a], root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = lo != hi
        if not open_.any():
            break
        a, b, lo, hi = a[open_], b[open_], lo[open_], hi[open_]
        np.minimum.at(root, hi, lo)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    return root


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable. The result is a written table.

    Alternating large-star and small-star steps; each step groups by node with map-side minima and
    joins them back, so no neighbour list is ever gathered. Self-loops keep their node. Each round's
    edges are written and the round's before deleted.
    """
    spark = edges.sparkSession
    first, held = Scratch(spark), Scratch(spark)
    edges = first.written(edges.select("a", "b").distinct())  # read several times below: made once
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    e = held.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        now = Scratch(spark)
        e = now.written(e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).filter("u <> v").distinct())
        held.clear()
        held, state = now, tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if state == seen:
            break
        seen = state
    of = nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left")
    out = written(of.select("node", F.coalesce("component", "node").alias("component")))
    first.clear()
    held.clear()
    return out
