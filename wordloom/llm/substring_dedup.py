"""Substring deduplication with a log-structured index of window fingerprints.

A window is `size` consecutive words; a word is removed if a window covers it whose words also
start in a document with a smaller id. Windows are judged on the input.

The index is a list of immutable runs, each a table bucketed and sorted by fingerprint, in a folder
of its own with a manifest, so that it can be closed and opened again by a later job. It keeps the
texts that a later batch may have to be compared with, unless each call names the earlier texts. A window's
fingerprint is the least hash among its half-size sub-windows (a minimiser), so equal windows have
equal fingerprints while only about one fingerprint in a dozen words is kept. A new batch (whose ids
exceed all earlier ones) is written as a run of its own and merge-joined, bucket by bucket and in the
stored order, with each older run. Fingerprints met in another document only name candidates: the candidates' windows
are then verified by two independent hashes of all `size` words (96 bits), of which the least
document is found by partial minima, so a passage that a third of all documents share puts one row
a task into a shuffle; the windows that so many documents share (fewer than four a partition, by
their share of all) are compared by broadcast, not dealt by key. Neighbouring runs are compacted, however
old, when their sizes come within a factor of each other, so a batch meets a logarithmic number of runs. Whole
copies of earlier documents are recognised by a digest of all their words and put nothing into the
index, so a group of copies costs one document.

Edge cases: null or short texts have no window and keep their words; repeated rows (one id) do not
count as smaller documents and are returned as often as they come; rows with a null id neither
lose words nor take any from others; an empty table gives no row; texts of any length are read
whole, a few megabytes of texts at a time; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, U64, filesystem, hashed, mixed, partitions, removed, saved, shared_dir, signed, slices, split_words, tidy, tidy_shuffles, window_hashes

SIZE = 50
#: Candidates of which the ids are sent to all tasks, so that other texts are not shuffled; more are joined.
SENT = 1_000_000


def _anchors(begin: np.ndarray, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all windows, their fingerprints): the least hash of a half-size sub-window."""
    half = size // 2
    doc_end = np.repeat(begin[1:], np.diff(begin))
    starts = np.flatnonzero(np.arange(len(h)) + size <= doc_end)
    if not len(starts):
        return starts, np.empty(0, U64)
    g = window_hashes(h, half)
    least = np.lib.stride_tricks.sliding_window_view(g, size - half + 1).min(1)
    return starts, least[starts]


def _scan(size: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("sha256", pa.string()), ("whole", pa.int64()), ("whole_check", pa.int64()), ("anchors", pa.list_(pa.int64()))]
    )

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text="text"):
                begin, codes, vocabulary = split_words(part.column("text"))
                h = hashed(vocabulary)[codes] if len(codes) else np.empty(0, U64)
                starts, fp = _anchors(begin, h, size)
                lo, hi = np.searchsorted(starts, begin[:-1]), np.searchsorted(starts, begin[1:])
                rows = []
                for i, (doc, key) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("text_key").to_pylist())):
                    digest = hashlib.sha256(b" ".join(map(vocabulary.__getitem__, codes[begin[i] : begin[i + 1]].tolist())))
                    whole, check = np.frombuffer(digest.digest()[:16], np.int64).tolist() if hi[i] > lo[i] and doc is not None else (None, None)
                    rows.append((doc, key, begin[i + 1] - begin[i], digest.hexdigest(), whole, check, signed(np.unique(fp[lo[i] : hi[i]])) if whole is not None else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


_SCAN = "doc_id long, text_key long, n_words long, sha256 string, whole long, whole_check long, anchors array<long>"


def _candidate_windows(size: int):
    """Windows whose fingerprint is among the document's shared ones: a, b (64 and 32 bits of independent hashes), doc_id, at (its place)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 300, "text"):
                begin, codes, vocabulary = split_words(part.column("text"))
                h = hashed(vocabulary)[codes] if len(codes) else np.empty(0, U64)
                starts, fp = _anchors(begin, h, size)
                if not len(starts):
                    continue
                a = signed(window_hashes(h, size))
                b = (window_hashes(mixed(h ^ U64(0xD6E8FEB86659FD93)), size, 0xA24BAED4963EE407) >> U64(32)).astype(np.uint32).view(np.int32)
                lo, hi = np.searchsorted(starts, begin[:-1]), np.searchsorted(starts, begin[1:])
                for i, (doc, shared) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("shared"))):
                    use = np.isin(signed(fp[lo[i] : hi[i]]), shared.values.to_numpy())
                    at = starts[lo[i] : hi[i]][use]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(np.full(len(at), doc, np.int64)), pa.array((at - begin[i]).astype(np.int32))], names=["a", "b", "doc_id", "at"])

    return run


_WINDOWS = "a long, b int, doc_id long, at int"


def repeated_windows(windows: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, at of the windows (a, b, doc_id, at: a written table) that a document with a smaller id holds, too."""
    least = windows.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    least = scratch.written(least.filter("least < most").drop("most"))
    share = windows.count() / (4 * partitions(windows))
    hot = F.broadcast(least.filter(F.col("n") > share).drop("n"))  # fewer than four a partition
    rare = windows.join(hot, ["a", "b"], "left_anti").join(least.filter(F.col("n") <= share).drop("n"), ["a", "b"])
    return windows.join(hot, ["a", "b"]).unionByName(rare).filter("doc_id > least").select("doc_id", "at")


def _rewritten(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 300, "text"):
                begin, codes, vocabulary = split_words(part.column("text"))
                rows = []
                for i, (doc, key, at) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "text_key", "at")))):
                    words = codes[begin[i] : begin[i + 1]]
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.array(at, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + size, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = b" ".join(map(vocabulary.__getitem__, words[~gone].tolist()))
                    rows.append((doc, key, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


#: Whether Spark trusts the order in which bucketed tables are stored.
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextlib.contextmanager
def stored_order(spark: SparkSession) -> Iterator[None]:
    """Joins of bucketed tables use the order in which their buckets are stored (each is one file here)."""
    before = spark.conf.get(_ORDERED, None)
    spark.conf.set(_ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(_ORDERED, before) if before is not None else spark.conf.unset(_ORDERED)


@dataclass
class Run:
    table: str
    rows: int


class FingerprintIndex:
    """Runs of fingerprints (fp, doc_id) and of whole-document digests, as bucketed sorted tables in the folder `path`.

    With keep_texts the texts of documents that have fingerprints are kept beside them, in order of
    id, so that a later job needs nothing but the index. `ingest` leaves a manifest behind, from which `open` goes on in another job; what a failed ingest
    wrote is not in it. `close` takes the tables out of the session's catalog, `drop` deletes them.
    """

    COLUMNS = {"fp": "fp bigint, doc_id bigint", "whole": "whole bigint, whole_check bigint, doc_id bigint"}

    def __init__(self, spark: SparkSession, path: str | None = None, size: int = SIZE, fan_in: int = 2, keep_texts: bool = True):
        self.spark, self.size, self.fan_in, self.keep_texts = spark, size, fan_in, keep_texts
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = path or f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.runs: dict[str, list[Run]] = {"fp": [], "whole": []}
        self.stale: list[Run] = []
        self.texts: list[str] = []
        self.compactions = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "FingerprintIndex":
        fs, at = filesystem(path)
        with fs.open_input_stream(f"{at}/manifest.json") as f:
            found = json.loads(f.read())
        index = cls(spark, path, found["size"], found["fan_in"], found["keep_texts"])
        index.buckets, index.compactions, index.texts = found["buckets"], found["compactions"], found["texts"]
        for key, runs in found["runs"].items():
            index.runs[key] = [Run(**r) for r in runs]
            for r in runs:
                spark.sql(f"CREATE TABLE IF NOT EXISTS {r['table']} ({cls.COLUMNS[key]}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {index.buckets} BUCKETS LOCATION '{path}/{r['table']}'")
        return index

    def _save(self) -> None:
        """The manifest as a whole, then the folders of runs that it no longer names."""
        fs, at = filesystem(self.path)
        fs.create_dir(at, recursive=True)
        runs = {k: [asdict(r) for r in v] for k, v in self.runs.items()}
        with fs.open_output_stream(f"{at}/manifest.new") as f:
            f.write(json.dumps({"size": self.size, "fan_in": self.fan_in, "buckets": self.buckets, "compactions": self.compactions, "keep_texts": self.keep_texts, "texts": self.texts, "runs": runs}).encode())
        fs.move(f"{at}/manifest.new", f"{at}/manifest.json")
        while self.stale:
            r = self.stale.pop()
            self.spark.sql(f"DROP TABLE IF EXISTS {r.table}")
            removed(f"{self.path}/{r.table}")

    def close(self) -> None:
        for r in [*self.runs["fp"], *self.runs["whole"]]:
            self.spark.sql(f"DROP TABLE IF EXISTS {r.table}")  # an external table: its files stay

    def drop(self) -> None:
        self.close()
        removed(self.path)

    def _write(self, rows: DataFrame, key: str) -> Run:
        name = f"fingerprints_{uuid.uuid4().hex[:16]}"
        with tidy_shuffles(self.spark):
            rows.repartition(self.buckets, key).write.bucketBy(self.buckets, key).sortBy(key).option("compression", "zstd").option("path", f"{self.path}/{name}").saveAsTable(name)
        return Run(name, self.spark.table(name).count())

    def _add(self, key: str, run: Run) -> None:
        """The run as the newest; while there are more than fan_in, neighbours of which the older is not fan_in times the newer's size are merged."""
        runs = self.runs[key]
        runs.append(run)
        while len(runs) > self.fan_in:
            near = [i for i in range(len(runs) - 1) if runs[i].rows <= self.fan_in * runs[i + 1].rows]
            if not near:
                break
            old, new = runs[near[-1] : near[-1] + 2]
            both = self.spark.table(old.table).unionByName(self.spark.table(new.table))
            if key == "whole":  # a digest that both runs hold stays once, with its least document
                both = both.repartition(self.buckets, "whole").groupBy("whole", "whole_check").agg(F.min("doc_id").alias("doc_id"))
            runs[near[-1] : near[-1] + 2] = [self._write(both, key)]
            self.stale += [new, old]
            self.compactions += 1

    def _earlier(self) -> DataFrame | None:
        """doc_id, text of the earlier documents that have fingerprints."""
        tables = [self.spark.read.schema("doc_id long, text string").parquet(f"{self.path}/{name}") for name in self.texts]
        return reduce(DataFrame.unionByName, tables) if tables else None

    def shared_fingerprints(self, run: Run) -> DataFrame:
        """fp, doc_id of the new run and the older ones whose fingerprint is met in another document; a row may come several times.

        Both sides of each join with an older run are read as they are stored, so nothing is shuffled or sorted.
        """
        fresh = self.spark.table(run.table)
        several = fresh.groupBy("fp").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("fp")
        found = [fresh.join(several, "fp", "left_semi")]
        for old in self.runs["fp"]:
            old = self.spark.table(old.table)
            found += [old.join(fresh.hint("merge"), "fp", "left_semi"), fresh.join(old.hint("merge"), "fp", "left_semi")]
        return reduce(DataFrame.unionByName, [d.select("fp", "doc_id") for d in found])

    def ingest(self, batch: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
        """Judges batch (doc_id, text), whose ids exceed all earlier ones, and adds it to the index.

        The texts of earlier candidates come from the index, or from corpus (doc_id, text of the
        earlier documents and of the batch), without which an index that keeps no texts takes one batch only.
        Returns one row per row of batch: doc_id, text_key, n_words, n_removed, kept_sha256, kept_text (null: unchanged).
        """
        if corpus is None and not self.keep_texts and self.runs["fp"]:
            raise ValueError("this index keeps no texts; name the earlier ones as corpus")
        scratch = Scratch(self.spark)
        with_key = lambda d: d.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
        scan = scratch.written(with_key(batch).select("doc_id", "text_key", "text").mapInArrow(_scan(self.size), _SCAN))
        # Whole copies: of an earlier document, or of a smaller one of this batch.
        digest = ["whole", "whole_check"]
        known = scan.filter("whole is not null").groupBy(*digest).agg(F.min("doc_id").alias("doc_id"))
        run = self._write(known.select(*digest, "doc_id"), "whole")
        # Dealt anew before minima are taken, so that a digest that several runs hold is one row whatever their buckets.
        runs = [self.spark.table(r.table) for r in [*self.runs["whole"], run]]
        every = reduce(DataFrame.unionByName, runs).repartition(partitions(batch), "whole")
        least = every.groupBy(*digest).agg(F.min("doc_id").alias("first"))
        marked = scratch.written(scan.join(least, digest, "left").select(*scan.columns, F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy")))
        self._add("whole", run)
        firsts = marked.filter("whole is not null and not copy").select("doc_id", "text_key", "anchors").dropDuplicates(["doc_id", "text_key"])
        run = self._write(firsts.select(F.explode("anchors").alias("fp"), "doc_id"), "fp")
        with stored_order(self.spark):
            lists = scratch.written(self.shared_fingerprints(run).groupBy("doc_id").agg(F.collect_set("fp").alias("shared")))
        if corpus is None:
            earlier, corpus = self._earlier(), batch.select("doc_id", "text")
            if earlier is not None:
                low, high = lists.agg(F.min("doc_id"), F.max("doc_id")).first()  # files outside are not read
                corpus = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).unionByName(earlier.filter(F.col("doc_id").between(low, high)))
        texts = with_key(corpus)
        if lists.count() <= SENT:
            texts = texts.join(F.broadcast(lists.select("doc_id")), "doc_id", "left_semi")
        candidates = scratch.written(texts.join(lists, "doc_id"))
        windows = scratch.written(candidates.select("doc_id", "text", "shared").mapInArrow(_candidate_windows(self.size), _WINDOWS))
        places = repeated_windows(windows, scratch).groupBy("doc_id").agg(F.collect_set("at").alias("at"))
        own = marked.filter("whole is not null and not copy").select("doc_id", "text_key").distinct()
        texts = candidates.select("doc_id", "text_key", "text").join(own, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
        changed = texts.join(places, "doc_id").mapInArrow(_rewritten(self.size), "doc_id long, text_key long, n_removed long, kept_sha256 string, kept_text string")
        empty = hashlib.sha256(b"").hexdigest()
        out = marked.select("doc_id", "text_key", "n_words", "sha256", "copy").join(changed, ["doc_id", "text_key"], "left")
        out = scratch.written(
            out.select(
                "doc_id",
                "text_key",
                "n_words",
                F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
                F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
            ),
            keep=True,
        )
        if self.keep_texts:
            name = f"texts-{uuid.uuid4().hex[:16]}"
            kept = with_key(batch).join(firsts.filter(F.size("anchors") > 0).select("doc_id", "text_key"), ["doc_id", "text_key"], "left_semi")
            saved(kept.select("doc_id", "text").sortWithinPartitions("doc_id"), f"{self.path}/{name}")
            self.texts.append(name)
        self._add("fp", run)
        self._save()
        scratch.clear()
        return out


def deduplicate(docs: DataFrame, size: int = SIZE, batches: int = 4, index: FingerprintIndex | None = None) -> DataFrame:
    """Feeds docs to an index in `batches` ranges of ids, in order, so that runs are merge-joined and compacted; one row per row of docs, as FingerprintIndex.ingest.

    Without an index an empty one is made, which reads earlier texts from docs; a given one must keep
    its texts (or be empty), and docs are judged against all that it has seen.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = docs.filter("doc_id is not null").approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    own, out, lo = index or FingerprintIndex(spark, size=size, keep_texts=False), None, None
    try:
        for hi in [*cuts, None]:
            after = F.lit(True) if lo is None else F.col("doc_id") > lo
            upto = F.lit(True) if hi is None else F.col("doc_id") <= hi
            part = docs.filter(after & upto | (F.col("doc_id").isNull() if hi is None else F.lit(False)))
            found = own.ingest(part, docs.filter(upto) if index is None else None)
            out = found if out is None else out.unionByName(found)
            lo = hi
    finally:
        if index is None:
            own.drop()
    return out
