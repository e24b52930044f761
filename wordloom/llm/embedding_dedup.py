"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised; a table's key quantises several Gaussian projections, floor((a.v + b) / w),
so vectors that lie close often share a key. The number of projections follows the number of
vectors (a bucket then holds a bounded number of unrelated vectors), the number of tables follows
from it so that a pair at the threshold itself is missed with a probability below 1 - RECALL.
Equal vectors are one class. Buckets with one member are left out before any vector is sent;
large buckets are cut into blocks, and each pair of blocks is one matrix product in double
precision. A pair counts in the first table in which its keys agree, so each link is counted once;
the keys of earlier tables are made again in the task, for vectors that link there only.
Tasks give sums of links for each vector and a spanning forest, never pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different lengths do not link; repeated rows are equal vectors; a null id is
never a component's smallest while another is known; an empty table gives no rows; other columns
are not read. Vectors may be of any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, mixed, partitions, Scratch, signed, tidy, U64, unite, written

THRESHOLD = 0.9
RECALL = 0.995
#: Quantisation width; unrelated vectors a bucket may hold on average; vectors in a block.
WIDTH, MATES, BLOCK = 2.5, 128, 1024
#: What names a task: a bucket, and two of its blocks (or one twice).
TASK = ["table", "key", "dim", "lo", "hi"]


def collision(distance: float, width: float) -> float:
    """Chance that one quantised projection of two vectors at this distance agrees."""
    if distance == 0:
        return 1.0
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(projections a table, tables) for n vectors."""
    near, far = collision(math.sqrt(2 - 2 * threshold), WIDTH), collision(math.sqrt(2), WIDTH)
    k = max(2, math.ceil(math.log(max(n, 2) / MATES) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log1p(-(near**k))))


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def keys(m: np.ndarray, projections: int, tables: int, seed: int, upto: int | None = None) -> np.ndarray:
    """(vectors x tables) bucket keys, of the first `upto` tables if given.

    Vectors and projections are taken on grids of 2**-20 and 2**-10, so products are sums of whole
    numbers below 2**53: exact in any order, and a vector has the same keys in every task.
    """
    upto = tables if upto is None else upto
    rng = np.random.default_rng([seed, m.shape[1]])
    a, b = rng.standard_normal((m.shape[1], projections * tables)), rng.uniform(0, WIDTH, projections * tables)
    a, b = np.rint(a[:, : projections * upto] * 2**10), np.rint(b[: projections * upto] * 2**30)
    q = np.floor((np.rint(m * 2**20) @ a + b) / (WIDTH * 2**30)).astype(np.int64).view(U64).reshape(len(m), upto, projections)
    h = np.broadcast_to(np.arange(1, upto + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(m.shape[1]), q.shape[:2])
    for i in range(projections):
        h = mixed(h ^ (q[:, :, i] + U64((i + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))))
    return signed(h)


def _hashing(projections: int, tables: int, seed: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                found = keys(_unit(part.column("v"), int(dim)), projections, tables, seed)
                at = pa.array(np.arange(0, found.size + 1, tables, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column("class"), part.column("dim"), pa.ListArray.from_arrays(at, pa.array(found.reshape(-1)))], names=["class", "dim", "keys"])

    return run


def _checking(threshold: float, projections: int, tables: int, seed: int):
    """Per block pair of a bucket: links of each class (weighted by class sizes), and star edges of their forest."""

    def check(rows: pa.Table) -> pa.RecordBatch | None:
        n, dim, table = rows.num_rows, rows["dim"][0].as_py(), rows["table"][0].as_py()
        cls, own, size = (rows[c].to_numpy() for c in ("class", "own", "n"))
        m = _unit(rows["v"].combine_chunks(), dim)
        cosine = m @ m.T
        # On the edge of the threshold, sums in a fixed order decide.
        i, j = np.nonzero(np.triu(cosine >= threshold - 1e-9, 1))
        if rows["lo"][0] != rows["hi"][0]:  # pairs within one block belong to that block's own task
            use = own[i] != own[j]
            i, j = i[use], j[use]
        edge = np.abs(cosine[i, j] - threshold) < 1e-9
        ok = np.ones(len(i), bool)
        ok[edge] = [math.fsum(x * y) >= threshold for x, y in zip(m[i[edge]], m[j[edge]])]
        i, j = i[ok], j[ok]
        if table and len(i):  # only vectors that link here need their keys of the tables before
            at, place = np.unique(np.concatenate([i, j]), return_inverse=True)
            before = keys(m[at], projections, tables, seed, table)
            a, b = place[: len(i)], place[len(i) :]
            first = np.ones(len(i), bool)
            for t in range(table):
                first &= before[a, t] != before[b, t]
            i, j = i[first], j[first]
        if not len(i):
            return None
        links = np.bincount(i, size[j], n) + np.bincount(j, size[i], n)
        root = unite(n, i, j)
        on = np.flatnonzero((links > 0) | (root != np.arange(n)))
        return pa.RecordBatch.from_arrays([pa.array(cls[on]), pa.array(cls[root[on]]), pa.array(links[on].astype(np.int64))], names=["a", "b", "links"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(c).to_numpy() for c in TASK]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                key = tuple(int(x[start]) for x in names)
                if key != task:
                    if (out := flush(held)) is not None:
                        yield out
                    task, held = key, []
                held.append(batch.slice(start, stop - start))
        if (out := flush(held)) is not None:
            yield out

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        return check(pa.Table.from_batches(parts)) if sum(p.num_rows for p in parts) > 1 else None

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding).

    What is shuffled for a vector is its components, as wide as they came, once a table in which
    it shares its bucket (and once a block beside its own in a large bucket); keys are not sent.
    """
    scratch = Scratch(vectors.sparkSession)
    try:
        return _near_duplicates(vectors, threshold, recall, seed, scratch)
    finally:
        scratch.clear()


def _near_duplicates(vectors: DataFrame, threshold: float, recall: float, seed: int, scratch: Scratch) -> DataFrame:
    kind = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    v = F.col("embedding")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # Adding zero makes -0.0 and 0.0 one value.
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, F.transform(v, lambda x: x.cast(kind) + F.lit(0.0).cast(kind))).alias("v"))
    marked = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    # Classes of equal vectors, told apart by 128 bits; their numbers are fixed by being written.
    grouped = marked.filter("v is not null").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = scratch.written(grouped.withColumn("class", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    projections, tables = plan(classes.count(), threshold, recall)
    parts = partitions(vectors)
    keyed = scratch.written(classes.select("class", "dim", "v").repartition(parts).mapInArrow(_hashing(projections, tables, seed), "class long, dim int, keys array<long>"))
    bucket = ["table", "key", "dim"]
    places = keyed.select("class", "dim", F.posexplode("keys").alias("table", "key"))
    buckets = places.groupBy(*bucket).agg(F.count("*").alias("size")).filter("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    inside = places.join(buckets, bucket).withColumn("own", F.pmod(F.xxhash64("class", "table"), "blocks").cast("int"))
    mine = inside.groupBy("class").agg(F.collect_list(F.struct("table", "key", "own", "blocks")).alias("in"))  # at most one a table
    sent = mine.join(classes.select("class", "dim", "v", "n"), "class").select("class", "dim", "v", "n", F.explode("in").alias("in"))
    sent = sent.select("class", "dim", "v", "n", "in.*").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    sent = sent.select("class", "v", "n", "own", "table", "key", "dim", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    checked = scratch.written(sent.repartition(parts, *TASK).sortWithinPartitions(*TASK, "class").mapInArrow(_checking(threshold, projections, tables, seed), "a long, b long, links long"))
    links = checked.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    component = connected_components(checked.filter("a <> b").select("a", "b")).withColumnRenamed("node", "class")
    joined = classes.select("class", "h1", "h2", "n", "least").join(links, "class", "left").join(component, "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    # The result reads this table alone; all others go.
    known = written(joined.join(smallest, "component").select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("known")))
    out = marked.withColumn("known", F.col("v").isNotNull()).drop("v").join(known, ["h1", "h2", "known"], "left")
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("vec_id") == component_id, F.lit(False)).alias("kept"))
