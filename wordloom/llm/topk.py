"""Exact top-k search by inner product of integer vectors: three phases with a uniform threshold.

A vector's dimensions are cut into m slices; the scores of a query in one slice are a list, and a
score is the sum over its m lists. Candidates and queries meet in blocks, each pair of blocks a cell.

1. Each cell gathers its local lists: the best entries of a query in each slice. Their objects'
   scores are summed, and the (k+1)-th best sum over all cells is a safe cutoff: so many objects at
   least reach it.
2. The cutoff goes back to the cells with the query. An object below the m-th part of it in every
   list is below it in sum, so a cell collects only the objects that reach that part in some list.
3. The remaining objects' scores are resolved exactly from the whole vectors, and each cell sends
   the best k+1 that reach the cutoff.

Vectors with equal components are one object that carries its k+1 smallest ids, so a vector that a
third of the rows hold costs one node. Sums are exact: products are made in doubles while they stay
below 2**53, in whole numbers of any size beyond.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do
rows without an id; a candidate of another length than the query's is no candidate; repeated rows
count once; of one id with several vectors each is a query and a candidate, but never of that id;
ties go to the smaller id; an empty table has no rows; other columns are not read, whatever their
names. Components and scores beyond 64 bits end at its limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, tidy

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_CELL = "query_id long, query_key long"


def integers(vectors: DataFrame, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, ints, key, key2): floor(scale * x) of the components of each vector that takes part; the keys name the whole vector by 128 bits."""
    x = F.col(embedding).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    whole = vectors.filter(F.col(vec_id).isNotNull() & x.isNotNull() & fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * float(scale)).cast("long")).alias("ints"))
    return whole.withColumns({"key": F.xxhash64(F.size("ints"), "ints"), "key2": F.xxhash64(F.lit(1), F.size("ints"), "ints")})


def objects(rows: DataFrame, k: int) -> DataFrame:
    """(ints, key, ids): one row a distinct vector, with the k + 1 smallest ids that hold it. Limits are applied before rows are shuffled."""
    rows = rows.groupBy("key", "key2", "vec_id").agg(F.first("ints").alias("ints"))
    place = F.row_number().over(Window.partitionBy("key", "key2").orderBy("vec_id"))
    least = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
    return least.groupBy("key", "key2").agg(F.first("ints").alias("ints"), F.sort_array(F.collect_list("vec_id")).alias("ids")).drop("key2")


def _packed(rows: pa.Table) -> pa.Table:
    """The vectors of one block as one row: a matrix in the smallest whole numbers that hold it."""
    n, values = rows.num_rows, rows["ints"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    least, most = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    kind = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= least and most <= np.iinfo(t).max)
    out = {"width": rows["width"].slice(0, 1), "block": rows["block"].slice(0, 1), "kind": pa.array([kind]), "matrix": pa.array([values.astype(kind).tobytes()], pa.binary())}
    for name in rows.column_names:
        if name not in (*out, "ints"):
            column = rows[name].combine_chunks()
            out[name] = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), column)
    return pa.table(out)


def blocks(rows: DataFrame, count: int, key: str) -> DataFrame:
    """The rows (ints, ...) in about `count` blocks for each length of vectors, dealt by `key`: (width, block, kind, matrix) and the other columns as arrays."""
    others = [f for f in rows.schema if f.name != "ints"]
    dealt = rows.withColumns({"width": F.size("ints"), "block": F.pmod(F.xxhash64(key), F.lit(count)).cast("int")})
    schema = "width int, block int, kind string, matrix binary" + "".join(f", {f.name} array<{f.dataType.simpleString()}>" for f in others)
    return dealt.groupBy("width", "block").applyInArrow(_packed, schema)


def cells(candidates: DataFrame, queries: DataFrame, count: int, asked: int) -> DataFrame:
    """A row for each pair of a block of candidates and a block of queries of one length."""
    left = candidates.withColumnsRenamed({"kind": "c_kind", "matrix": "c_matrix"}).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(asked - 1))))
    right = queries.withColumnsRenamed({"kind": "q_kind", "matrix": "q_matrix", "block": "q_block"}).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    n = min(count * asked, 20 * partitions(candidates))
    keys = ["width", "block", "q_block"]
    return left.repartition(n, *keys).join(right.repartition(n, *keys), keys)


def _matrix(cell: dict, side: str) -> np.ndarray:
    return np.frombuffer(cell[f"{side}_matrix"], cell[f"{side}_kind"]).reshape(-1, cell["width"]) if cell["width"] else np.zeros((len(cell["ids" if side == "c" else "query_id"]), 0), np.int64)


def _exact(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x and y as doubles if all sums of products are whole there, else as numbers of any size."""
    most = [int(np.abs(m.astype(object)).max()) if m.dtype == np.int64 and m.size else int(np.abs(m.astype(np.int64)).max(initial=0)) for m in (x, y)]
    kind = np.float64 if most[0] * most[1] * max(1, x.shape[1]) < 1 << 53 else object
    return x.astype(kind), y.astype(kind)


def slices_of(width: int, lists: int) -> list[np.ndarray]:
    return np.array_split(np.arange(width), max(1, min(lists, width)))


def local_lists(queries: np.ndarray, objects_: np.ndarray, k: int, lists: int) -> np.ndarray:
    """Phase 1: the best k + 1 sums of each query among the objects that lead one of its lists (less than all numbers where there are fewer)."""
    n, leading = len(objects_), []
    for part in slices_of(objects_.shape[1], lists):
        scores = queries[:, part] @ objects_[:, part].T
        leading.append(np.argpartition(-scores, min(k, n - 1), axis=1)[:, : k + 1] if scores.dtype != object else np.argsort(-scores, axis=1, kind="stable")[:, : k + 1])
    at = np.sort(np.concatenate(leading, axis=1), axis=1)
    sums = (objects_[at] * queries[:, None, :]).sum(axis=2)
    out = np.full((len(queries), k + 1), None, object)
    for i, (spots, found) in enumerate(zip(at, sums)):
        fresh = np.concatenate([[True], spots[1:] != spots[:-1]])  # an object may lead several lists
        best = sorted((int(v) for v in found[fresh]), reverse=True)[: k + 1]
        out[i, : len(best)] = best
    return out


def sufficient(queries: np.ndarray, objects_: np.ndarray, cutoff: list[int | None], lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 2: (query, object) of all objects that reach the uniform part of the query's cutoff in some list; all where there is no cutoff."""
    parts = slices_of(objects_.shape[1], lists)
    kind = queries.dtype
    least = np.array([-np.inf if c is None else c for c in cutoff], kind)[:, None]
    reach = np.zeros((len(queries), len(objects_)), bool)
    for part in parts:
        reach |= ((queries[:, part] @ objects_[:, part].T) * len(parts) >= least).astype(bool)
    return np.nonzero(reach)


def resolved(queries: np.ndarray, objects_: np.ndarray, q: np.ndarray, o: np.ndarray, cutoff: list[int | None], k: int, first_id: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Phase 3: (query, object, score) of the best k + 1 objects of each query, by score and then smallest id, among those whose exact score reaches the cutoff."""
    for lo in range(0, len(q), 1 << 16):
        # a query's pairs may go on in the next part; the caller's limit over all cells is exact either way
        a, b = q[lo : lo + (1 << 16)], o[lo : lo + (1 << 16)]
        scores = (queries[a] * objects_[b]).sum(axis=1)
        least = np.array([-np.inf if cutoff[i] is None else cutoff[i] for i in a.tolist()], queries.dtype)
        kept = np.flatnonzero((scores >= least).astype(bool))
        a, b, scores = a[kept], b[kept], scores[kept]
        rows = sorted(zip(a.tolist(), (-scores).tolist(), first_id[b].tolist(), b.tolist()))
        last, n = None, 0
        for i, score, _, j in rows:
            last, n = i, n + 1 if i == last else 1
            if n <= k + 1:
                yield i, j, -int(score)


def _phases(k: int, lists: int, second: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.to_pylist():
                objects_, asked = _exact(_matrix(cell, "c"), _matrix(cell, "q"))
                keys, out = list(zip(cell["query_id"], cell["query_key"])), []
                first_id = np.array([ids[0] for ids in cell["ids"]], np.int64)
                step = max(1, (1 << 21) // max(1, len(objects_)))  # a tile of scores has about 16 MB
                for lo in range(0, len(asked), step):
                    tile = asked[lo : lo + step]
                    if not second:
                        for key, best in zip(keys[lo:], local_lists(tile, objects_, k, lists)):
                            out += [(*key, max(_LOW, min(_HIGH, v))) for v in best if v is not None]
                        continue
                    cutoff = [None if c is None or c == _LOW else c for c in cell["cutoff"][lo : lo + step]]
                    q, o = sufficient(tile, objects_, cutoff, lists)
                    for i, j, score in resolved(tile, objects_, q, o, cutoff, k, first_id):
                        key, score = keys[lo + i], max(_LOW, min(_HIGH, score))
                        out += [(*key, score, vec_id) for vec_id in cell["ids"][j] if vec_id != key[0]]
                names = ["query_id", "query_key", "score", "vec_id"][: 3 + second]
                columns = list(zip(*out)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return tidy(run)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, lists: int = 2, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query among all vectors but those of its own id, ties to the smaller id.

    vectors and queries have vec_id and embedding. A cell is a block of about `block` objects and as
    many queries; what the phases send for a query is k + 1 numbers a cell at most.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    try:
        whole = scratch.written(objects(integers(vectors, scale), k))
        asked = integers(queries, scale).select(F.col("vec_id").alias("query_id"), F.col("key").alias("query_key"), "ints").dropDuplicates(["query_id", "query_key"])
        asked = scratch.written(asked)
        n, m = (max(1, -(-df.count() // block)) for df in (whole, asked))
        candidates = scratch.written(blocks(whole.select("ints", "key", "ids"), n, "key").drop("key"))
        first = cells(candidates, blocks(asked, m, "query_id"), n, m).mapInArrow(_phases(k, lists, False), f"{_CELL}, score long")
        place = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score")))
        cutoff = first.withColumn("place", place).filter(F.col("place") <= k + 1).filter(F.col("place") == k + 1).select("query_id", "query_key", F.col("score").alias("cutoff"))
        told = asked.join(scratch.written(cutoff), ["query_id", "query_key"], "left")
        last = cells(candidates, blocks(told, m, "query_id"), n, m).mapInArrow(_phases(k, lists, True), f"{_CELL}, score long, vec_id long")
        rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
        found = last.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        return Scratch(spark).written(found, keep=True)
    finally:
        scratch.clear()
