"""Merkle manifest of a dataset: a tree of digests over each source's rows, and one over the sources.

A row's leaf is the digest of its fields. Nodes are numbered in their group by distributed ranges,
cut into aligned blocks of `fan ** height` nodes, and each block is walked in postorder: a visit
returns its subtree's digest and, while it unwinds, appends the siblings of each child to the proofs
of the leaves below it. The blocks' roots are the nodes of another distributed walk, until one node
a group is left; then the proofs of the few upper nodes are joined down to the many lower ones. Texts
are read once and never shuffled; no task holds more than a block of any group.

Defined results: a null field is digested as `-`; a null source is a group of its own, before all
others; null ids come first and rows of one id follow by their leaf; repeated rows are leaves of
their own; very long texts cost one digest; an empty table has no rows and no root; columns that
aren't fields are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, tidy

#: A step of a proof: what stands left and right of a node in its run, as hexadecimal digests put together.
STEP = "array<struct<left: string, right: string>>"
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """A row's digest: each field as its UTF-8 byte count, `:` and value, or `-` if null."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, start, lambda have, step: digest(step["left"], have, step["right"]))


def siblings(proof: Column) -> Column:
    """The digest of a proof's siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""))


def numbered(rows: DataFrame, order: Sequence[str], scratch: Scratch) -> DataFrame:
    """rows, with their number `at` in their group `grp` by `order`, from 0, and the group's size `members`.

    The rows are dealt out by ranges, so that a large group is many tasks; only the counts of a
    group in each range are gathered. `order` must tell all rows of a group apart.
    """
    keys = ["grp", *order]
    placed = rows.repartitionByRange(partitions(rows), *keys).sortWithinPartitions(*keys)
    placed = scratch.written(placed.withColumn("spot", F.monotonically_increasing_id())).withColumn("range", F.shiftright("spot", 33))
    counts = placed.groupBy("grp", "range").agg(F.min("spot").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("grp").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "grp", "range", (F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("shift"), F.sum("n").over(Window.partitionBy("grp")).alias("members")
    )
    return placed.join(counts, ["grp", "range"]).withColumn("at", F.col("spot") - F.col("shift")).drop("range", "spot", "shift")


def block_proofs(digests: list[str], fan: int, height: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """(root, proofs) of one block: the digest of its subtree of that height, and each leaf's siblings (left, right) from below."""
    n = len(digests)
    proofs: list[list[tuple[str, str]]] = [[] for _ in digests]

    def visit(first: int, level: int) -> str:
        if not level:
            return digests[first]
        step = fan ** (level - 1)
        starts = range(first, min(first + fan * step, n), step)
        below = [visit(start, level - 1) for start in starts]
        for i, start in enumerate(starts):
            beside = "".join(below[:i]), "".join(below[i + 1 :])
            for proof in proofs[start : start + step]:
                proof.append(beside)
        return hashlib.sha256("".join(below).encode()).hexdigest()

    return visit(0, height), proofs


def _walker(fan: int, height: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Walks the blocks of a partition that is sorted by group and number; a block may go over several batches."""
    size = fan**height

    def levels(members: int) -> int:
        if members > size:
            return height
        h = 0
        while fan**h < members:
            h += 1
        return h

    def walked(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        digests, members = rows["digest"].to_pylist(), rows["members"].to_numpy()
        roots, counts, left, right = [None] * len(digests), [], [], []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(digests)]):
            roots[lo], proofs = block_proofs(digests[lo:hi], fan, levels(int(members[lo])))
            for proof in proofs:
                counts.append(len(proof))
                for a, b in proof:
                    left.append(a)
                    right.append(b)
        steps = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], fields=list(_STEP))
        proofs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), steps)
        rows = rows.append_column("proof", proofs).append_column("above", pa.array(roots, pa.string()))
        return rows.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
            if not rows.num_rows:
                continue
            group, block = rows["grp"].combine_chunks(), rows["at"].to_numpy() // size
            new = (block[1:] != block[:-1]) | pc.not_equal(group.slice(1), group.slice(0, len(group) - 1)).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            if len(starts) > 1:
                yield walked(rows.slice(0, int(starts[-1])), starts[:-1])
            held = rows.slice(int(starts[-1]))
        if held is not None and held.num_rows:
            yield walked(held, np.zeros(1, np.int64))

    return tidy(run)


def climbed(nodes: DataFrame, scratch: Scratch, fan: int = 3, height: int = 5) -> list[DataFrame]:
    """The rounds of walks over nodes (grp, at, members, digest, ...), each written: the nodes with `proof` in their block, and on a block's first node its root `above`.

    The nodes of the next round are the roots of groups of several blocks.
    """
    rounds, size = [], fan**height
    while True:
        dealt = nodes.repartition(partitions(nodes), F.col("grp"), F.expr(f"at div {size}")).sortWithinPartitions("grp", "at")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
        rounds.append(scratch.written(dealt.mapInArrow(_walker(fan, height), f"{schema}, proof {STEP}, above string")))
        nodes = _roots(rounds[-1], size).filter("members > 1")
        if nodes.isEmpty():
            return rounds


def _roots(walked: DataFrame, size: int) -> DataFrame:
    blocks = F.expr(f"(members + {size - 1}) div {size}")
    return walked.filter("above is not null").select("grp", F.expr(f"at div {size}").alias("at"), blocks.alias("members"), F.col("above").alias("digest"))


def tops(rounds: list[DataFrame], fan: int = 3, height: int = 5) -> DataFrame:
    """(grp, digest): what remains of each group."""
    found = [_roots(walked, fan**height).filter("members = 1").select("grp", "digest") for walked in rounds]
    while len(found) > 1:
        found = [found[0].unionByName(found[1]), *found[2:]]
    return found[0]


def descended(rounds: list[DataFrame], heads: DataFrame, fan: int = 3, height: int = 5) -> DataFrame:
    """The first round's nodes with their whole proofs: those of their block and of the blocks above it, then that of their group.

    heads: (grp, head_proof, ...) for each group; its other columns are carried along. A round is
    joined with a table that is smaller by the size of a block.
    """
    size, upper = fan**height, None
    others = [c for c in heads.columns if c not in ("grp", "head_proof")]
    for walked in reversed(rounds):
        ended = _roots(walked, size).filter("members = 1").join(heads, "grp").select("grp", F.col("at").alias("block"), F.col("head_proof").alias("rest"), *others)
        upper = ended if upper is None else ended.unionByName(upper)
        walked = walked.withColumn("block", F.expr(f"at div {size}")).join(upper, ["grp", "block"]).withColumn("proof", F.concat("proof", "rest")).drop("rest", "block")
        upper = walked.select("grp", F.col("at").alias("block"), F.col("proof").alias("rest"), *others)
    return walked.drop("above")


def manifest(
    docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id", keep: Sequence[str] = (), fan: int = 3, height: int = 5
) -> DataFrame:
    """One row a row of docs: its `order` and `group` columns, those named in `keep`, leaf, subroot, root and proof.

    Rows of a group ascend by `order`; every `fan` consecutive nodes (the last run: fewer, even one)
    become one, while a group has several. Groups ascend by their UTF-8 bytes, null first, and give
    the root likewise. `proof` has the siblings left and right of the row's node on each level, from
    its leaf to the root, so that `folded(leaf, proof)` is the root. The rows read tables in the
    shared folder.
    """
    if clash := {*keep} & {order, group, "leaf", "subroot", "root", "proof", "grp", "at", "members", "digest", "above", "block", "rest", "one", "spot", "range", "shift", "head_proof"}:
        raise ValueError(f"columns to keep with names of the result: {sorted(clash)}")
    scratch = Scratch(docs.sparkSession)
    try:
        # The mark before a value sets null apart and puts it first.
        mark = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
        own = [F.col(order).alias("own_order"), F.col(group).alias("own_group"), *keep]
        leaves = scratch.written(docs.select(mark.alias("grp"), leaf(*[F.col(c) for c in fields]).alias("digest"), *own, F.monotonically_increasing_id().alias("one")))
        rounds = climbed(numbered(leaves, ["own_order", "digest", "one"], scratch).drop("one"), scratch, fan, height)
        groups = tops(rounds, fan, height).select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
        above = climbed(numbered(groups, ["name"], scratch), scratch, fan, height)
        root = tops(above, fan, height).select("grp", F.expr(f"cast(array() as {STEP})").alias("head_proof"), F.col("digest").alias("root"))
        heads = descended(above, root, fan, height).select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "root", F.col("proof").alias("head_proof"))
        found = descended(rounds, heads, fan, height)
        named = [F.col("own_order").alias(order), F.col("own_group").alias(group), *keep]
        return Scratch(docs.sparkSession).written(found.select(*named, F.col("digest").alias("leaf"), "subroot", "root", "proof"), keep=True)
    finally:
        scratch.clear()
