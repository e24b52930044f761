"""A stored BM25 index, and the k best documents of each query from it.

The index is made of blocks of documents, each a small inverted index of its own: sorted terms, each
term's postings and its greatest part of a score. So no term, however frequent, is one key, and a
query's work in a block is bounded by the block. Documents are tokenised once, when the index is
built, inside their own rows; a search reads the blocks and the documents' numbers of each term.

Queries go to the blocks in blocks. In a block a query's terms are taken by falling upper bound;
once the terms that are left can't lift a document over the k-th best so far, only the documents
that can still reach it are carried on, and long lists of frequent terms are looked up, not summed.
A block sends k rows a query, so pairs of documents and queries are never made as rows.

Groups (a book's own index, say) have statistics of their own. Terms are named by `hashed.token_ids`.
Null texts are documents without a term; rows that share an id are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import hashed as H
from ..functions import text as T
from ..sources import shared
from . import retrieval

#: A block's tokens, its documents, and a query block's queries.
BLOCK_TOKENS, BLOCK_DOCS, BLOCK_QUERIES = 250_000, 32_768, 512
_CHECK_EVERY, _SLACK = 4, 1e-6
#: Scores of a group whose greatest stands for it when the k-th best is bounded.
_GROUPED = 16
#: Numbers of a list that are added in the time of one look-up, and of all lists in that of a look at each score and what follows from it.
_LOOKUP, _LOOK = 16, 8
#: A term of more than one in so many of a block's documents is a row of numbers; so many terms at most.
_OFTEN, _DENSE = 12, 96


@dataclass
class Index:
    """blocks (g, block, ids, skips, terms, stops, docs, parts, tops), terms (g, term, df), corpus (g, n, avgdl, blocks)."""

    blocks: DataFrame
    terms: DataFrame
    corpus: DataFrame


def _key(value: Any) -> tuple:
    """Values in the order of Spark: null first, structs field by field."""
    if value is None:
        return (0,)
    return (1, *[_key(v) for v in value.values()]) if isinstance(value, dict) else (1, value)


def _lists(columns: dict[str, pa.Array]) -> list[pa.Array]:
    """Each array as the one list of a single row."""
    return [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns.values()]


def _inverted(k1: float, b: float):
    """A block of documents (g, block, doc_id, skip, h, avgdl) as one row with its inverted index; documents stand in order of id."""

    def run(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].combine_chunks()
        plain = ids.to_pylist()
        order = np.array(sorted(range(len(plain)), key=lambda i: _key(plain[i])), np.int64)
        at = pa.array(order)
        hashes = table["h"].combine_chunks().take(at)
        lengths = np.diff(hashes.offsets.to_numpy())
        doc, term = np.repeat(np.arange(len(order), dtype=np.int64), lengths), hashes.values.to_numpy()[: lengths.sum()]
        by = np.argsort(term, kind="stable")  # documents ascend already
        doc, term = doc[by], term[by]
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])) if len(term) else np.empty(0, np.int64)
        tf = np.diff(np.concatenate([first, [len(term)]])).astype(np.float64)
        doc, term = doc[first], term[first]
        avgdl = table["avgdl"][0].as_py() or 0.0
        norm = 1 - b + b * lengths[doc] / avgdl if avgdl > 0 else np.ones(len(doc))
        part = tf * (k1 + 1) / (tf + k1 * norm)
        begin = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, np.int64)
        columns = {
            "ids": ids.take(at),
            "skips": table["skip"].combine_chunks().take(at),
            "terms": pa.array(term[begin]),
            "stops": pa.array(np.concatenate([begin, [len(term)]]).astype(np.int32)),
            "docs": pa.array(doc.astype(np.int32)),
            "parts": pa.array(part),
            "tops": pa.array(np.maximum.reduceat(part, begin) if len(begin) else np.empty(0)),
        }
        keys = [table["g"].slice(0, 1).combine_chunks(), table["block"].slice(0, 1).combine_chunks()]
        return pa.table([*keys, *_lists(columns)], names=["g", "block", *columns])

    return run


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each block with how many of its documents hold them."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            terms, stops = row.column("terms").flatten(), row.column("stops").flatten().to_numpy()
            g = row.column("g").take(pa.array(np.zeros(len(terms), np.int64)))
            yield pa.RecordBatch.from_arrays([g, terms, pa.array(np.diff(stops))], ["g", "term", "df"])


def build(docs: DataFrame, path: str | None = None, group: str | None = None, skip: Column | None = None, doc: str = "doc_id", text: str = "text", k1: float = V.BM25_K1, b: float = V.BM25_B) -> Index:
    """Write the index of docs under a path (default: a fresh one in the shared folder) and open it.

    skip: a whole number that a query can name to leave out the documents that have it.
    """
    spark = docs.sparkSession
    path = path or shared.fresh(spark, "bm25")
    g = F.lit("") if group is None else F.col(group)
    own = F.lit(None).cast("long") if skip is None else skip.cast("long")
    hashes = F.coalesce(H.token_ids(text), F.array().cast("array<long>"))
    once = shared.saved(docs.select(g.alias("g"), F.col(doc).alias("doc_id"), own.alias("skip"), hashes.alias("h"), F.monotonically_increasing_id().alias("one")), f"{path}/tokens")
    size = F.size("h").cast("long")
    count = F.greatest(F.ceil(F.sum(size) / BLOCK_TOKENS), F.ceil(F.count("*") / BLOCK_DOCS)).cast("int")
    corpus = shared.saved(once.groupBy("g").agg(F.count("*").alias("n"), F.avg(size).alias("avgdl"), count.alias("blocks")), f"{path}/corpus")
    dealt = once.join(corpus, "g").withColumn("block", F.pmod(F.xxhash64("one"), F.col("blocks")).cast("int")).drop("one", "n", "blocks")
    kind = once.schema["doc_id"].dataType.simpleString()
    schema = f"g {once.schema['g'].dataType.simpleString()}, block int, ids array<{kind}>, skips array<long>, terms array<long>, stops array<int>, docs array<int>, parts array<double>, tops array<double>"
    blocks = shared.saved(dealt.groupBy("g", "block").applyInArrow(_inverted(k1, b), schema), f"{path}/blocks", 16 << 20)
    sizes = blocks.select("g", "terms", "stops").mapInArrow(_sizes, f"g {once.schema['g'].dataType.simpleString()}, term long, df int")
    terms = sizes.groupBy("g", "term").agg(F.sum("df").alias("df"))
    terms = shared.saved(terms, f"{path}/terms")
    shared.dropped(spark, f"{path}/tokens")
    return Index(blocks, terms, corpus)


def opened(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in ("blocks", "terms", "corpus")])


def _query_rows(table: pa.Table) -> pa.Table:
    """A block of queries (g, qb, query_id, q_skip, terms) as one row."""
    lists = table["t"].combine_chunks()
    pairs = lists.flatten()
    columns = {
        "q_ids": table["query_id"].combine_chunks(),
        "q_skips": table["q_skip"].combine_chunks(),
        "q_stops": pa.array(np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))]).astype(np.int32)),
        "q_terms": pairs.field("term"),
        "q_weights": pairs.field("weight"),
    }
    keys = [table[c].slice(0, 1).combine_chunks() for c in ("g", "qb", "blocks")]
    return pa.table([*keys, *_lists(columns)], names=["g", "qb", "blocks", *columns])


def _least(scores: np.ndarray, k: int) -> float:
    """A number that at least k of more than k scores reach: the k-th greatest of the maxima of groups, where there are many scores."""
    if (wide := len(scores) // _GROUPED) > 4 * k:
        whole = scores[: len(scores) // wide * wide].reshape(-1, wide)
        tops = whole.max(axis=0)
        rest = scores[whole.size :]
        np.maximum(tops[: len(rest)], rest, out=tops[: len(rest)])
        scores = tops
    return float(np.partition(scores, len(scores) - k)[len(scores) - k])


def best_in_block(n: int, spans: list[tuple[int, int]], weights: np.ndarray, tops: np.ndarray, docs: np.ndarray, parts: np.ndarray, barred: np.ndarray | None, k: int, begun: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best of a block's n documents by score and place: all that could be among them are scored in full.

    begun: scores so far, of terms that are not among the spans; they are added to.
    A document's part in the work is a few numbers added and compared; only those that reach the k-th best are put in order.
    """
    total, bound = np.zeros(n) if begun is None else begun, weights * tops
    if barred is not None:
        total[barred] = -np.inf
    rest, carried = float(bound.sum()), None
    ahead = sum(hi - lo for lo, hi in spans)
    for step, i in enumerate(np.argsort(-bound, kind="stable").tolist()):
        lo, hi = spans[i]
        rest -= bound[i]
        ahead -= hi - lo
        # A list that is not much longer than what is carried on is added whole.
        if carried is None or hi - lo < _LOOKUP * len(carried):
            np.add.at(total, docs[lo:hi], weights[i] * parts[lo:hi])
        else:
            at = np.minimum(np.searchsorted(docs[lo:hi], carried), hi - lo - 1)
            met = docs[lo:hi][at] == carried
            total[carried[met]] += weights[i] * parts[lo:hi][at[met]]
        # Looked into only where the lists that are left take longer than a look.
        if carried is None and n > k and step % _CHECK_EVERY == _CHECK_EVERY - 1 and ahead > _LOOK * n:
            least = _least(total, k)
            if rest + _SLACK < least:
                carried = np.flatnonzero(total >= least - rest - _SLACK)
    scored = total if carried is None else total[carried]
    least = _least(scored, k) - _SLACK if len(scored) > k else 0.0
    places = np.flatnonzero(scored >= least) if least > 0 else np.flatnonzero(scored > 0)
    places = places if carried is None else carried[places]
    order = np.lexsort((places, -np.round(total[places], 9)))[:k]
    return places[order], total[places[order]]


def _searcher(k: int):
    """The k best of each query of a block of queries in a block of documents."""

    def cell(row: pa.RecordBatch) -> pa.RecordBatch:
        # One row: each list is the values from its own offset on.
        values = lambda c: row.column(c).flatten()
        of = lambda c: values(c).to_numpy(zero_copy_only=False)
        terms, stops, docs, parts, tops = (of(c) for c in ("terms", "stops", "docs", "parts", "tops"))
        q_stops, q_terms, q_weights = (of(c) for c in ("q_stops", "q_terms", "q_weights"))
        docs = docs.astype(np.int64)
        q_skips, skips, ids = values("q_skips").to_pylist(), values("skips"), values("ids")
        # A query's own documents lie side by side in order of `skip`; those of null are no query's.
        held = np.flatnonzero(np.array(skips.is_valid()))
        own = np.array(skips.fill_null(0))[held]
        by = np.argsort(own, kind="stable")
        held, own = held[by], own[by]
        at = np.minimum(np.searchsorted(terms, q_terms), max(len(terms) - 1, 0))
        known = terms[at] == q_terms if len(terms) else np.zeros(len(q_terms), bool)
        n, asked, places, scores = len(ids), [], [], []
        # Terms of many documents are rows of numbers, multiplied with some queries' weights at a time; the other terms' lists are added query by query.
        wanted = np.unique(at[known])
        share = stops[wanted + 1] - stops[wanted]
        dense = wanted[np.argsort(-share, kind="stable")[: min(_DENSE, int((share > n // _OFTEN).sum()))]]
        table, row_of = np.zeros((len(dense), n)), np.full(len(terms), -1)
        row_of[dense] = np.arange(len(dense))
        for row_, j in zip(table, dense.tolist()):
            row_[docs[stops[j] : stops[j + 1]]] = parts[stops[j] : stops[j + 1]]
        in_table = known & (row_of[at] >= 0) if len(terms) else known
        listed, of_query = known & ~in_table, np.repeat(np.arange(len(q_stops) - 1), np.diff(q_stops))
        together, begun, upto = max(1, min(64, (4 << 20) // max(n, 1))), None, 0
        for i, (lo, hi) in enumerate(zip(q_stops[:-1].tolist(), q_stops[1:].tolist())):
            if len(dense) and i >= upto:
                mine = slice(q_stops[i], q_stops[min(i + together, len(q_stops) - 1)])
                heavy = np.zeros((together, len(dense)))
                heavy[of_query[mine][in_table[mine]] - i, row_of[at[mine][in_table[mine]]]] = q_weights[mine][in_table[mine]]
                begun, upto = heavy @ table, i + together
            if known[lo:hi].any():
                hit = at[lo:hi][listed[lo:hi]]
                barred = held[np.searchsorted(own, q_skips[i], "left") : np.searchsorted(own, q_skips[i], "right")] if q_skips[i] is not None else None
                spans = list(zip(stops[hit].tolist(), stops[hit + 1].tolist()))
                found, score = best_in_block(n, spans, q_weights[lo:hi][listed[lo:hi]], tops[hit], docs, parts, barred, k, None if begun is None else begun[i - upto])
                asked += [i] * len(found)
                places.append(found)
                scores.append(score)
        asked = pa.array(asked, pa.int64())
        g = row.column("g").take(pa.array(np.zeros(len(asked), np.int64)))
        out = [g, values("q_ids").take(asked), ids.take(pa.array(np.concatenate(places or [[]]).astype(np.int64))), pa.array(np.concatenate(scores or [[]]), pa.float64())]
        return pa.RecordBatch.from_arrays(out, ["g", "query_id", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield cell(batch.slice(i, 1))

    return run


def _cells(index: Index, rows: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """A row for each block of queries in each block of documents of its group. rows: g, blocks, query_id, q_skip, t (terms with weights).

    asked: the queries (g), which are counted instead where the rows take long to make.
    """
    sizes = (rows if asked is None else asked).groupBy("g").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("q_blocks"))
    dealt = rows.join(sizes, "g").withColumn("qb", F.pmod(F.xxhash64("query_id", "q_skip"), F.col("q_blocks")).cast("int")).drop("q_blocks")
    g_kind, q_kind = (rows.schema[c].dataType.simpleString() for c in ("g", "query_id"))
    packed = dealt.groupBy("g", "qb").applyInArrow(_query_rows, f"g {g_kind}, qb int, blocks int, q_ids array<{q_kind}>, q_skips array<long>, q_stops array<int>, q_terms array<long>, q_weights array<double>")
    sent = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "qb")
    n = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(n, "g", "block").join(index.blocks.repartition(n, "g", "block"), ["g", "block"])


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of a block that hold each query's one term."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            terms, stops, docs, wanted = (row.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "stops", "docs", "q_terms"))
            at = np.minimum(np.searchsorted(terms, wanted), max(len(terms) - 1, 0))
            hit = np.flatnonzero(terms[at] == wanted) if len(terms) else np.empty(0, np.int64)
            counts = stops[at[hit] + 1] - stops[at[hit]]
            place = np.concatenate([docs[stops[j] : stops[j + 1]] for j in at[hit]] or [[]]).astype(np.int64)
            out = [row.column("q_ids").flatten().take(pa.array(np.repeat(hit, counts))), row.column("ids").flatten().take(pa.array(place))]
            yield pa.RecordBatch.from_arrays(out, ["query_id", "doc_id"])


def holding(index: Index, wanted: DataFrame) -> DataFrame:
    """query_id, doc_id of the documents of a group-less index that hold each query's term (wanted: query_id, term as hash; one row a query)."""
    rows = wanted.select(F.lit("").alias("g"), "query_id", F.lit(None).cast("long").alias("q_skip"), F.array(F.struct("term", F.lit(1.0).alias("weight"))).alias("t")).join(index.corpus.select("g", "blocks"), "g")
    kinds = rows.schema["query_id"].dataType.simpleString(), index.blocks.schema["ids"].dataType.elementType.simpleString()
    return _cells(index, rows).mapInArrow(_holders, "query_id {}, doc_id {}".format(*kinds))


def containing(docs: DataFrame, items: DataFrame, index: Index | None = None, item: str = "item_id") -> DataFrame:
    """query_id, doc_id of documents (doc_id, text) whose text holds an item's whole text; items without text are held by none.

    A word inside an item stands in every document that holds it, so an item meets only the documents
    of its rarest one (index: of the same documents), and those are tested. Items without an inner
    word meet the documents that hold their greatest letter.
    """
    index = index or build(docs)
    q = items.select(F.col(item).alias("query_id"), F.col("text").alias("item_text")).filter(F.length("item_text") > 0)
    # A run at an item's end may go on in the document; inner runs, and pairs of CJK letters, are there as they are.
    inner = F.regexp_replace(F.lower(T.folded("item_text")), "^[a-z0-9]+|[a-z0-9]+$|^[一-鿿](?![一-鿿])|(?<![一-鿿])[一-鿿]$", "")
    each = q.select("query_id", "item_text", F.explode_outer(F.array_distinct(T.tokens(inner))).alias("word")).withColumn("term", F.get(H.token_ids("word"), 0))
    counted = each.join(index.terms.select("term", "df"), "term", "left")
    rarest = counted.groupBy("query_id", "item_text").agg(F.min(F.when(F.col("word").isNotNull(), F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term"))).alias("k"))
    keyed = rarest.filter("k.df > 0").select(F.struct("query_id", "item_text").alias("query_id"), "k.term")
    pairs = holding(index, keyed).select("query_id.*", "doc_id")
    letters = rarest.filter("k is null").select("query_id", "item_text", F.array_max(F.split("item_text", "")).alias("letter"))
    # The letters asked for (an alphabet at most) are looked for in each document; no document is cut into letters.
    wanted = letters.agg(F.collect_set("letter").alias("letters")).scalar()
    asked = docs.select("doc_id", "text", wanted.alias("letters")).select("doc_id", F.filter("letters", lambda x: F.contains(F.col("text"), x)).alias("letters"))
    held = asked.select("doc_id", F.explode("letters").alias("letter"))
    pairs = pairs.unionByName(letters.join(held, "letter").select("query_id", "item_text", "doc_id"))
    return pairs.join(docs.select("doc_id", "text"), "doc_id").filter(F.contains("text", "item_text")).select("query_id", "doc_id")


def search(index: Index, queries: DataFrame, k: int = V.TOP_K, query: str = "query_id", text: str = "text", group: str | None = None, skip: Column | None = None, boost: dict[str, float] | None = None) -> DataFrame:
    """query_id, doc_id, score, rank (and the group as `g`, if given): the k best documents of each query, ties to the smaller doc_id.

    A query's group names its index; documents whose `skip` equals the query's are left out before
    they are ranked. Terms weigh as in `retrieval.query_terms`.
    """
    g = F.lit("") if group is None else F.col(group)
    own = F.lit(None).cast("long") if skip is None else skip.cast("long")
    asked = queries.select(g.alias("g"), F.col(query).alias("query_id"), own.alias("q_skip"), F.col(text).alias("text"))
    each = retrieval.query_terms(asked.select(F.struct("g", "query_id", "q_skip").alias("query_id"), "text"), boost=boost)
    each = each.select("query_id.*", F.get(H.token_ids("term"), 0).alias("term"), "weight").join(index.terms, ["g", "term"]).join(index.corpus, "g")
    weighed = each.select("g", "query_id", "q_skip", "blocks", F.struct("term", (F.col("weight") * retrieval.idf(F.col("df"), F.col("n"))).alias("weight")).alias("t"))
    rows = weighed.groupBy("g", "query_id", "q_skip", "blocks").agg(F.collect_list("t").alias("t"))
    cells = _cells(index, rows, asked)
    q_kind, g_kind = (rows.schema[c].dataType.simpleString() for c in ("query_id", "g"))
    d_kind = index.blocks.schema["ids"].dataType.elementType.simpleString()
    found = cells.mapInArrow(_searcher(k), f"g {g_kind}, query_id {q_kind}, doc_id {d_kind}, score double")
    order = W.partitionBy("g", "query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best if group is not None else best.drop("g")
