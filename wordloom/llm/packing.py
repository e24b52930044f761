"""Best-fit-decreasing packing of token ids with a segment tree over remaining capacities.

Documents are tokenised, closed by a separator id, and cut into full windows plus one remainder.
Remainders of one shard (a hash of document and start; shards are of a bounded number of
documents, so their number follows the input) arrive longest first; a segment tree indexed by
remaining capacity gives the tightest open window that still holds the piece, else a new window
is opened. Full windows need no search. Each shard is one task of its own.

Edge cases: null text is an empty document (just the separator); an empty table gives no row;
repeated rows are packed as often as they occur; a null id stays null; texts of any length are
tokenised whole, a few megabytes of texts at a time.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, split_words, tidy

WINDOW = 4096
SEPARATOR = 2
#: Documents a shard: bounds what one task packs.
SHARD_DOCUMENTS, SHARD_BYTES = 16_000, 64 << 20
_TOKENIZERS: dict[str, "ChunkTokenizer"] = {}


class ChunkTokenizer:
    """Ids of whole texts by a `tokenizers` file whose pre-tokens never hold an ASCII blank.

    A text's ids are then the ids of its blank-separated chunks in order, so each distinct chunk
    is encoded once and kept; the store is emptied at `limit` chunks, which bounds memory. Where
    the file is a lower-casing byte-level BPE with word ends, plain chunks are merged by
    tiktoken's faster loop over the same vocabulary; all others go to the library itself.
    """

    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.merge = self._merger(path)
        self.clear()

    @staticmethod
    def _merger(path: str):
        """chunk -> ids for plain chunks (None for others), or None if the file is of another kind."""
        import regex
        import tiktoken

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        if model.get("end_of_word_suffix") != "</w>" or kinds != ["NFC", "Replace", "Lowercase"] or split.get("behavior") != "Removed":
            return None
        # The printable stand-ins of bytes: printable Latin-1 for itself, the others from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        end = 0xFF  # never a byte of UTF-8: stands for a word's end
        ranks = {bytes([b, end]): b for b in range(256)} | {bytes([b]): 256 + b for b in range(256)}
        ids = np.zeros(512 + len(model["merges"]), np.uint32)
        raw = lambda t: bytes(byte_of[c] for c in t.removesuffix("</w>")) + bytes([end]) * t.endswith("</w>")
        for token, i in model["vocab"].items():
            if len(t := token.removesuffix("</w>")) == 1:
                ids[ranks[raw(token)]] = i
        for n, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks[raw(a + b)] = 512 + n
            ids[512 + n] = model["vocab"][a + b]
        core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        ids, parts = ids.tolist(), regex.compile(split["pattern"]["Regex"]).findall
        simple = regex.compile(r"[!-;=-~\u00c0-\u024f]+").fullmatch  # no '<': special tokens start with it

        def merge(chunk: str) -> list[int] | None:
            if not simple(chunk):
                return None
            return [ids[r] for p in parts(chunk.lower()) for r in core(p.encode() + b"\xff")] if "\u0130" not in chunk else None

        return merge

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.pool = np.empty(1 << 20, np.uint32)
        self.size = 0
        self.begin = np.zeros(1 << 16, np.int64)

    @classmethod
    def at(cls, path: str) -> "ChunkTokenizer":
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = cls(path)
        return _TOKENIZERS[path]

    def _learn(self, new: list[bytes]) -> None:
        chunks = [c.decode("utf-8", "surrogatepass") for c in new]
        ids = list(map(self.merge, chunks)) if self.merge else [None] * len(new)
        other = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(other, self.tokenizer.encode_batch_fast([chunks[i] for i in other], add_special_tokens=False)):
            ids[i] = x.ids
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        at, n, size = self.size, len(self.index), int(lengths.sum())
        if at + size > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.empty(max(at, 2 * size), np.uint32)])
        if n + len(new) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.empty(len(self.begin) + len(new), np.int64)])
        self.pool[at : at + size] = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, size)
        self.begin[n + 1 : n + 1 + len(new)] = at + np.cumsum(lengths)
        self.size = at + size
        self.index.update(zip(new, range(n, n + len(new))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(begin, ids): text i has ids[begin[i]:begin[i + 1]]; null has none."""
        begin, codes, vocabulary = split_words(texts)
        if len(self.index) > self.limit:
            self.clear()
        known = self.index
        new = [w for w in vocabulary if w not in known]
        for i in range(0, len(new), 20_000):
            self._learn(new[i : i + 20_000])
        w = np.fromiter(map(known.__getitem__, vocabulary), np.int64, len(vocabulary))[codes] if len(codes) else np.empty(0, np.int64)
        start, length = self.begin[w], self.begin[w + 1] - self.begin[w]
        total = np.concatenate([[0], np.cumsum(length)])
        pick = np.arange(total[-1]) + np.repeat(start - total[:-1], length)
        return total[begin], self.pool[pick]


class TightestWindow:
    """Open windows by remaining capacity; a segment tree of maxima finds the least capacity that suffices."""

    def __init__(self, window: int):
        self.window, self.base = window, 1 << window.bit_length()
        self.tree = bytearray(2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _set(self, capacity: int, on: int) -> None:
        i, tree = capacity + self.base, self.tree
        tree[i] = on
        while i > 1:
            i >>= 1
            on = tree[2 * i] | tree[2 * i + 1]
            if tree[i] == on:
                break
            tree[i] = on

    def take(self, length: int) -> tuple[int, int] | None:
        """(window, its remaining capacity) of the tightest open one, which leaves the store."""
        i, tree = length + self.base, self.tree
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        capacity = i - self.base
        found = self.open[capacity].pop()
        if not self.open[capacity]:
            self._set(capacity, 0)
        return found, capacity

    def put(self, window: int, capacity: int) -> None:
        if capacity:
            if not self.open[capacity]:
                self._set(capacity, 1)
            self.open[capacity].append(window)


def _pieces(path: str, window: int, separator: int, payload: bool):
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * payload)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ChunkTokenizer.at(path)
        for batch in batches:
            for part in slices(batch, text="text"):
                out: list[tuple] = []
                begin, tokens = tokenizer.encode(part.column(1))
                for i, doc in enumerate(part.column(0).to_pylist()):
                    ids = np.append(tokens[begin[i] : begin[i + 1]], np.uint32(separator))
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        raw = piece.astype("<u4").tobytes()
                        row = (doc, start, len(piece), zlib.crc32(raw), len(ids))
                        out.append(row + ((piece.astype("<u2").tobytes() if tokenizer.tokenizer.get_vocab_size() <= 65536 else raw),) * payload)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return run, ", ".join(["doc_id long, start long, length long, ids_crc32 long, doc_tokens long"] + ["ids binary"] * payload)


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, separator: int = SEPARATOR, payload: bool = False) -> tuple[DataFrame, int]:
    """(pieces of all documents, at most `window` ids each: doc_id, start, length, ids_crc32, doc_tokens, shard[, ids]; number of shards)."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("bytes")).first()
    shards = max(1, -(-size.n // SHARD_DOCUMENTS), -(-size.bytes // SHARD_BYTES))
    run, schema = _pieces(tokenizer, window, separator, payload)
    cut_up = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return cut_up.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards))), shards


def _sorted_shards(found: DataFrame, shards: int) -> DataFrame:
    """One partition a shard, so that no task gets more than a shard however many partitions a session shuffles into."""
    return found.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", F.desc("length"), "doc_id", "start", "ids_crc32")


class _Packer:
    """Places pieces as they come, longest first, shard after shard."""

    def __init__(self, window: int):
        self.window, self.shard = window, None

    def place(self, shard: int, length: int) -> tuple[int, int]:
        """(sequence_id, offset)."""
        if shard != self.shard:
            self.shard, self.made, self.store = shard, 0, TightestWindow(self.window)
        if length < self.window and (found := self.store.take(length)):
            local, capacity = found
        else:
            local, capacity = self.made, self.window
            self.made += 1
        self.store.put(local, capacity - length)
        return (shard << 40) | local, self.window - capacity


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, separator: int = SEPARATOR) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(window)
        for batch in batches:
            placed = [packer.place(s, n) for s, n in zip(batch.column("shard").to_pylist(), batch.column("length").to_pylist())]
            seq, off = zip(*placed) if placed else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in schema.names[:5]] + [pa.array(seq, pa.int64()), pa.array(off, pa.int64())], schema=schema)

    return _sorted_shards(*pieces(docs, tokenizer, window, separator)).mapInArrow(run, ", ".join(f"{n} long" for n in schema.names))


def matrices(docs: DataFrame, tokenizer: str, window: int = WINDOW, separator: int = SEPARATOR) -> DataFrame:
    """One row per packed sequence, ready to be written as training input.

    sequence_id; n_tokens; input_ids: the ids padded with `separator` to `window`, little-endian
    unsigned 16-bit (32-bit for vocabularies beyond 65,536); position_ids: as wide, starting again
    at 0 with each segment and in the padding; cu_seqlens: cumulative segment lengths from 0;
    doc_ids and starts: each segment's document and its place there; ids_crc32 of the unpadded ids
    as 32-bit. Only the open windows of one shard are held in memory.
    """
    schema = pa.schema(
        [("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("input_ids", pa.binary()), ("position_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("ids_crc32", pa.int64())]
    )

    def row(sequence: int, parts: list[tuple]) -> tuple:
        width = len(parts[0][3]) // parts[0][2]
        kind = np.dtype("<u2" if width == 2 else "<u4")
        ids = np.frombuffer(b"".join(p[3] for p in parts), kind)
        lengths = [p[2] for p in parts]
        edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        full, places = np.full(window, separator, kind), np.arange(window)
        full[: len(ids)] = ids
        places[: len(ids)] -= np.repeat(edges[:-1], lengths)
        places[len(ids) :] -= len(ids)
        return sequence, len(ids), full.tobytes(), places.astype(kind).tobytes(), edges, [p[0] for p in parts], [p[1] for p in parts], zlib.crc32(ids.astype("<u4").tobytes())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, shard, out = _Packer(window), {}, None, []

        def sent(least: int) -> Iterator[pa.RecordBatch]:
            if len(out) >= least and out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
                out.clear()

        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in ("shard", "doc_id", "start", "length", "ids")]
            for s, doc, start, length, ids in zip(*cols):
                if s != shard:
                    for k in list(held):
                        out.append(row(k, held.pop(k)))
                        yield from sent(256)
                    shard = s
                sequence, offset = packer.place(s, length)
                held.setdefault(sequence, []).append((doc, start, length, ids))
                if offset + length == window:
                    out.append(row(sequence, held.pop(sequence)))
                    yield from sent(256)
        for k in list(held):
            out.append(row(k, held.pop(k)))
            yield from sent(256)
        yield from sent(1)

    found = _sorted_shards(*pieces(docs, tokenizer, window, separator, payload=True))
    return found.mapInArrow(
        run,
        "sequence_id long, n_tokens long, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>, ids_crc32 long",
    )
