"""Periodic runs of words: stretches that repeat one period at least three times, and texts with each run cut to its first period.

A suffix automaton is built over a document's words. Its states are taken from the longest to the
shortest, and each gives its set of end positions to its suffix link's, the smaller set going into
the larger one. Where an end position comes to stand beside another one in a state of length l, at a
distance d of at most l, the l + d words up to the later one repeat with period d: a seed. A seed
that its next word would extend is dropped; the seed at the run's last word has the run's whole
length, as its state is the longest common suffix of both places.

Only words that a state long enough to seed a run can cover go into automata: stretches of words
that lie in windows which occur more than once in their document. A run lies within one stretch.

Defined results: null and empty texts have no words and no runs; very long texts are taken whole,
about half a kB of memory for each word of their longest repeating stretch; documents are judged one
by one, so null ids, repeated rows and hot sources are nothing special; an empty table has no rows;
columns other than those named are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed, slices, small_batches, split_words, tidy, window_hashes

RUN = "struct<start: long, length: long, period: long>"
_RUN = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])


def seed_length(least: int, times: int) -> int:
    """The least length of a state from which a run is seeded, over all periods."""
    return min(max(least - d, (times - 1) * d) for d in range(1, least + 1))


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton: each state's suffix link, length, and the end position that it brings itself (-1: none)."""
    go: list[dict[int, int]] = [{}]
    link, length, own, last = [-1], [0], [-1], 0
    for i, c in enumerate(words):
        new, p = len(go), last
        go.append({})
        link.append(0)
        length.append(i + 1)
        own.append(i)
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] != length[p] + 1:  # the shorter strings of q end here too and get a state of their own
                twin = len(go)
                go.append(go[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                own.append(-1)
                link[q] = twin
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                q = twin
            link[new] = q
        last = new
    return link, length, own


def neighbours(words: list[int], shortest: int) -> Iterator[tuple[int, int, int]]:
    """(earlier, later, length): end positions that come to stand beside each other in a state of that length, at least `shortest`."""
    link, length, own = automaton(words)
    # Ends are held negated: the end that a state brings itself is its first, so it goes to the list's end.
    ends: list[list[int] | None] = [[-e] if e >= 0 else None for e in own]
    for state in np.argsort(-np.array(length), kind="stable").tolist():
        mine, to = ends[state], link[state]
        ends[state] = None
        if mine is None or to < 0 or length[to] < shortest:
            continue
        large, small = ends[to], mine
        if large is None:
            ends[to] = small
            continue
        if len(large) < len(small):
            large, small = small, large
        # Only a place of either set: two of one set met in a longer state, which is their longest common suffix.
        for end in small:
            at = bisect_left(large, end)
            if at:
                yield -end, -large[at - 1], length[to]
            if at < len(large):
                yield -large[at], -end, length[to]
        for end in small:
            insort(large, end)
        ends[to] = large


def repeating(hashes: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """The stretches [first, stop) of words in windows of that length which occur more than once."""
    windows = window_hashes(hashes, shortest)
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    deep = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(deep, np.flatnonzero(twice), 1)
    np.add.at(deep, np.flatnonzero(twice) + shortest, -1)
    covered = np.concatenate([[False], np.cumsum(deep)[:-1] > 0, [False]])
    turns = np.flatnonzero(covered[1:] != covered[:-1])
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


def runs_of(codes: np.ndarray, hashes: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of a document's runs, by start and then period: length >= max(least, times * period)."""
    found: dict[tuple[int, int], int] = {}
    shortest = seed_length(least, times)
    for first, stop in repeating(hashes, shortest) if len(codes) >= least else ():
        words = codes[first:stop].tolist()
        after = int(codes[stop]) if stop < len(codes) else None
        for early, late, length in neighbours(words, shortest):
            d = late - early
            if length + d < max(least, times * d):
                continue
            follows = words[late + 1] if late + 1 < len(words) else after
            if follows is not None and follows == words[early + 1]:
                continue  # the run goes on, and a later seed has all of it
            # Sets that are not whole yet may set multiples of a period beside each other: the same stretch, a larger distance.
            key = (first + late - length - d + 1, length + d)
            found[key] = min(d, found.get(key, d))
    return sorted((start, length, d) for (start, length), d in found.items())


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, exactly; ties: smallest start, then period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for words that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def _finder(least: int, times: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        begin, codes, vocabulary = split_words(batch.column("text"))
        names = hashed(vocabulary)
        found, best, kept = [], [], np.ones(len(codes), bool)
        for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist()):
            own = codes[lo:hi]
            runs = runs_of(own, names[own], least, times) if hi - lo >= least else []
            found.append(runs)
            best.append(strongest(runs))
            if runs:
                kept[lo:hi] = kept_words(hi - lo, runs)
        upto = np.concatenate([[0], np.cumsum(kept)])[begin]
        words = pa.array(vocabulary, pa.binary()).take(pa.array(codes[kept], pa.int64()))
        collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), words), b" ")
        as_rows = lambda runs: [dict(zip(("start", "length", "period"), run)) for run in runs]
        columns = {
            **{name: batch.column(name) for name in batch.schema.names if name != "text"},
            "n_words": pa.array(np.diff(begin), pa.int64()),
            "runs": pa.array([as_rows(runs) for runs in found], pa.list_(_RUN)),
            "strongest": pa.array([as_rows([run])[0] if run else None for run in best], _RUN),
            "collapsed_text": collapsed.cast(pa.string()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, text="text"):
                yield part(some)

    return tidy(run)


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """(doc_id, n_words, runs, strongest, collapsed_text) for each row of docs.

    A run is a stretch of consecutive words `[^\\x20\\x09-\\x0D]+` with smallest period q and length of
    at least max(least, times * q) that no neighbouring word extends keeping the period; runs are sorted
    by start, then period. collapsed_text has the words, joined by one space, that no run holds after
    its first q words. No rows are shuffled.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(_finder(least, times), f"doc_id {kind}, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed_text string")
