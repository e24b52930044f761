"""Token ids: whole numbers that name `text.tokens` of a text, made by one kernel over batches of texts."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_CJK, _LATIN = 1, 2
#: Characters that are taken at a time, whatever the batch.
_CHARS = 1 << 15


@lru_cache(maxsize=2)
def _tables(through: tuple[str, str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(folded and lower-cased code, kind) of each code point, as `text.folded` and `lower` have it; other marks are of kind 0.

    through: letters of a lower-cased text and what each is taken for, before it is folded.
    """
    code = np.arange(0x110000, dtype=np.int64)
    code[0xFF01 : 0xFF01 + 94] = np.arange(0x21, 0x21 + 94)
    code[0x212A] = ord("k")  # the Kelvin sign, the one other letter whose small form is a-z alone
    code += 32 * ((code >= ord("A")) & (code <= ord("Z")))
    if through:
        # Only these letters are themselves in small form or have it by `lower`; full-width ones become Latin after.
        for a, b in zip(*through):
            code[[ord(x) for x in {a, a.upper(), *("\u212a" if a == "k" else "")}]] = code[ord(b)]
    kind = np.zeros(len(code), np.uint8)
    kind[(code >= 0x4E00) & (code <= 0x9FFF)] = _CJK
    kind[((code >= ord("a")) & (code <= ord("z"))) | ((code >= ord("0")) & (code <= ord("9")))] = _LATIN
    return code, kind


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _of(texts: list[str], through: tuple[str, str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many of each text): pairs and single CJK letters by their codes, Latin runs by 63 hashed bits below zero."""
    code, kind = _tables(through)
    texts = [x.replace("İ", "i̇") if "İ" in x else x for x in texts]
    # A line feed stands before, between and after texts, so no token goes beyond one.
    c = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    k, c = kind[c], code[c]
    cjk, ids, is_one = k == _CJK, np.zeros(len(c), np.int64), np.zeros(len(c), bool)
    pair = cjk[:-1] & cjk[1:]
    is_one[:-1] = pair
    ids[:-1][pair] = (c[:-1][pair] << 21) | c[1:][pair]
    single = np.flatnonzero(cjk[1:-1] & ~cjk[:-2] & ~cjk[2:]) + 1
    is_one[single], ids[single] = True, c[single]
    if len(at := np.flatnonzero(k == _LATIN)):
        first = np.flatnonzero(k[at - 1] != _LATIN)
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        runs = np.add.reduceat(_mixed((c[at] | (place + 1 << 21)).astype(np.uint64)), first)
        is_one[at[first]], ids[at[first]] = True, (runs | np.uint64(1 << 63)).view(np.int64)
    stops = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
    places = np.flatnonzero(is_one)
    return ids[places], np.diff(np.searchsorted(places, stops + 1), prepend=0)


def _distinct(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, at = [], 0
    for n in sizes.tolist():
        x = np.sort(ids[at : at + n])
        out.append(x[np.append(True, x[1:] != x[:-1])] if n else x)
        at += n
    return np.concatenate(out), np.array([len(x) for x in out], np.int64)


def _kernel(distinct: bool, through: tuple[str, str] | None = None):
    def run(texts: pa.Array) -> pa.Array:
        ids, sizes, held, chars = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [], 0

        def done() -> None:
            found = _of(held, through)
            a, b = _distinct(*found) if distinct else found
            ids.append(a)
            sizes.append(b)

        for x in texts:
            held.append(x.as_py() or "")
            chars += len(held[-1])
            if chars >= _CHARS:
                done()
                held, chars = [], 0
        if held:
            done()
        offsets = np.append(0, np.cumsum(np.concatenate(sizes))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)), mask=texts.is_null() if texts.null_count else None)
        return lists

    return run


def token_ids(text: Column | str, distinct: bool = False, through: tuple[str, str] | None = None) -> Column:
    """The ids of a text's tokens in order, or each once in order of the ids; null of a null text.

    Two tokens have the same id if they are the same (Latin runs but for a chance of 2**-63).
    through: (ASCII letters and marks in small form, what each is taken for): as of `translate(lower(text), *through)`, which is not made.
    """
    return F.arrow_udf(_kernel(distinct, through), "array<bigint>")(text)
