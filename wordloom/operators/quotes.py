"""Quotes as evidence: where a quote stands in its chapter, and the audit of a narrative's quotes."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as T

PLACE = "struct<start:int,stop:int,level:int>"


@lru_cache(maxsize=1 << 16)
def _fold(char: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKC", char) if not x.isspace())


@lru_cache(maxsize=1)
def _folds() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, size, letters, loose): each code point's folded letters are `size` of the `letters` from `first` on; which letters are loose marks."""
    # Planes from the third on fold to themselves.
    known = [_fold.__wrapped__(chr(i)) for i in range(0x30000)]
    size = np.ones(0x110000, np.int32)
    size[: len(known)] = [len(x) for x in known]
    rest = np.arange(0x30000, 0x110000, dtype=np.uint32)
    letters = np.concatenate([np.array([ord(c) for x in known for c in x], np.uint32), rest])
    loose = np.zeros(0x110000, bool)
    loose[[ord(x) for x in V.LOOSE_MARKS]] = True
    return (np.cumsum(size, dtype=np.int64) - size).astype(np.int32), size, letters, loose


class _Chapter:
    """A chapter's folded form (NFKC of each character, without blanks) and the same without marks, with the place of each letter.

    Both are made, by table, only when the exact text doesn't settle a quote.
    """

    def __init__(self, text: str):
        self.text, self._forms = text, {}

    def _letters(self, marks: bool) -> tuple[np.ndarray, np.ndarray]:
        if marks not in self._forms:
            first, size, letters, loose = _folds()
            if marks:
                codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
                sizes = size[codes]
                stops = np.cumsum(sizes)
                at = np.repeat(first[codes] - (stops - sizes), sizes) + np.arange(sizes.sum())
                out = letters[at], np.repeat(np.arange(len(codes), dtype=np.int32), sizes)
            else:
                found, places = self._letters(True)
                kept = ~loose[found]
                out = found[kept], places[kept]
            self._forms[marks] = out
        return self._forms[marks]

    def form(self, marks: bool) -> tuple[str, np.ndarray]:
        if (marks, "text") not in self._forms:
            found, places = self._letters(marks)
            self._forms[marks, "text"] = found.tobytes().decode("utf-32-le", "surrogatepass"), places
        return self._forms[marks, "text"]

    def place(self, quote: str) -> dict | None:
        quote = quote.strip()
        if not quote:
            return None
        if self.text.count(quote) == 1:
            start = self.text.index(quote)
            return {"start": start, "stop": start + len(quote), "level": 1}
        for level, marks in ((2, True), (3, False)):
            wanted = "".join(x for c in quote for x in _fold(c) if marks or x not in V.LOOSE_MARKS)
            if len(wanted) < (1 if marks else V.LOOSE_CHARS):
                return None
            form, places = self.form(marks)
            if form.count(wanted) == 1:
                at = form.index(wanted)
                return {"start": int(places[at]), "stop": int(places[at + len(wanted) - 1]) + 1, "level": level}
        return None


def _placed(texts: pa.Array, quotes: pa.Array) -> pa.Array:
    out = []
    for text, asked in zip(texts, quotes):
        chapter = _Chapter(text.as_py() or "")
        out.append([chapter.place(x or "") for x in asked.as_py() or []])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("level", pa.int32())])))


def placed(text: Column | str, quotes: Column | str) -> Column:
    """For each of the quotes its start, stop and level in the text, or null where it has no single place.

    Level 1 is the exact text, 2 the folded one, 3 the folded one without marks (four letters at
    least). Only a quote that occurs once at its level is placed; offsets are those of the text as
    it is. Null quotes, blank ones and null texts place nothing.
    """
    return F.arrow_udf(_placed, f"array<{PLACE}>")(text, quotes)


def audited(rows: DataFrame, narrative: str, text: str) -> DataFrame:
    """rows, cleaned, anchors (start, stop, chars of each placed quote in order), removed, unplaced.

    A quote over the limit goes, one that has no single place becomes the placeholder, others stay
    and become anchors. A null narrative is an empty one.
    """
    asked = rows.withColumn("_q", T.quotes(F.coalesce(F.col(narrative), F.lit(""))))
    asked = asked.withColumn("_p", placed(F.col(text), F.transform("_q", lambda x: F.when(F.length(x) <= V.MAX_QUOTE_CHARS, x))))
    each = F.zip_with("_q", "_p", lambda x, p: F.struct(x.alias("quote"), p.alias("place"), (F.length(x) > V.MAX_QUOTE_CHARS).alias("long")))
    asked = asked.withColumn("_e", each)

    def step(done: Column, e: Column) -> Column:
        instead = F.when(e["long"], "").otherwise(V.PLACEHOLDER)
        curly, plain = (F.concat(F.lit(a), e["quote"], F.lit(b)) for a, b in ("“”", '""'))
        return F.when(e["place"].isNotNull(), done).otherwise(F.replace(F.replace(done, curly, instead), plain, instead))

    cleaned = T.stripped(F.regexp_replace(F.aggregate("_e", F.coalesce(F.col(narrative), F.lit("")), step), r"(?U)\s{2,}", " "))
    anchors = F.transform(F.filter("_e", lambda e: e["place"].isNotNull()), lambda e: F.struct(e["place"]["start"].alias("start"), e["place"]["stop"].alias("stop"), F.length(e["quote"]).alias("chars")))
    out = asked.withColumn("anchors", anchors).withColumn("removed", F.size(F.filter("_e", lambda e: e["long"])))
    out = out.withColumn("unplaced", F.size(F.filter("_e", lambda e: ~e["long"] & e["place"].isNull())))
    note = F.format_string(" （含 %d 处可复核短引，坐标见本章锚点表）", F.size("anchors"))
    return out.withColumn("cleaned", F.when(F.size("anchors") > 0, F.concat(cleaned, note)).otherwise(cleaned)).drop("_q", "_p", "_e")
