"""JSON objects in texts that aren't quite JSON: fenced, with prose around them, or with quotes left bare inside a value.

`found` takes the text without its fences, if that is an object; else the first brace at which an
object stands, as it is or once the bare quotes from there on (or up to the brace that closes it)
are escaped. Intact JSON is never rewritten. A text that is JSON but no object has none. What is
found is JSON text, so that `from_json` reads it with any schema and the parsing stays with Spark.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import fixed as V

FOUND = StructType([StructField("json", StringType()), StructField("how", StringType())])
_DECODER = json.JSONDecoder()
_FENCE = re.compile(V.JSON_FENCE, re.MULTILINE)
#: Inside a string only a backslash's pair and a quote matter; outside only quotes and braces do.
_INSIDE, _OUTSIDE = re.compile(r'\\.|"', re.DOTALL), re.compile(r'["{}]')
#: What may follow a quote that ends a string.
_ENDS = re.compile(r"[ \t\r\n]*(?:[:,}\]]|\Z)")


def _object_at(text: str, at: int) -> tuple[str | None, bool]:
    """The JSON object that begins at that brace, if there is a legal one; else whether something like one does."""
    try:
        return text[at : _DECODER.raw_decode(text, at)[1]], True
    except json.JSONDecodeError as e:
        return None, e.pos > at + 1
    except RecursionError:
        return None, False


def string_end(text: str, at: int) -> int:
    """The place of the quote that ends the string whose content begins at `at`, or -1."""
    while m := _INSIDE.search(text, at):
        if m[0] == '"':
            return m.start()
        at = m.end()
    return -1


def balanced(text: str, at: int) -> str | None:
    """The stretch from the brace at `at` to the one that closes it; braces in strings don't count."""
    depth, here = 0, at
    while m := _OUTSIDE.search(text, here):
        here = m.end()
        if m[0] == '"':
            here = string_end(text, here) + 1
            if not here:
                return None
        else:
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return text[at:here]
    return None


def escaped(text: str) -> str:
    """text with a backslash before each quote in a string that nothing of JSON's structure follows."""
    bare: list[int] = []
    here = text.find('"') + 1
    while here and (end := string_end(text, here)) >= 0:
        if _ENDS.match(text, end + 1):
            here = text.find('"', end + 1) + 1
        else:
            bare.append(end)
            here = end + 1
    cuts = [0, *bare, len(text)]
    return "\\".join(text[a:b] for a, b in zip(cuts, cuts[1:]))


def loose_object(text: str | None) -> tuple[str | None, str | None]:
    """(json, how) of the first object of a text: whole, embedded or repaired; (None, None) without one."""
    bare = _FENCE.sub("", (text or "").strip()).strip()
    try:
        whole = json.loads(bare)
    except (ValueError, RecursionError):
        pass
    else:
        return (bare, "whole") if isinstance(whole, dict) else (None, None)
    at = bare.find("{")
    while at >= 0:
        found, begun = _object_at(bare, at)
        if found:
            return found, "embedded"
        for part in (bare[at:], balanced(bare, at)) if begun else ():
            if part and (found := _object_at(escaped(part), 0)[0]):
                return found, "repaired"
        at = bare.find("{", at + 1)
    return None, None


@F.pandas_udf(FOUND)
def _found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([loose_object(t) for t in batch], columns=["json", "how"])


def found(text: Column | str) -> Column:
    """struct(json, how): the first JSON object of a text and how it was found; nulls without one."""
    return _found(F.col(text) if isinstance(text, str) else text)


def read(text: Column | str, schema: str) -> Column:
    """The first JSON object of a text by that schema; null without one."""
    return F.from_json(found(text)["json"], schema)
