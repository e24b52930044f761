"""Language identification with a blended-spectrum string kernel.

A text's features are the letter n-grams of one to three characters that occur in it (presence, not
counts), hashed into a fixed number of dimensions; the kernel of two texts is the number of features
they share over the geometric mean of their numbers. Nystroem's method with landmark texts turns
the kernel into vectors, on which kernel ridge regression is solved one language against the rest.
Landmarks and regression are fitted on a bounded sample of the labelled rows (SAMPLE texts a
language, those with the least hash); prediction covers every whole text, as batched products of
presence matrices with the landmark matrix.

Edge cases: null texts and texts without a letter are `und` with score 0; with no labelled row to
learn from every text is `und`; ties go to the language that sorts first; null and repeated rows
are predicted like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mixed, slices, small_batches, tidy, U64

DIMENSIONS = 8192
#: Texts a language that the model is fitted on, and how many of them are landmarks.
SAMPLE, LANDMARKS = 160, 32
RIDGE = 1e-2
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x DIMENSIONS presence matrix, which texts have a letter)."""
    raw = [np.frombuffer(x.lower().encode("utf-32-le", "surrogatepass"), np.uint32) if x else np.empty(0, np.uint32) for x in texts]
    found = np.zeros((len(texts), DIMENSIONS), bool)
    flat = found.reshape(-1)
    doc = np.repeat(np.arange(len(raw)), [len(r) + 2 for r in raw])
    space = np.full(2, 32, np.uint32)
    chars = np.concatenate([c for r in raw for c in (r, space)]) if raw else np.empty(0, np.uint32)
    chars = np.minimum(chars, 0x10FFFF)
    letter = _letters()[chars]
    c = np.where(letter, chars, 32).astype(U64)
    keep = letter | np.concatenate([[False], letter[:-1]])  # one blank stands for any run of other characters after a letter, wherever the text stands in its batch
    c, doc, letter = c[keep], doc[keep], letter[keep]
    h = np.zeros(len(c), U64)
    for n in range(1, 4):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = h[:m] * U64(0x2127599BF4325C37) + c[n - 1 :]
        same = (doc[:m] == doc[n - 1 :]) & (letter[:m] | letter[n - 1 :])
        flat[doc[:m][same] * DIMENSIONS + (mixed(h[same] + U64(n << 40)) >> U64(51)).astype(np.int64)] = True
    has = np.zeros(len(raw), bool)
    has[doc[letter]] = True
    return found, has


def kernel(x: np.ndarray, landmarks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    own = np.maximum(x.sum(1), 1)
    return (x.astype(np.float32) @ landmarks) / np.sqrt(own[:, None] * sizes[None, :])


class Model:
    """Languages, landmark matrix (DIMENSIONS x m), its feature counts, and m x languages weights."""

    def __init__(self, rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.languages = sorted({lang for lang, _ in rows})
        if not rows:
            return
        x, has = presence([t for _, t in rows])
        rows, x = [r for r, ok in zip(rows, has) if ok], x[has]
        self.languages = sorted({lang for lang, _ in rows})
        if not rows:
            return
        y = np.array([[1.0 if lang == k else -1.0 for k in self.languages] for lang, _ in rows])
        marks = [i for k in self.languages for i in [i for i, (lang, _) in enumerate(rows) if lang == k][:landmarks]]
        self.landmarks = np.ascontiguousarray(x[marks].T.astype(np.float32))
        self.sizes = np.maximum(x[marks].sum(1), 1).astype(np.float64)
        value, vector = np.linalg.eigh(kernel(x[marks], self.landmarks, self.sizes).astype(np.float64))
        use = value > 1e-6 * value[-1]
        root = vector[:, use] / np.sqrt(value[use])
        phi = kernel(x, self.landmarks, self.sizes) @ root
        # Languages count alike, however many rows each has.
        weight = sum((y[:, j] > 0) / max(1, (y[:, j] > 0).sum()) for j in range(y.shape[1])) * len(rows) / y.shape[1]
        solve = phi.T @ (phi * weight[:, None]) + ridge * np.eye(phi.shape[1])
        self.weights = root @ np.linalg.solve(solve, phi.T @ (y * weight[:, None]))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        x, has = presence(texts)
        value = kernel(x, self.landmarks, self.sizes) @ self.weights
        best = value.argmax(1)
        score = np.clip((value[np.arange(len(best)), best] + 1) / 2, 0, 1)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, has)], np.where(has, score, 0.0)


def fit(labelled: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """The model of a bounded sample of labelled (text, lang): the `sample` texts with the least hash in each language."""
    rows = labelled.filter("lang is not null and text is not null and length(text) > 0").select("lang", "text")
    order = W.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    chosen = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample).orderBy("lang", "rank")
    return Model([(r.lang, r.text) for r in chosen.select("lang", "text").toLocalIterator()], landmarks)


def predict(docs: DataFrame, model: Model, text: str | Column = "text") -> DataFrame:
    """All columns of docs and lang_pred, score (replacing columns of these names)."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(model)  # bounded by landmarks, dimensions and languages
    clash = [c for c in docs.columns if c.lower() in ("lang_pred", "score")]
    docs = docs.drop(*clash)
    own = isinstance(text, str) and text in docs.columns and docs.schema[text].dataType.simpleString() == "string"
    at = text if own else "__text"  # texts travel once

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 500, at, 1_000_000):
                languages, score = shipped.value.predict(part.column(at).to_pylist())
                keep = [i for i, n in enumerate(part.schema.names) if own or n != at]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in keep] + [pa.array(languages, pa.string()), pa.array(score, pa.float64())],
                    names=[part.schema.names[i] for i in keep] + ["lang_pred", "score"],
                )

    source = F.col(text) if isinstance(text, str) else text
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    sent = docs if own else docs.withColumn(at, source.cast("string"))
    return sent.mapInArrow(run, f"{fields}, lang_pred string, score double")
