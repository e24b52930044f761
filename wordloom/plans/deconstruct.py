"""Whole analyses as one lazy plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import chapters, gates, style


def deconstruct(books: DataFrame, first: int = 0) -> dict[str, DataFrame]:
    """books (book, text): chapters, warnings, measures and structure; `first` limits the chapters when given."""
    found = chapters.split(books)
    if first:
        found = found.filter(found.pos < first)
    measured = chapters.measures(found, "book", "pos", "ord", "title")
    return {"chapters": found, "warnings": chapters.warnings(found), "measures": measured, "structure": chapters.structure(measured)}


def reviewed(written: DataFrame, summaries: DataFrame | None = None) -> dict[str, DataFrame]:
    """written (book, ord, text): gate verdicts (with drift), style findings and fingerprints."""
    prints = style.fingerprint(written, "book", "ord")
    drift = style.drift(prints)
    return {"gates": gates.check(written, drift, summaries=summaries), "style": style.findings(written, "book", "ord"), "fingerprints": prints, "drift": drift}
