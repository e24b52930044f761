"""Chapter transactions: which attempt of a chapter is kept, and what the store holds when it is committed or rolled back.

The attempts of all chapters are one table; a chapter's few attempts are folded by one expression
that carries the state of its transaction, so any number of chapters is one shuffle of narrow rows.
Texts join the outcome at the end and only those of the attempts that are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as T
from . import ledger

KEYS = ["book", "ord"]
_ATTEMPT = "struct<attempt: int, verdict: string, findings: int, flagged: boolean, error: string>"
_STATE = f"struct<used: int, open: boolean, styled: boolean, reviewed: boolean, verdict: string, error: string, best: {_ATTEMPT}>"


def _step(budget: int, findings_allowed: int):
    """The state after one more attempt."""

    def step(s: Column, a: Column) -> Column:
        passed, repair = F.coalesce(a["verdict"] == "pass", F.lit(False)), F.coalesce(a["verdict"] == "repair", F.lit(False))
        best = s["best"]
        fewer = (a["findings"] < best["findings"]) | ((a["findings"] == best["findings"]) & best["flagged"] & ~a["flagged"])
        style = passed & (a["findings"] > findings_allowed) & ~s["styled"]
        review = passed & a["flagged"] & ~s["reviewed"]
        again = (repair | style | review) & (s["used"] + 1 < budget)
        error = F.when(a["verdict"].isNull(), F.coalesce(a["error"], F.lit(V.WRITER_FAILED))).when(~passed & ~repair, F.lit(V.GATE_REJECTED))
        after = F.struct(
            (s["used"] + 1).alias("used"),
            again.alias("open"),
            (s["styled"] | style).alias("styled"),
            (s["reviewed"] | review).alias("reviewed"),
            F.coalesce(a["verdict"], s["verdict"]).alias("verdict"),
            error.alias("error"),
            F.when(passed & (best.isNull() | fewer), a).otherwise(best).alias("best"),
        )
        return F.when(s["open"], after.cast(_STATE)).otherwise(s)

    return step


def settled(attempts: DataFrame, max_repairs: int = V.MAX_REPAIRS, findings_allowed: int = V.STYLE_FINDINGS) -> DataFrame:
    """book, ord, status, attempts (used), chosen, verdict, findings, error of each chapter's transaction.

    attempts (book, ord, attempt from 1, verdict, findings, flagged, error): what the writer gave in
    each round and what the gate, the style check and its own review said; a null verdict is a writer
    that failed. A round that needs repair is followed by another, max_repairs at most; one that
    passes is followed by another once for its style and once for its review. The best passing round
    is kept: fewest findings, then not flagged, then the first. Rounds that no transaction reaches
    are not read. committed: a round passed; failed: none did, and the writer failed or the gate
    rejected; rolled_back: none did within the budget; in_progress: the next round isn't there yet.
    Of repeated rows of a round the one with the fewest findings counts.
    """
    if max_repairs < 0:
        raise ValueError(f"max_repairs is {max_repairs}")
    budget = max_repairs + 1
    row = F.struct(F.col("attempt").cast("int").alias("attempt"), "verdict", F.coalesce(F.col("findings").cast("int"), F.lit(0)).alias("findings"), F.coalesce("flagged", F.lit(False)).alias("flagged"), F.col("error").cast("string").alias("error"))
    one = attempts.filter(F.col("attempt").between(1, budget)).select(*KEYS, row.cast(_ATTEMPT).alias("a"))
    one = one.groupBy(*KEYS, F.col("a.attempt").alias("attempt")).agg(F.min_by("a", F.struct(F.col("a.findings"), F.col("a.flagged"), F.col("a.verdict"))).alias("a"))
    rounds = one.groupBy(*KEYS).agg(F.array_sort(F.collect_list("a")).alias("rounds"))
    # A gap ends what is known: only rounds that follow each other from the first are folded.
    known = F.filter("rounds", lambda a, i: a["attempt"] == i + 1)
    start = F.struct(F.lit(0), F.lit(True), F.lit(False), F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast(_ATTEMPT)).cast(_STATE)
    s = F.col("s")
    status = F.when(s["open"], "in_progress").when(s["best"].isNotNull(), "committed").when(s["error"].isNotNull(), "failed").otherwise("rolled_back")
    found = rounds.select(*KEYS, F.aggregate(known, start, _step(budget, findings_allowed)).alias("s")).withColumn("status", status)
    kept = F.col("status") == "committed"
    verdict = F.when(kept, "pass").when(~s["open"], F.coalesce(s["verdict"], F.lit("reject")))
    error = F.when(F.col("status") == "rolled_back", F.lit(V.BUDGET_SPENT)).when(F.col("status") == "failed", s["error"])
    return found.select(*KEYS, "status", s["used"].alias("attempts"), F.when(kept, s["best"]["attempt"]).alias("chosen"), verdict.alias("verdict"), F.when(kept, s["best"]["findings"]).alias("findings"), error.alias("error"))


def recorded(outcome: DataFrame, refused: DataFrame) -> DataFrame:
    """The outcome as the run's records keep it: a commit that the store refused (book, ord) is failed, with nothing kept."""
    no = refused.select(*KEYS, F.lit(True).alias("refused")).distinct()
    broken = F.coalesce(F.col("refused"), F.lit(False)) & (F.col("status") == "committed")
    rows = outcome.join(no, KEYS, "left").withColumn("broken", broken)
    gone = lambda c: F.when(~F.col("broken"), F.col(c)).alias(c)
    status = F.when(F.col("broken"), "failed").otherwise(F.col("status")).alias("status")
    return rows.select(*KEYS, status, "attempts", gone("chosen"), gone("verdict"), gone("findings"), F.when(F.col("broken"), V.COMMIT_REFUSED).otherwise(F.col("error")).alias("error"))


def manuscripts_after(records: DataFrame, texts: DataFrame, manuscripts: DataFrame, auto_accept: bool = True) -> DataFrame:
    """book, ord, text, status of all manuscripts: those of committed chapters are their chosen attempt's (texts: book, ord, attempt, text), the others stay.

    manuscripts (book, ord, text, status) are those before; a chapter that is not committed keeps
    its old text whole, or stays without one.
    """
    # The attempt is compared after a join by chapter, so that the grouping and the last join find the texts where they are.
    new = records.filter("status = 'committed'").select(*KEYS, "chosen")
    new = texts.join(new, KEYS).filter(F.col("attempt") - F.col("chosen") == 0).groupBy(*KEYS).agg(F.min("text").alias("new"))
    both = manuscripts.select(*KEYS, "text", "status").join(new, KEYS, "full")
    status = F.when(F.col("new").isNotNull(), "auto-accepted" if auto_accept else "draft").otherwise(F.col("status"))
    return both.select(*KEYS, F.coalesce("new", "text").alias("text"), status.alias("status"))


def summaries_after(records: DataFrame, given: DataFrame, chapters: DataFrame) -> DataFrame:
    """book, ord, gist, source of each committed chapter: the writer's summary (given: book, ord, gist) or a mechanical one of the kept text.

    chapters: (book, ord, title, core_event, text), the texts as they are after the commits.
    """
    done = chapters.join(records.filter("status = 'committed'").select(*KEYS), KEYS)
    made = done.join(given.filter(T.stripped("gist") != "").select(*KEYS, F.col("gist").alias("own")), KEYS, "left")
    plain = ledger.mechanical_summary(done).withColumnRenamed("gist", "plain")
    source = F.when(F.col("own").isNotNull(), "model").otherwise("mechanical")
    return made.join(plain, KEYS).select(*KEYS, F.coalesce("own", "plain").alias("gist"), source.alias("source"))


def cursors_after(records: DataFrame, projects: DataFrame) -> DataFrame:
    """book, cursor: the old cursor (projects: book, cursor), or the last committed chapter where that is further."""
    most = records.filter("status = 'committed'").groupBy("book").agg(F.max("ord").alias("last"))
    return projects.join(most, "book", "left").select("book", F.greatest(F.coalesce("cursor", F.lit(0)), F.coalesce("last", F.lit(0))).alias("cursor"))


def unsteady(records: DataFrame, times: int = V.DEGRADED_IN_A_ROW) -> DataFrame:
    """book, ord where the last `times` settled chapters of a book were not committed: where a run pauses."""
    last = W.partitionBy("book").orderBy("ord").rowsBetween(-(times - 1), 0)
    bad = records.filter("status <> 'in_progress'").withColumn("bad", F.collect_list(F.col("status") != "committed").over(last))
    return bad.filter((F.size("bad") == times) & F.forall("bad", lambda x: x)).select(*KEYS)
