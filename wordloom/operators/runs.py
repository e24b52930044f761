"""The ledger of runs: totals, resumption, stale records, choice between attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as V


def totals(runs: DataFrame) -> DataFrame:
    """run_id, committed, unsettled (distinct orders), tokens."""
    state = lambda s: F.count_distinct(F.when(F.col("status") == s, F.col("ord")))
    return runs.groupBy("run_id").agg(state("committed").alias("committed"), state("in_progress").alias("unsettled"), F.sum("tokens").alias("tokens"))


def pending(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of wanted (run_id, ord) that no committed record covers: where a run resumes."""
    done = runs.filter("status = 'committed'").select("run_id", "ord")
    return wanted.join(done, ["run_id", "ord"], "left_anti")


def reclaimed(runs: DataFrame, current: str | None, reason: str) -> DataFrame:
    """Records of dead runs that still say in_progress become failed."""
    stale = (F.col("status") == "in_progress") & ~F.col("run_id").eqNullSafe(F.lit(current))
    return runs.withColumn("error", F.when(stale, reason).otherwise(F.col("error"))).withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def states(runs: DataFrame) -> DataFrame:
    """run_id, first, last, written, failed, phase (of the latest record) and state of each run."""
    s = runs.groupBy("run_id").agg(
        F.min("ord").alias("first_ord"),
        F.max("ord").alias("last_ord"),
        F.count_if(F.col("status") == "committed").alias("written"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "in_progress").alias("open"),
        F.max_by("phase", F.struct("at", "ord")).alias("phase"),
    )
    state = F.when(F.col("open") > 0, "running").when((F.col("failed") > 0) & (F.col("written") > 0), "partial").when(F.col("failed") > 0, "failed").otherwise("done")
    return s.withColumn("state", state)


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last written row of each key (an upsert): one map-side combined aggregate, no sort."""
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*by)).alias("v")).select(*keys, "v.*")


def newest(rows: DataFrame, keys: list[str], by: list[str], n: int = 20) -> DataFrame:
    """The newest n rows of each key (retention)."""
    order = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in by])
    return rows.withColumn("age", F.row_number().over(order)).filter(F.col("age") <= n)


def stuck(turns: DataFrame, key: str, order: str, pattern: str, read_only: str) -> DataFrame:
    """key, order of turns where the last four show two patterns at most and only read."""
    last = W.partitionBy(key).orderBy(order).rowsBetween(-(V.READ_ONLY_TURNS - 1), 0)
    w = turns.withColumn("p", F.collect_list(pattern).over(last)).withColumn("r", F.bool_and(read_only).over(last))
    return w.filter((F.size("p") == V.READ_ONLY_TURNS) & (F.size(F.array_distinct("p")) <= V.STUCK_PATTERNS) & F.col("r")).select(key, order)


def best(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Of several attempts the one with fewer findings, then not flagged, then the earlier."""
    return attempts.groupBy(*keys).agg(F.min_by("attempt", F.struct("findings", "flagged", "attempt")).alias("attempt"))


def batches(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ok, passed, model (of the first candidate that names one)."""
    named = F.min(F.when(F.col("model") != "", F.struct("index", "model")))
    return candidates.groupBy(*keys).agg(F.count_if("ok").alias("ok"), F.count_if(F.col("ok") & (F.col("verdict") == "pass")).alias("passed"), named["model"].alias("model"))


def usable(state):
    """Whether a part may be used; null may not."""
    return F.coalesce(state.isin(*V.USABLE), F.lit(False))


def valid_plans(beats: DataFrame, low: int = 3, high: int = 20, most: int = 999) -> DataFrame:
    """Chapters (plan, ord, beat renumbered 1..n) of plans in which every chapter has a legal number and number of beats."""
    n = beats.groupBy("plan", "ord").agg(F.count("*").alias("n"))
    bad = n.filter(~F.col("ord").between(1, most) | ~F.col("n").between(low, high)).select("plan").distinct()
    order = W.partitionBy("plan", "ord").orderBy("beat")
    return beats.join(bad, "plan", "left_anti").withColumn("beat", F.row_number().over(order))


def histogram(rows: DataFrame, key: str, label: str, at: str, n: int = 5) -> DataFrame:
    """key, label, count, rank: the n most frequent labels of each key; ties in order of first occurrence."""
    counted = rows.groupBy(key, label).agg(F.count("*").alias("count"), F.min(at).alias("first"))
    order = W.partitionBy(key).orderBy(F.desc("count"), "first", label)
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("first")
