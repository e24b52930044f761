"""Streams of chapter records: resumable application to a ledger, and drift over the last chapters of each book."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import fixed as V
from ..operators import runs


def into_ledger(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch once to the ledger at `path`, the latest record of a key within the batch.

    The checkpoint is what a stopped run resumes from; a batch that is applied again after a failure
    overwrites its own folder, so records are never doubled.
    """

    def apply(batch: DataFrame, number: int) -> None:
        runs.latest(batch, ["run_id", "ord"], ["at"]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger(spark, path: str) -> DataFrame:
    """The latest record of each key over all batches."""
    return runs.latest(spark.read.parquet(path).drop("batch"), ["run_id", "ord"], ["at"])


def drifting(stream: DataFrame, limits: dict[str, float] | None = None, window: int = V.DRIFT_WINDOW) -> DataFrame:
    """book, ord, rule, middle of a stream (book, ord, rule, value) that arrives in order of ord within a book.

    State a book and rule is its last chapters' numbers and values only; as in the batch form, chapters more
    than twelve numbers back don't count. A book whose chapters arrive in one batch is taken in order.
    """
    limits = {k: v * V.DRIFT_RATIO for k, v in (limits or V.DRIFT_P95).items()}

    def step(key, frames, state):
        import pandas as pd

        held = list(zip(*state.get)) if state.exists else []
        rows = []
        for frame in frames:
            for ord_, value in frame.sort_values("ord")[["ord", "value"]].itertuples(index=False):
                held = [*held, (int(ord_), float(value))][-window:]
                near = sorted(v for o, v in held if o >= ord_ - 12)
                middle = near[window // 2] if len(near) == window else None
                if middle is not None and key[1] in limits and middle > limits[key[1]]:
                    rows.append((key[0], int(ord_), key[1], middle))
        state.update(([o for o, _ in held], [v for _, v in held]))
        yield pd.DataFrame(rows, columns=["book", "ord", "rule", "middle"])

    return stream.groupBy("book", "rule").applyInPandasWithState(step, "book string, ord long, rule string, middle double", "ords array<long>, held array<double>", "append", GroupStateTimeout.NoTimeout)


def start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs `each` for every batch; a failing batch stops the query, and the next start resumes with it."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> dict:
    """Rows and batches so far."""
    seen = query.recentProgress
    return {"batches": len(seen), "rows": sum(p["numInputRows"] for p in seen)}


__all__ = ["drifting", "into_ledger", "ledger", "progress", "start"]
