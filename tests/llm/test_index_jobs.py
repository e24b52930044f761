"""The fingerprint index over several jobs, with nothing but the index, against brute force; its joins use the stored order."""

import numpy as np
import pytest

from test_operators import SCHEMA, removed
from wordloom.llm import substring_dedup
from wordloom.llm.common import Scratch


def test_a_reopened_index_needs_no_earlier_texts(spark, tmp_path):
    """Three jobs by `deduplicate`: passages of the first come back in the second and third, of two documents at once, in whole copies, and in texts that share nothing else."""
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 900, n))
    passages = [text(60) for _ in range(4)]
    rows = [(i, f"{text(30)} {passages[i % 4]} {text(20)}" if i < 8 else text(90)) for i in range(12)]
    rows += [(20 + i, f"{text(10)} {passages[i]} {text(5)} {passages[3 - i]}") for i in range(4)] + [(30, rows[2][1]), (31, text(55)), (32, None), (33, text(10))]
    rows += [(40, f"{passages[0]} {rows[17][1]}"), (41, rows[2][1]), (42, text(51)), (None, passages[0])]
    path = str(tmp_path / "index")
    got = []
    for lo, hi in ((0, 20), (20, 40), (40, 60)):
        part = [(i, t, None, None, None) for i, t in rows if (lo <= i < hi if i is not None else lo == 40)]
        index = substring_dedup.FingerprintIndex(spark, path) if lo == 0 else substring_dedup.FingerprintIndex.open(spark.newSession(), path)
        out = substring_dedup.deduplicate(index.spark.createDataFrame(part, SCHEMA), index=index, batches=2)
        got += [(-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()]
        index.close()
    want = removed([(i, t, None, None, None) for i, t in rows])
    assert sorted(got) == want and sum(r[2] > 0 for r in want) >= 8


def test_an_index_without_texts_wants_them_named(spark, tmp_path):
    index = substring_dedup.FingerprintIndex(spark, str(tmp_path / "index"), keep_texts=False)
    batch = spark.createDataFrame([(1, "a " * 80)], "doc_id long, text string")
    index.ingest(batch)
    again = substring_dedup.FingerprintIndex.open(spark.newSession(), str(tmp_path / "index"))
    later = again.spark.createDataFrame([(2, "b " * 80)], "doc_id long, text string")
    with pytest.raises(ValueError, match="keeps no texts"):
        again.ingest(later)
    assert again.ingest(later, later).count() == 1
    again.drop()


def test_runs_are_merged_in_their_stored_order(spark, tmp_path):
    """Joins of runs: merge joins without a sort or a shuffle."""
    index = substring_dedup.FingerprintIndex(spark, str(tmp_path / "index"), fan_in=4)
    rng = np.random.default_rng(2)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 900, 120))
    for n in range(3):
        index.ingest(spark.createDataFrame([(n * 10 + i, text()) for i in range(5)], "doc_id long, text string"))
    newest = index.runs["fp"].pop()
    with substring_dedup.stored_order(spark):
        plan = index.shared_fingerprints(newest)._jdf.queryExecution().executedPlan().toString()
        met = Scratch(spark).written(index.shared_fingerprints(newest))
    merged = plan.split("Union")[1]
    assert plan.count("SortMergeJoin") >= 4 and "CartesianProduct" not in plan and met.count() == 0
    joins = [line for line in merged.splitlines() if "SortMergeJoin" in line or " Sort " in line or "Exchange" in line]
    older = joins[-4:]
    assert all("SortMergeJoin" in line for line in older), plan
    index.runs["fp"].append(newest)
    index.drop()
