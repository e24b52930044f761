"""Near-duplicate vectors against brute force where there are many links, and the hashing's recall at the threshold itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import embedding_dedup as E


def brute(v: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """(links, smallest id reachable) of each row."""
    m = v.astype(np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= threshold
    np.fill_diagonal(near, False)
    low = np.arange(len(v))
    while True:
        now = np.minimum(low, np.where(near, low[None, :], len(v)).min(1))
        if (now == low).all():
            return list(zip(near.sum(1).tolist(), low.tolist()))
        low = now


@pytest.mark.parametrize("kind", ["float", "double"])
def test_many_links(spark, monkeypatch, kind):
    monkeypatch.setattr(E, "BLOCK", 64)
    rng = np.random.default_rng(5)
    v = rng.standard_normal((3000, 24))
    hot = v[0] + 0.2 * rng.standard_normal((400, 24))  # one large family, chains, pairs, equal rows
    chain = np.cumsum(np.concatenate([v[1:2], 0.25 * rng.standard_normal((60, 24))]), 0)
    v = np.concatenate([v, hot, chain, v[100:200] + 0.15 * rng.standard_normal((100, 24)), v[5:8], v[5:8]]).astype(np.float32 if kind == "float" else np.float64)
    rows = spark.createDataFrame([(i, x.tolist(), i % 3, 0) for i, x in enumerate(v)], f"vec_id long, embedding array<{kind}>, class int, key int")
    got = E.near_duplicates(rows).orderBy("vec_id").collect()
    want = brute(v, E.THRESHOLD)
    assert sum(n for n, _ in want) > 10_000 and sum(low != i for i, (_, low) in enumerate(want)) > 400
    have = [(r.n_links, r.component_id) for r in got]
    found = sum(n for n, _ in have)
    assert found >= 0.99 * sum(n for n, _ in want) and all(a <= b for (a, _), (b, _) in zip(have, want))
    assert sum(a == b for (_, a), (_, b) in zip(have, want)) >= 0.995 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_links_are_counted_once_and_none_lost_in_a_full_bucket(spark, monkeypatch):
    """All vectors in one bucket of every table: exact whatever the hashing."""
    monkeypatch.setattr(E, "plan", lambda n, *_: (1, 4))
    monkeypatch.setattr(E, "keys", lambda m, projections, tables, seed, upto=None: np.zeros((len(m), tables if upto is None else upto), np.int64) + 7)
    monkeypatch.setattr(E, "BLOCK", 32)
    rng = np.random.default_rng(6)
    v = np.repeat(rng.standard_normal((60, 8)), 4, 0) + 0.15 * rng.standard_normal((240, 8))
    # The patched functions must reach the workers by value, so the stages are run here.
    run, hashing = E._checking(E.THRESHOLD, 1, 4, 7), E._hashing(1, 4, 7)
    import pyarrow as pa

    one = pa.RecordBatch.from_pydict({"class": list(range(240)), "dim": pa.array([8] * 240, pa.int32()), "v": v.tolist()})
    hashed = next(iter(hashing([one])))
    assert hashed.column("keys").to_pylist()[3] == [7] * 4
    table = {"table": [0] * 240 + [1] * 240, "key": [7] * 480, "dim": [8] * 480, "lo": [0] * 480, "hi": [0] * 480, "own": [0] * 480, "class": list(range(240)) * 2, "n": [1] * 480, "v": v.tolist() * 2}
    batch = pa.RecordBatch.from_pydict(table)
    links = np.zeros(240, int)
    for out in run([batch.slice(0, 100), batch.slice(100, 300), batch.slice(400), batch.slice(0, 0)]):
        np.add.at(links, out.column("a").to_numpy(), out.column("links").to_numpy())
    assert links.tolist() == [n for n, _ in brute(v, E.THRESHOLD)]


@pytest.mark.parametrize("n", [10**5, 10**7])
def test_recall_at_the_threshold(n):
    rng = np.random.default_rng(8)
    a, noise = rng.standard_normal((2, 1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise -= (noise * a).sum(1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    b = 0.9001 * a + np.sqrt(1 - 0.9001**2) * noise
    projections, tables = E.plan(n)
    same = (E.keys(a, projections, tables, 3) == E.keys(b, projections, tables, 3)).any(1)
    assert same.mean() >= 0.985


def test_keys_do_not_depend_on_the_batch():
    rng = np.random.default_rng(9)
    m = rng.standard_normal((300, 48))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    whole = E.keys(m, 9, 20, 1)
    assert all((E.keys(m[i : i + 1], 9, 20, 1, 11) == whole[i : i + 1, :11]).all() for i in range(0, 300, 7))
    assert (E.keys(m[::-1], 9, 20, 1)[::-1] == whole).all()


def test_clashing_columns_and_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, n int, dim int, v string")
    assert E.near_duplicates(none).count() == 0
    rows = spark.createDataFrame([(1, [1.0, 0.0], "x"), (None, [2.0, 0.0], "y"), (3, None, None), (3, [], "z"), (4, [1.0, 0.0, 0.0], "w"), (5, [-0.0, 0.0], "u"), (1, [1.0, 0.0], "x")], "vec_id long, embedding array<double>, H1 string")
    got = sorted(E.near_duplicates(rows).select("vec_id", "n_links", "component_id").collect(), key=str)
    assert sorted((r.n_links, r.component_id) for r in got if r.vec_id == 1) == [(2, 1), (2, 1)]
    assert [(r.n_links, r.component_id) for r in got if r.vec_id is None] == [(2, 1)]
    assert [r.n_links for r in got if r.vec_id in (3, 4, 5)] == [0, 0, 0, 0]
    assert rows.filter(F.col("vec_id") == 4).count() == 1
