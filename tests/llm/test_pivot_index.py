import math

import numpy as np
import pyarrow as pa

from corpusloom.llm import pivot_index
from corpusloom.llm.queries import op9_pivot_index


def brute(rows, k, every):
    sound = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            sound[i] = [math.floor(256 * float(x)) for x in v]
    out = set()
    for q in sound:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(sound[q], v)), i) for i, v in sound.items() if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def test_op9_equals_brute_force(spark, sf_dir):
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x = np.floor(256 * np.stack(data.embedding).astype(float)).astype(np.int64)
    ids, want = data.vec_id.to_numpy(), set()
    for n in np.flatnonzero(ids % 50 == 0):
        scores = x @ x[n]
        order = [j for j in np.lexsort((ids, -scores)) if j != n][:5]
        want |= {(int(ids[n]), r + 1, int(ids[j]), int(scores[j])) for r, j in enumerate(order)}
    rows = op9_pivot_index(spark, sf_dir).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_awkward_vectors_ties_and_small_tables(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 2.0, 0.0]), (302, [float("nan")] * 4), (303, [float("inf"), 0.0, 0.0, 0.0]), (None, [9.0] * 4), (350, [1.0, 2.0]), (351, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in pivot_index.top_k(frame, 5, 10).collect()} == brute(rows, 5, 10)
    few = frame.where("vec_id < 3")
    assert {tuple(r) for r in pivot_index.top_k(few, 5, 1).collect()} == brute(rows[:3], 5, 1)
    assert pivot_index.top_k(frame.where("false")).collect() == []


def test_large_annuli_are_skipped():
    """A far annulus cannot hold a better score, so it is not scored at all."""
    x = np.full((10, 2), 1000.0)
    heads = [np.array([0.0]), np.array([1400.0]), np.array([1420.0]), np.array([0.0])]
    out = pivot_index._expand(np.array([0]), np.array([[1.0, 1.0]]), np.array([5.0]), heads, [np.arange(1, 11)], [x], 5, np.zeros((1, 2)))
    assert len(out[0]) == 0


def test_many_groups_blocks_and_clashing_columns(spark, monkeypatch):
    """Small groups and blocks, clustered vectors so that bounds exclude some, columns named like the index's own."""
    for name, value in (("ANNULUS", 16), ("GROUP", 32), ("BLOCK", 8)):
        monkeypatch.setattr(pivot_index, name, value)
    rng = np.random.default_rng(6)
    middle = rng.normal(0, 6, (12, 6))
    rows = [(i, (middle[i % 12] + rng.normal(0, 0.2, 6)).astype(np.float32).tolist()) for i in range(700)]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, group long, q long, rank int")
    got = [tuple(r) for r in pivot_index.top_k(frame, 5, 10).collect()]
    assert set(got) == brute(rows, 5, 10) and len(got) == len(set(got))


def test_vectors_go_only_to_blocks_that_ask_for_them():
    """Two far clusters: each one's queries ask for their own group; many queries of one group are dealt to several blocks."""
    pivots = np.array([[0.0, 0.0], [1e6, 0.0]])
    heads = pa.table({"group": [4, 9], "pivot": [0, 1], "low": [0.0, 0.0], "high": [5.0, 5.0], "norm": [25.0, 1e12], "asked": [3 * pivot_index.BLOCK, 2]})
    first, parts = pivot_index._blocks(heads)
    assert first.tolist() == [0, 3] and parts.tolist() == [3, 1]
    q = np.array([[1e6, 0.0], [1e6, 1.0]])
    rows = pa.RecordBatch.from_pydict({"group": [9], "asked": [np.array([50, 100], "<i8").tobytes()], "floors": [np.array([1e12 - 1e3] * 2, "<f8").tobytes()], "q": [q.astype("<f8").tobytes()]})
    pairs = pa.Table.from_batches(pivot_index._route(heads, pivots, 2, pairs=True)([rows])).to_pylist()
    assert pairs == [{"group": 9, "block": 3}]
    full = pa.Table.from_batches(pivot_index._route(heads, pivots, 2)([rows]))
    assert full.column("query_id").to_pylist() == [50, 100] and {*full.column("block").to_pylist()} == {3}


def test_repeated_ids_count_once_each(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [3.0, 0.0]), (3, [2.0, 0.0]), (10, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in pivot_index.top_k(frame, 5, 10).collect())
    assert got == [(10, 1, 2, 3 * 65536), (10, 2, 3, 2 * 65536), (10, 3, 1, 65536), (10, 4, 1, 65536)]
