import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import mtree as M
from tests.llm.oracle import assert_same


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 200), st.integers(1, 6), st.integers(1, 7), st.integers(1, 60), st.integers(0, 10_000))
def test_search_is_exact(n, dims, k, spread, seed):
    rng = np.random.default_rng(seed)
    x, ids, q = rng.integers(-spread, spread, (n, dims)), rng.permutation(n), rng.integers(-spread, spread, dims)
    tree = M.MTree(x, ids, page=4, fanout=3)
    for without in (None, int(ids[0])):
        want = sorted((-int(s), int(i)) for s, i in zip(x @ q, ids, strict=True) if i != without)[:k]
        assert tree.search(q, k, without) == [(-s, i) for s, i in want]
        if len(want) == k:  # a score that k rows reach changes nothing
            assert tree.search(q, k, without, least=-want[-1][0])[:k] == [(-s, i) for s, i in want]


def test_bounds_spare_distances():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) * 100
    x = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8))).astype(np.int64)
    tree = M.MTree(x, np.arange(4000))
    tree.search(x[0], 5)
    assert tree.distances < 2500


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    assert_same(M.op4_topk(spark, sf), M.ORACLE_OP4, sf)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 7), (1, [1.0, 0.0], 7), (2, [1.0, 0.0], 7), (2, [1.0, 0.0], 7), (3, None, 7), (4, [nan, 1.0], 7), (5, [inf, 1.0], 7), (6, [None, 1.0], 7), (None, [9.0, 9.0], 7), (50, [], 7), (100, [0.5, 0.25, 1.0], 7), (7, [-1.0, 0.001], 7)]
    rows = M.quantised(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int"))
    got = sorted(tuple(r) for r in M.top_k(rows, rows.where("vec_id % 50 = 0"), 2, shard_rows=2).collect())
    assert got == [(0, 1, 1, 65536), (0, 2, 2, 65536)]
    assert M.top_k(rows.limit(0), rows, 2).count() == 0


def test_many_shards(spark, monkeypatch):
    """Shards, blocks of queries and the first shard's scores against brute force; rows that repeat count each."""
    monkeypatch.setattr(M, "QUERIES", 3)
    rng = np.random.default_rng(4)
    x = rng.integers(-20, 20, (300, 5))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())] * 2
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    got = sorted(tuple(r) for r in M.top_k(df, df.where("vec_id % 20 = 0"), 5, shard_rows=40).collect())
    want = []
    for q in range(0, 300, 20):
        best = sorted((-int(np.dot(x[q], v)), i) for i, v in rows if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want
