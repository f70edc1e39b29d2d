import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import exact_dedup as D
from tallyloom.llm import quotient
from tests.llm.oracle import assert_same


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**52 - 1) | st.sampled_from([0, 1, 5, 2**52 - 1]), max_size=40), min_size=1, max_size=5))
def test_filters_merge_losslessly(parts):
    made = []
    for p in parts:
        v, c = np.unique(np.array(p, np.uint64), return_counts=True)
        made.append(quotient.encode(v, c, 52))
        assert [x.tolist() for x in quotient.decode(made[-1])] == [v.tolist(), c.tolist()]
    v, c = np.unique(np.array(sum(parts, []), np.uint64), return_counts=True)
    assert [x.tolist() for x in quotient.merge(made)] == [v.tolist(), c.tolist()]


def test_query(spark, sf_dir):
    assert_same(D.op5_exact_dedup(spark, sf_dir), D.ORACLE_OP5, sf_dir)


def test_odd_rows(spark):
    rows = [(1, "a", 9), (2, "a", 9), (2, "a", 9), (None, "a", 9), (3, None, 9), (4, "", 9), (None, "b", 9), (5, "x" * 200_000, 9), (6, "x" * 200_000, 9), (7, "x" * 200_000 + "y", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, keep_id int")
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in D.exact_duplicates(docs).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    want = [(1, 2, 4, False), (2, 2, 4, False), (2, 2, 4, True), (None, 2, 4, False), (3, 4, 2, False), (4, 4, 2, True), (None, None, 1, True), (5, 6, 2, False), (6, 6, 2, True), (7, 7, 1, True)]
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = D.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4", "6", "7", "None"]
    assert D.exact_duplicates(docs.limit(0)).count() == 0
