import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import toxicity as T


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.integers(1, 5), st.integers(1, 8), st.integers(0, 10_000))
def test_search_is_exact(n, terms, k, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 3, (n, terms)).astype(float)
    x = x[x.any(axis=1)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rng.permutation(len(x)) * 3
    index = T.BlockMaxIndex(x, ids, block=4)
    q = rng.integers(1, 4, terms) / 2.0
    got = index.search(np.arange(terms), q, k)
    want = sorted(((-round(float(s), 9), int(i)) for s, i in zip(x @ q, ids, strict=True) if s > 0))[:k]
    assert [(-s, i) for s, i, _ in got] == want


def test_isotonic():
    x, y = T.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert np.interp([0.1, 0.25, 0.4], x, y).tolist() == [0.0, 0.5, 1.0]


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in T.op1_toxicity(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = [(got[r.doc_id].predicted, r.toxic, got[r.doc_id].score) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    hit = sum(p == t == 1 for p, t, _ in rows)
    assert hit / sum(p for p, _, _ in rows) > 0.8 and hit / sum(t for _, t, _ in rows) > 0.85
    assert np.mean([(s - t) ** 2 for _, t, s in rows]) < 0.03


def test_odd_rows(spark):
    rows = [(i, f"text{i} idiot scum" if i % 4 == 0 else f"text{i} nice house", 3) for i in range(80)]
    rows += [(100, None, 3), (101, "", 3), (None, "idiot scum", 3), (102, "nice " * 50_000, 3), (102, "x IDIOT scum", 3), (102, "x IDIOT scum", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(100, 1), (101, None), (None, 1), (4, 0)], "doc_id bigint, toxic int")
    model = T.fit_toxicity(docs.select("doc_id", "text"), labels)
    got = T.score_toxicity(docs, model).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.predicted) for r in got if r.doc_id is None or r.doc_id > 99} == {(100, 0), (101, 0), (None, 1), (102, 0), (102, 1)}
    assert all(n.toxic == 1 for r in got if r.doc_id is None for n in r.neighbours)
    clean = T.drop_toxic(docs, model)
    assert clean.columns == docs.columns and {r.score for r in clean.collect()} == {3} and clean.count() == sum(r.predicted == 0 for r in got)
    blank = T.fit_toxicity(docs.limit(0).select("doc_id", "text"), labels.limit(0))
    assert {r.score for r in T.score_toxicity(docs, blank).collect()} == {0.0} and T.score_toxicity(docs.limit(0), model).count() == 0


def test_every_word_counts(spark):
    """Vectors are of all words: words that label 1 does not have move the cosine, and no sampled row leaves the index."""
    rows = [(i, f"idiot scum w{i}" if i % 4 == 0 else f"nice house w{i}") for i in range(80)]
    docs = spark.createDataFrame(rows + [(200, "house nice w1"), (201, "idiot house nice w2 w3 w5")], "doc_id bigint, text string")
    model = T.fit_toxicity(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id bigint, toxic int"))
    assert len(model.labels) == len(model.index.ids) == 80
    got = {r.doc_id: r.neighbours for r in T.score_toxicity(docs, model).collect()}
    assert (got[200][0].doc_id, got[200][0].similarity) == (1, 1.0)
    assert 0 < got[201][0].similarity < 0.99 and all(len(n) == T.NEIGHBOURS for n in got.values())


def test_sparse_postings_give_the_same(spark):
    rng = np.random.default_rng(4)
    x = np.where(rng.random((700, 300)) < 0.03, rng.random((700, 300)), 0.0)
    x[:, :3] = rng.random((700, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = T.BlockMaxIndex(x, np.arange(700), block=8)
    assert 0 < len(index.dense) < 300 and len(index.rows)
    for i in range(0, 700, 50):
        at = np.flatnonzero(x[i])
        want = sorted((-round(float(s), 9), j) for j, s in enumerate(x @ x[i]) if s > 0 and j != i)[:15]
        assert [(-s, j) for s, j, _ in index.search(at, x[i, at], 15, without=i)] == want


def test_whole_query_by_brute_force(spark):
    """op1 over all documents of sf0.01: neighbours and votes from dense vectors of all words."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.doc_id in docs}
    bags = {i: Counter(re.findall(r"\w+", t.lower())) for i, t in docs.items()}
    ids = sorted(labels)
    place = {w: k for k, w in enumerate(sorted({w for i in ids for w in bags[i]}))}
    seen, by_label = Counter(w for b in bags.values() for w in b if w in place), [Counter(w for i in ids if labels[i] == y for w in bags[i]) for y in (0, 1)]
    size = [sum(labels[i] == y for i in ids) for y in (0, 1)]
    n, factor = sum(size), np.zeros(len(place))
    for w, k in place.items():
        a, b = by_label[1][w], by_label[0][w]
        # Pearson's statistic with Yates' correction, cell by cell
        cells = [(a, 1, a + b), (b, 0, a + b), (size[1] - a, 1, n - a - b), (size[0] - b, 0, n - a - b)]
        chi2 = sum(max(abs(x - size[y] * m / n) - 0.5, 0) ** 2 / (size[y] * m / n) for x, y, m in cells if m)
        factor[k] = (math.log((1 + len(docs)) / (1 + seen[w])) + 0.1) * (1 + max(math.sqrt(chi2) - 3, 0))

    def vector(bag):
        v = np.zeros(len(place))
        for w, c in bag.items():
            if w in place:
                v[place[w]] = (1 + math.log(c)) * factor[place[w]]
        return v / max(np.linalg.norm(v), 1e-300)

    rows = np.array([vector(bags[i]) for i in ids])
    found = found_any = 0
    for r in T.op1_toxicity(spark, sf).collect():
        sims = rows @ vector(bags[r.doc_id])
        want = sorted(((-round(float(s), 9), i) for s, i in zip(sims, ids, strict=True) if s > 0))[:15]
        got = [(-x.similarity, x.doc_id) for x in r.neighbours]
        assert np.allclose([s for s, _ in got], [s for s, _ in want], atol=2e-9) and all(x.toxic == labels[x.doc_id] for x in r.neighbours)
        found += [i for _, i in got] == [i for _, i in want]  # but for sums that differ in the ninth digit
        found_any += bool(got)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)
    assert found >= 0.999 * len(docs) and found_any > 0.95 * len(docs)
