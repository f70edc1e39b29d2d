import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import dart_minhash as M
from tallyloom.llm import near_dedup as N


def counts(text):
    w = re.findall(r"\w+", text.lower())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c D e f".split()), max_size=30).map(" ".join), min_size=2, max_size=5))
def test_elements_hold_counts(texts):
    element, weight, n = M.elements(texts)
    ends = np.cumsum(n)
    parts = [(element[e - k : e], weight[e - k : e]) for e, k in zip(ends, n, strict=True)]
    want = [counts(t) for t in texts]
    assert [sorted(w.tolist()) for _, w in parts] == [sorted(w.values()) or [1] for w in want]
    assert all((np.diff(x.astype(object)) > 0).all() for x, _ in parts)
    assert not any(want[:2]) or abs(M.similarity(*parts[:2]) - jaccard(want[0], want[1])) < 1e-12
    assert all((a == b).all() for x in parts for a, b in zip(M.unpack(M.pack(*x)), x, strict=True))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB1_ é߲٣ß́İǅ中\n\0.-\U0001d7d8\ud800"), max_size=30), max_size=5))
def test_words_of_any_characters(texts):
    """Words are those of the pattern, and have equal hashes where they are equal, wherever they stand."""
    hashed, counts = M._hash_words(texts)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(M, "CHARACTERS", 7)
        assert all((x == y).all() for x, y in zip(M._hash_words(texts), (hashed, counts), strict=True))
    want = [re.findall(r"\w+", x.lower()) for x in texts]
    assert counts.tolist() == [len(w) for w in want]
    flat = [w for x in want for w in x]
    assert len(set(zip(flat, hashed.tolist(), strict=True))) == len(set(flat)) == len(set(hashed.tolist()))


def test_word_characters_are_those_of_the_pattern():
    assert M._in_words().tolist() == [re.match(r"\w", chr(i)) is not None for i in range(0x110000)]


def test_elements_cost_little_a_character():
    """Half a million different words: hashed one at a time they cost three times what throwing their darts does."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{x:x}" for x in rng.integers(1 << 20, 1 << 28, 500)) for _ in range(1000)]
    M.elements(texts[:1])
    hashed, throw = [], []
    for _ in range(3):
        began = time.process_time()
        found = M.elements(texts)
        hashed.append(time.process_time() - began)
        began = time.process_time()
        M.signatures(*found)
        throw.append(time.process_time() - began)
    assert min(hashed) < 2 * min(throw)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(3000)]
    for keep, size in ((0.95, 400), (0.7, 400), (0.9, 12), (0.9, 5000)):
        a = rng.choice(words, size).tolist()
        b = a[: int(size * keep)] + rng.choice(words, size - int(size * keep)).tolist()
        texts = [" ".join(a), " ".join(b)]
        sig = M.signatures(*M.elements(texts))
        assert (sig != 0).all()
        assert abs((sig[0] == sig[1]).mean() - jaccard(counts(texts[0]), counts(texts[1]))) < 0.14


def test_regions_of_any_weight():
    """Weights may be large or fractions; what two signatures share follows the weighted similarity, and a
    weight of ten million costs no more than one of ten."""
    rng = np.random.default_rng(2)
    for high in (0.5, 3.0, 40.0, 1e7):
        n = 60
        element = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))
        share = []
        for trial in range(12):
            x, y = rng.random(n) * high, rng.random(n) * high
            y = np.where(rng.random(n) < 0.8, x, y)
            own = M.mix(element + np.uint64(trial))
            sig = M.signatures(np.append(own, own), np.append(x, y), np.array([n, n]))
            share.append((sig[0] == sig[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum())
        assert abs(np.mean(share)) < 0.04, high
    began = time.perf_counter()
    M.signatures(np.arange(1, 201, dtype=np.uint64), np.full(200, 1e7), np.array([200]))
    assert time.perf_counter() - began < 1


def test_recall_by_share_of_changed_words(spark):
    """What five words and 0.8 mean: a copy with one word in fifty replaced has about 0.82; all copies at
    0.8 or more are found, those below are not, and documents that are no copies stay apart."""
    rng = np.random.default_rng(11)
    vocabulary = np.array([f"w{i}" for i in range(20_000)])
    rows, kind = [], {}
    for k in range(120):
        size = int(rng.choice([60, 200, 800, 3000]))
        base = rng.choice(vocabulary, size)
        rows.append((2 * k, " ".join(base)))
        edit = float(rng.choice([0.005, 0.01, 0.02, 0.05, 0.1]))
        at = rng.choice(size, int(round(edit * size)), replace=False)
        copy = base.copy()
        copy[at] = rng.choice(vocabulary, len(at))
        rows.append((2 * k + 1, " ".join(copy)))
        kind[k] = (edit, jaccard(counts(rows[-1][1]), counts(rows[-2][1])) >= 0.8)
    got = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all((got[2 * k + 1] == 2 * k) == near for k, (_, near) in kind.items()) and all(got[2 * k] == 2 * k for k in kind)
    share = {e: np.mean([got[2 * k + 1] == 2 * k for k, (x, _) in kind.items() if x == e]) for e in (0.005, 0.01, 0.05, 0.1)}
    assert share[0.005] == share[0.01] == 1 and share[0.1] == 0


def brute(rows):
    found = {}
    own = [counts(t or "") for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    where = {}
    for i, c in enumerate(own):
        for s in c:
            where.setdefault(s, []).append(i)
    pairs = {(i, j) for ids in where.values() for i in ids for j in ids if i < j}
    for i, j in pairs:
        if jaccard(own[i], own[j]) >= 0.8:
            a, b = sorted((top(i), top(j)))
            label[b] = a
    for i, (d, _) in enumerate(rows):
        found.setdefault(top(i), []).append(d)
    return sorted(tuple(sorted(x)) for x in found.values())


def classes(rows):
    out = {}
    for r in rows:
        out.setdefault(r.class_id, []).append(r.doc_id)
    return sorted(tuple(sorted(x)) for x in out.values())


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = N.op2_near_dedup(spark, sf).collect()
    assert classes(got) == brute(rows)
    assert all(r.class_size == s for r in got for s in [sum(x.class_id == r.class_id for x in got)] if r.doc_id % 50 == 0)
    assert sum(r.kept for r in got) == len(classes(got))


@pytest.mark.parametrize(("group", "tile"), [(3, 128), (2000, 2)])
def test_large_rests(spark, monkeypatch, group, tile):
    """Rounds of leaders, and groups in tiles."""
    monkeypatch.setattr(N, "GROUP_ROWS", group)
    monkeypatch.setattr(N, "TILE", tile)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in rng.integers(0, 10_000, 200)]
    rows = []
    for i in range(14):
        rows.append((i, " ".join(base if i % 3 else base[:90] + [f"m{i}_{k}" for k in range(110)])))
        at = int(rng.integers(0, 180))
        base = base[:at] + [f"n{i}_{k}" for k in range(3)] + base[at + 3 :]
    assert classes(N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == brute(rows)


@pytest.mark.parametrize("many", [12, 60])
def test_rows_that_are_apart_take_no_further_rounds(spark, monkeypatch, many):
    """Rows that share buckets and are near nobody: tables are written as often for many as for few."""
    monkeypatch.setattr(N, "GROUP_ROWS", 3)
    written = []
    monkeypatch.setattr(N, "cut", lambda df, f=N.cut: written.append(df.columns) or f(df))
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(many):
        own = list(base)
        for at in rng.choice(400, 10, replace=False):
            own[at] = f"n{i}_{at}"
        rows.append((i, " ".join(own)))
    rows.append((many, rows[-1][1] + " and an end"))
    want = brute(rows)
    assert len(want) == many
    assert classes(N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == want
    assert len(written) <= 20


def test_tiles_connect_what_pairs_do(monkeypatch):
    """Weights of all kinds, in columns of a few elements; sides that are known stay together."""
    monkeypatch.setattr(N, "COLUMNS", 7)
    rng = np.random.default_rng(9)
    joined = 0
    for trial in range(40):
        base = rng.choice([0.5, 1.0, 1.0, 2.0, 9.0, 1e6] if trial % 2 else [1.0], 30)
        own = []
        for _ in range(24):
            here = rng.random(30) < 0.93
            element = np.flatnonzero(here).astype(np.uint64) * np.uint64(1 << 40)
            own.append((element, np.where(rng.random(30) < 0.1, base + 1, base)[here]))
        side = rng.integers(0, 20, 24)
        low, high = np.arange(10), np.arange(10, 24) if trial % 3 else np.arange(10)
        maybe = rng.random((len(low), len(high))) < 0.8
        found = N._connect([own[i] for i in low], [own[j] for j in high], side[low], side[high], maybe, 0.8)

        def parts(pairs, side=side):
            label = side.copy()
            for i, j in pairs:
                label[label == label[j]] = label[i]
            return [[bool(x == y) for y in label] for x in label]

        near = [(low[i], high[j]) for i in range(len(low)) for j in range(len(high)) if maybe[i, j] and M.similarity(own[low[i]], own[high[j]]) >= 0.8]
        assert parts([(low[i], high[j]) for i, j in found]) == parts(near)
        assert all((low[i], high[j]) in near for i, j in found) and len(found) < 24
        joined += len(found)
    assert joined > 40


def test_chains_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 10_000, 300)]
    rows = []
    for i in range(12):  # a chain: neighbours are similar, the ends are not
        rows.append((i, " ".join(base)))
        at = int(rng.integers(0, 280))
        base = base[:at] + [f"n{i}_{k}" for k in range(6)] + base[at + 6 :]
    rows += [(100, None), (101, ""), (102, "!!"), (103, "Two words"), (104, "two  WORDS"), (104, "two  WORDS"), (None, "two words"), (105, "x " * 100_000), (106, "x " * 99_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, node int")
    got = N.near_duplicates(docs).collect()
    want = brute([(i, t) for i, t in rows if i is not None and i not in (100, 101, 102)]) + [(100, 101), (102,)]
    assert classes([r for r in got if r.doc_id is not None]) == sorted(want)
    assert [(r.class_id, r.class_size, r.kept) for r in got if r.doc_id is None] == [(103, 4, False)]
    kept = N.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(want)
    assert N.near_duplicates(docs.limit(0)).count() == 0
