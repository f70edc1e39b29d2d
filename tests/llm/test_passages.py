import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tallyloom.llm import passages as P
from tests.llm.oracle import assert_same


def brute(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone |= set(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), kept))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "é", "\x1c", "\xa0", "x,"]) + str(rng.randrange(400))
    passage = [[word() for _ in range(n)] for n in (34, 35, 36, 60, 200)]
    out = [None, "", " \t\n", "a " * 34, "a " * 35, "a " * 36, "a b " * 40]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += [word() for _ in range(rng.randrange(50))]
            if rng.random() < 0.6:
                p = rng.choice(passage)
                a = rng.randrange(len(p) // 2)
                parts += p[a:] if rng.random() < 0.5 else p
        out.append(rng.choice([" ", "\n", " \t "]).join(parts))
    return out + out[-3:]


def test_block_arithmetic():
    h = np.arange(100, dtype=np.uint64) % np.uint64(7)
    own = P._run(h, 35)
    assert own[0] == own[7] and len(set(own[:7].tolist())) == 7
    x = np.random.default_rng(0).integers(0, 1000, 200)
    assert P._extreme(x, 28, np.minimum, True)[:170].tolist() == [x[i : i + 28].min() for i in range(170)]
    assert P._extreme(x, 28, np.maximum, False)[27:].tolist() == [x[i - 27 : i + 1].max() for i in range(27, 200)]


def test_against_brute_force(spark, monkeypatch):
    for seed in range(3):
        if seed == 2:
            monkeypatch.setattr(P, "HOT", 3)  # the driver decides which anchors are hot
        texts = corpus(seed)
        docs = spark.createDataFrame([(i if i != 5 else None, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, kept int").repartition(3).cache()
        got = sorted(((r.n_words, r.n_removed, r.kept) for r in P.remove_recurring(docs).collect()))
        assert got == sorted(brute(texts))
        docs.unpersist()
    assert P.remove_recurring(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = [(r.doc_id, n, m, hashlib.sha256(k.encode()).hexdigest()) for r, (n, m, k) in zip(rows, brute([r.text for r in rows]), strict=True)]
    got = [tuple(r) for r in P.op7_passages(spark, sf_dir).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got) == sorted(want) and sum(m for _, _, m, _ in want) > 0


def test_oracle(spark):
    sf = "/root/testdata/sf0.01"
    assert_same(P.op7_passages(spark, sf), P.ORACLE_OP7, sf)


def sent(texts, hot):
    """What blocks of one text each send to the shards, sorted as there."""
    rows = []
    blocks = [P.Block([(t or "").encode()]) for t in texts]
    seen = Counter()
    for b in blocks:
        b.find_anchors()
        seen.update(dict(zip(*(x.tolist() for x in b.anchors()), strict=True)))
    known = np.array(sorted(a for a, n in seen.items() if n > 1), np.uint64)
    for i, b in enumerate(blocks):
        rows += [{"key": k, "hot": h, "block": i, "starts": at, "words": x} for k, h, at, x in b.pieces(known, np.array([seen[a] > hot for a in known.tolist()], bool))]
    return blocks, pa.RecordBatch.from_pylist(sorted(rows, key=lambda r: (r["key"], r["words"])))


def covered(blocks, batch):
    out = [set() for _ in blocks]
    for b in P._shards([batch]):
        for r in b.to_pylist():
            for begin, end in np.frombuffer(r["ranges"], "<i4").reshape(-1, 2).tolist():
                out[r["block"]] |= set(range(begin, end))
    return [len(x) for x in out]


def test_shards_of_any_size(monkeypatch):
    """Shards may end anywhere between keys, and within a hot key."""
    texts = corpus(5) + [f"x{i} y{i} " + " ".join(map(str, range(50))) + f" z{i}" for i in range(40)]
    want = [m for _, m, _ in brute(texts)]
    for size in (1, 700, 8_000_000):
        monkeypatch.setattr(P, "SHARD_BYTES", size)
        for hot in (0, 5, 10**9):
            assert covered(*sent(texts, hot)) == want


def test_the_automaton_decides(monkeypatch):
    """Without its matches nothing goes; passages are sequences of words of the whole corpus."""
    texts = [b" ".join(b"w%d" % i for i in range(a, a + 50)) for a in (0, 0, 10, 100)]
    shard = P.Shard(sorted(set(texts)), np.array([2, 1, 1]))
    assert [x.tolist() for x in shard.ranges()] == [[[0, 50]], [[0, 40]], []] and sorted(map(len, shard.passages)) == [40, 50]

    class Blind:
        def __init__(self, *_):
            self.add_word = self.make_automaton = lambda *_: None
            self.iter = lambda _: iter(())

    monkeypatch.setattr(P.ahocorasick, "Automaton", Blind)
    assert not any(map(len, shard.ranges()))


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(P, "_run", lambda h, n: np.zeros(len(h), np.uint64))
    texts = [b" ".join(b"w%d" % i for i in range(a, a + 40)) for a in (0, 4, 100)]
    assert [x.tolist() for x in P.Shard(texts, np.ones(3, np.int64)).ranges()] == [[[4, 40]], [[0, 36]], []]
