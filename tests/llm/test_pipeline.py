import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from tallyloom.llm import secrets as S
from tests.llm.test_near_dedup import counts, jaccard


def classes(texts):
    """Brute-force components of similarity 0.8 or more: doc_id -> smallest doc_id."""
    own = {i: counts(t) for i, t in texts.items()}
    where = defaultdict(list)
    for i, c in own.items():
        for s in c:
            where[s].append(i)
    top = {i: i for i in texts}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in {(a, b) for ids in where.values() for a in ids for b in ids if a < b}:
        if jaccard(own[i], own[j]) >= 0.8:
            a, b = sorted((find(i), find(j)))
            top[b] = a
    return {i: find(i) for i in texts}


def test_pipeline(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"  # the smallest with enough labels
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for name, stage in C.STAGES:
        stage(spark, kept[-1], sf_dir).write.parquet(f"{tmp_path}/{name}")
        kept.append(spark.read.parquet(f"{tmp_path}/{name}"))
        if name != "packing":
            assert kept[-1].columns == docs.columns
    rows = [{r.doc_id: r for r in df.collect()} for df in kept[:5]]
    # toxicity: rows are untouched; most labelled toxic rows with evidence go, clean ones stay
    assert all(rows[0][i] == r for i, r in rows[1].items()) and 0 < len(rows[0]) - len(rows[1]) < 0.2 * len(rows[0])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert sum(i in rows[1] for i, t in labels.items() if t == 0) >= 0.97 * sum(t == 0 for t in labels.values())
    # exact copies: the largest doc_id stays
    best = {}
    for i, r in rows[1].items():
        best[r.text] = max(i, best.get(r.text, i))
    assert set(rows[2]) == set(best.values())
    # near copies: one of each component
    own = classes({i: r.text for i, r in rows[2].items()})
    assert set(rows[3]) == set(own.values())
    # secrets: only texts with findings change
    for i, r in rows[4].items():
        spans = S.spans_of([rows[3][i].text], S.RULES)[0]
        assert (r.text == rows[3][i].text) == (not spans) and not any(s[1] < 3 for s in S.spans_of([r.text], S.RULES)[0]) and r.n_chars == len(r.text)
    assert set(rows[4]) == set(rows[3])
    # packing: whole documents
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    parts = defaultdict(list)
    for r in kept[5].collect():
        parts[r.doc_id].append((r.start, bytes(r.ids)))
    assert set(parts) == set(rows[4])
    for i, own in parts.items():
        want = np.array(plain.encode(rows[4][i].text, add_special_tokens=False).ids + [1], "<u4").tobytes()
        assert b"".join(x for _, x in sorted(own)) == want


def test_run_is_the_stages(spark, sf_dir):
    got = C.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "bucket", "sequence_id", "offset"] and got.count() > 0
    assert len({hashlib.sha256(bytes(r.ids)).hexdigest() for r in got.where("length > 64").collect()}) > 10


def test_stages_take_odd_rows(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    long = "word " * 40_000
    rows = [
        (1, None, "en", None, None, 1, "a"), (2, "", None, "s", 0, 2, "b"), (None, "some words here to keep", "en", "s", 23, 3, "c"), (None, None, None, None, None, None, None),
        (5, long, "en", "s", len(long), 5, "e"), (6, long + "more", "en", "s", 0, 6, "f"), (7, "token=abcdefgh1 stays", "en", "s", 21, 7, "g"), (7, "token=abcdefgh1 stays", "en", "s", 21, 7, "g"),
        (8, "one two three four five six", "en", "s", 27, 8, "h"), (9, "One two three four five six!", "en", "s", 28, 9, "i"),
    ]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, _at string"
    for k, docs in enumerate((spark.createDataFrame(rows, names), spark.createDataFrame(rows, names).limit(0))):
        docs.write.parquet(f"{tmp_path}/{k}/start")
        now = spark.read.parquet(f"{tmp_path}/{k}/start")
        kept = {}
        for name, stage in C.STAGES:
            stage(spark, now, sf_dir).write.parquet(f"{tmp_path}/{k}/{name}")
            now = spark.read.parquet(f"{tmp_path}/{k}/{name}")
            kept[name] = now.collect()
            assert name == "packing" or now.columns == docs.columns
        if k:
            assert not any(kept.values())
            continue
        assert len(kept["toxicity"]) == 10
        # 1, 2 and the null row hold equal (empty) texts: the largest id stays; 7 stays once
        assert sorted(str(r.doc_id) for r in kept["exact_dedup"]) == ["2", "5", "6", "7", "8", "9", "None"]
        assert sorted(str(r.doc_id) for r in kept["near_dedup"]) == ["2", "5", "7", "8", "None"]
        assert [(r.text, r.n_chars) for r in kept["secrets"] if r.doc_id == 7] == [("[assign] stays", 14)]
        assert sum(r.length for r in kept["packing"] if r.doc_id == 2) == 1


def test_near_dedup_stage_takes_no_round_a_row(spark, monkeypatch):
    """Rows of one bucket that are near nobody: the stage writes as few tables as for a handful of them."""
    from tallyloom.llm import near_dedup

    monkeypatch.setattr(near_dedup, "GROUP_ROWS", 3)
    written = []
    monkeypatch.setattr(near_dedup, "cut", lambda df, f=near_dedup.cut: written.append(1) or f(df))
    rows = [(i, " ".join(f"n{i}_{k}" if k % 30 == i % 30 else f"w{k}" for k in range(300))) for i in range(30)]
    rows.append((30, rows[0][1] + " and an end"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = C.drop_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30))
    assert len(written) <= 20
