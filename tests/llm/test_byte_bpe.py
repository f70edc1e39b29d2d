import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import byte_bpe as B

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30) | st.lists(st.sampled_from(["it's", "'S", " the", "  ", "\n\n", "é", "日本", "😀", "12", "!!", "\x1c", "\xa0", "<|endoftext|>"])).map("".join))
def test_pre_tokens_encode_apart(text):
    own = B.ranks_of(PATH)
    ids = b"".join(own.encode(w.encode()) for w in own.split(text))
    assert np.frombuffer(ids, own.wire).tolist() == own.encoding.encode_ordinary(text)
    assert own.decode(np.frombuffer(ids, own.wire)).decode() == text


def plain(text):
    ids = B.ranks_of(PATH).encoding.encode_ordinary(text or "")
    raw = np.array(ids, "<u4").tobytes()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query(spark, sf_dir):
    want = [(r.doc_id, *plain(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [tuple(r) for r in B.op10_byte_bpe(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got) == sorted(want)


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a b", 5), (3, "x y " * 90_000, 5), (4, "c", 5), (4, "c", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id or 0, r.n_tokens, bytes(r.decoded)) for r in B.decode_corpus(B.encode_corpus(docs, PATH), PATH).collect())
    assert got == sorted((i or 0, plain(t)[0], (t or "").encode()) for i, t, _ in rows)
    assert B.encode_corpus(docs.limit(0), PATH).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert B.encode_corpus(nothing, PATH).count() == 2


def test_decoding_joins_the_table(spark):
    """From ids alone: any ids, in any order; unknown ones are an error."""
    own = B.ranks_of(PATH)
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, len(own._length), n).astype("<u4") for n in (0, 1, 50, 300_000)]
    rows = [(i, x.tobytes(), "k") for i, x in enumerate(ids)] + [(9, None, "k")]
    got = {r.k: r for r in B.decode_corpus(spark.createDataFrame(rows, "k int, ids binary, decoded string"), PATH).collect()}
    assert got[9].decoded is None
    for i, x in enumerate(ids):
        assert bytes(got[i].decoded) == own.encoding.decode_bytes(x.tolist())
    with pytest.raises(ValueError, match="without bytes"):
        own.decode(np.array([len(own._length)]))


def test_few_words_remembered(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"one two three{i} four{i % 3}") for i in range(50)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in B.encode_corpus(docs, PATH, buckets=1).collect()}
    assert got == {i: plain(f"one two three{i} four{i % 3}")[0] for i in range(50)}
