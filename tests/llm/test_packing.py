import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyloom.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
BITS = st.sampled_from(["It's", "DON'T", " ", "\n", "\x1c", "\x85", "\xa0", "é", "é", "ß", "İ", "İx", "123", "½", "word", "'", "''ll", "<|endoftext|>", "<|", "日本", "😀", "!?", "\x00", "ÀÉ", "'S", "º", "ﬁ"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(BITS | st.text(max_size=4), max_size=12).map("".join), max_size=5))
def test_ids_are_the_librarys(texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in P.encoder(PATH).encode(texts)]
    assert got == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


def test_lengths():
    for n in [1, 2, 2047, 2048, 2049, 10_001]:
        own = P.binary_lengths(n, 2048)
        assert sum(own) == n and own == sorted(own, reverse=True) and all(x & (x - 1) == 0 and x <= 2048 for x in own)


def check(rows, docs):
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 for r in rows)
    for i, text in docs:
        ids = PLAIN.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(by[i], key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(P.op6_packing(spark, sf_dir).collect(), docs)


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a b", 5), (3, "x y " * 30_000, 5), (4, "c", 5), (4, "c", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length int")
    got = P.pack_binary(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got if r.doc_id != 3) == [(0, 1), (0, 2), (1, 1), (2, 1), (4, 2), (4, 2)]
    assert sum(r.length for r in got if r.doc_id == 3) == 60_001
    assert P.pack_binary(docs.limit(0), PATH).count() == 0


def test_equal_lengths_lie_together(spark, sf_dir, tmp_path):
    packed = P.pack_binary(spark.read.parquet(f"{sf_dir}/documents.parquet"), PATH)
    P.write_buckets(packed, f"{tmp_path}/packed")
    for folder in (tmp_path / "packed").glob("bucket=*"):
        assert [r.length for r in spark.read.parquet(str(folder)).select("length").distinct().collect()] == [1 << int(folder.name[7:])]
    assert spark.read.parquet(f"{tmp_path}/packed").count() == packed.count()
