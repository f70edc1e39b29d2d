import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import common as C


def test_prefilter_keeps_all_wanted(spark):
    df = spark.range(5000).selectExpr("id AS k", "cast(id as string) AS v").union(spark.createDataFrame([(None, "n")], "k bigint, v string"))
    wanted = spark.range(0, 5000, 50).selectExpr("id AS w").union(spark.createDataFrame([(None,)], "w bigint"))
    got = {r.k for r in C.prefilter(df, "k", wanted).collect()}
    assert set(range(0, 5000, 50)) <= got and len(got) < 200 and None not in got
    assert C.prefilter(df, "k", wanted.limit(0)).count() == 0


def test_prefilter_is_sized_by_what_is_wanted(spark, monkeypatch):
    """A saturated bitmap lets more rows pass, but none that is wanted is lost."""
    df = spark.range(20_000).selectExpr("id AS k")
    wanted = spark.range(0, 20_000, 4).selectExpr("id AS w")
    assert C.prefilter(df, "k", wanted).count() < 7_500
    monkeypatch.setattr(C, "MOST_BITS_LOG2", 8)
    assert C.prefilter(df, "k", wanted).count() == 20_000


def test_drop_rows(spark):
    docs = spark.range(1000, numPartitions=3).selectExpr("id AS doc_id", "if(id = 9, null, cast(id as string)) AS text", "id AS _bits", "'x' AS _own")
    ids = {r.doc_id: (r.at, r.h) for r in docs.withColumn("at", F.monotonically_increasing_id()).withColumn("h", C.text_hash()).collect()}
    gone = spark.createDataFrame([ids[i] for i in range(0, 1000, 7)], "gone bigint, h bigint")
    kept = C.drop_rows(docs, gone)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in range(1000) if i % 7]
    with pytest.raises(Exception, match="other partitions"):
        C.drop_rows(docs.repartition(5, "doc_id"), gone).collect()
    assert C.drop_rows(docs, gone.limit(0)).count() == 1000 and C.drop_rows(docs.limit(0), gone).count() == 0


def test_cut_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, [1, 2], b"x"), (None, None, None)], "a bigint, b array<int>, c binary")
    got = C.cut(df)
    assert got.schema == df.schema and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert spark.sparkContext.getCheckpointDir()


def test_pieces_and_strings():
    batch = pa.RecordBatch.from_pydict({"i": list(range(6)), "text": ["a" * 10, None, "b" * 50, "", "é", "c"]})
    parts = list(C.pieces([batch], "text", most_chars=12))
    assert [x for p in parts for x in p.column("i").to_pylist()] == list(range(6)) and [p.num_rows for p in parts] == [2, 1, 3]
    assert C.texts_of(parts[0]) == ["a" * 10, ""]
    for items in ([], [b""], [b"x", b"", b"yz" * 1000]):
        assert C.unpack_strings(C.pack_strings(items)) == items


def test_nothing_else_imports_this_subpackage():
    root = os.path.dirname(os.path.dirname(C.__file__))
    for folder, _, names in os.walk(root):
        if not folder.startswith(os.path.dirname(C.__file__)):
            for n in names:
                if n.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, n)).read()
