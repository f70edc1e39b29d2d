"""Every query over tables without rows, and over tables with null rows alone, read from files."""

import pytest

from tallyloom.llm import queries as Q

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_empty_and_null(spark, tmp_path, name):
    for nulls in (0, 3):
        for table, schema in SCHEMAS.items():
            width = schema.count(",") + 1
            spark.createDataFrame([(None,) * width] * nulls, schema).repartition(2).write.parquet(f"{tmp_path}/{nulls}/{table}.parquet")
        rows = Q.QUERIES[name](spark, f"{tmp_path}/{nulls}").collect()
        assert len(rows) == (0 if name == "op4_topk" else min(nulls, 1) if name == "pipeline" else nulls)
