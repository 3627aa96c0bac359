"""Queries over the store on documents that the smallest tables lack."""

import duckdb
import pytest
from test_queries import rows

from lorespark.plans import registry


@pytest.mark.parametrize("name", ["kb_build", "upload_inside_build"])
def test_documents_without_text(spark, tmp_path, name):
    """Documents whose text is empty, missing or blank are built like any other and have no chunks."""
    texts = {0: "", 1: "", 2: "", 3: "", 4: None, 5: None, 6: None, 7: None, 8: " \n\t", 9: "\n"}
    docs = [(i, texts.get(i, f"Text {i}. " * 40 * (i % 7)), "en", "src0", 0) for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = registry.queries()[name](spark, str(tmp_path)).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert rows(got) == rows(want)
