"""Queries of personal data against their SQL where a hit of one rule runs into another's."""

from __future__ import annotations

import duckdb
import pytest

from leafline import catalog
from tests.compare import spark_rows, sql_rows

TEXTS = [
    "write to hnof.70@mail0.example.com esh 38.211.12.42 4366089147969128 ly", "the 4495589438270767 42.73.240.87 the", "from 10.0.0.1 only, card 4111 1111 1111 1111", "a@4111111111111111.example.com", "1.2.3.4@example.org", "", None,
]


@pytest.mark.parametrize("name", ["pii_findings", "pii_counts", "pii_masks"])
def test_as_sql(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert spark_rows(catalog.QUERIES[name](spark, str(tmp_path))) == sql_rows(con, catalog.ORACLES[name])
