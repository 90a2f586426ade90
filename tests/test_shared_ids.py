"""blanked_texts against its SQL where items of an order share an id."""

from __future__ import annotations

import duckdb

from leafline import catalog
from tests.compare import spark_rows, sql_rows

# Keys of 100,000 and more reach into the id's digits for the line; where texts share places they have the same characters there, so that SQL leaves no choice.
LINES = [(100, 1, 111111), (100, 2, 11111), (100, 2, 11111), (100, 3, 7), (101, 2, 133333), (101, 3, 33333), (130, 1, 5)]


def test_as_sql(spark, tmp_path):
    spark.createDataFrame(LINES, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in (100, 101, 130)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = spark_rows(catalog.QUERIES["blanked_texts"](spark, str(tmp_path)))
    assert got == sql_rows(con, catalog.ORACLES["blanked_texts"])
    assert len(got[1]) == 4 and any(t.startswith("    ") for *_, t in got[1])
