"""The operators that SQL can express, against DuckDB; the rest of the registered queries run elsewhere here."""

import duckdb
import pytest

from kgspark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    mine, sql = QUERIES[name](spark, folder).toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(sql.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[columns].itertuples(index=False))
    assert rows(mine) == rows(sql)


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
