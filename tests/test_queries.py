"""Every query with SQL against DuckDB on the smallest tables; the others run and give rows."""

import duckdb
import pytest

import __spark_entry__
from kgspark.queries import QUERIES

ORACLES = {k: v for k, v in __spark_entry__.oracle_sql().items() if k in QUERIES}
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    mine, sql = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(sql.columns)
    assert rows(mine) == rows(sql)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_tails_of_suppliers_and_brands(spark, duck):
    got = {r["src"] for r in QUERIES["ded1_semantic_tails"](spark, FOLDER).collect()}
    want = duck.execute("SELECT DISTINCT 'supplier_' || l_suppkey FROM lineitem UNION SELECT DISTINCT 'brand_' || p_brand FROM part").fetchall()
    assert got == {r[0] for r in want}


def test_retrieval_answers_every_benchmark_question(spark, duck):
    got = {r["qid"] for r in QUERIES["ret8_text_retrieval"](spark, FOLDER).collect()}
    assert got == {r[0] for r in duck.execute("SELECT item_id FROM benchmark").fetchall()}


def test_whole_texts(spark, duck, tmp_path):
    """A missing document, and one of another language with a long text."""
    long = "mot " * 2000
    spark.createDataFrame([(0, long, "fr", "web"), (1, "short", "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0,), (1,), (7,)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(5, 0), (5, 1), (5, 7)], "conv_id long, turn int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["chunk_id"]: r["text"] for r in QUERIES["join3_missing_content"](spark, str(tmp_path)).collect()}
    assert got == {5: "[Missing content for chunk 5]"}
    lines = QUERIES["agg20_contexts"](spark, str(tmp_path)).collect()[0]["context"].split("\n")
    assert lines == ["- " + long[:5000] + "…", "- short", "- [Missing content for chunk 7]"]


def test_whole_questions(spark, tmp_path):
    """The words that tell the documents apart stand after the eighth word, and after the sixth in order."""
    spark.createDataFrame([(0, "aaa bbb"), (1, "zulu yankee xray")], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'web' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    question = "aaa bbb ccc ddd eee fff ggg hhh zulu yankee xray"
    spark.createDataFrame([(3, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    top = QUERIES["top1_keyword_rerank"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [(r["pos"], r["score"]) for r in top] == [(1, 3), (0, 2)]
    assert [tuple(r) for r in QUERIES["ret13_keyword_search"](spark, str(tmp_path)).collect()] == [(3, 2, 1)]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
