import duckdb
import pytest

import __spark_entry__ as entry
from siftwell.plans.registry import QUERIES, SQL

from .oracle import connect, rows_of_spark, rows_of_sql


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    names, want = rows_of_sql(connect(sf), SQL[name])
    assert sorted(df.columns) == names
    assert rows_of_spark(df) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_the_subpackage(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "siftwell.llm", None)
    bare = importlib.reload(entry)
    assert set(bare.queries()) == set(QUERIES) and set(bare.oracle_sql()) == set(SQL)
    monkeypatch.undo()
    importlib.reload(entry)


def test_tags_of_short_accented_words_match_sql(spark, tmp_path):
    texts = ["éêêment réément", "un ééément", "running béémenter éaaing", "abb\u2028ed", None, ""]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("blue", "tin")], "p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("documents", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    _, want = rows_of_sql(con, SQL["normalize_tag"])
    assert rows_of_spark(QUERIES["normalize_tag"](spark, str(tmp_path))) == want
