import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(repr(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(repr(r[names.index(c)]) for c in columns) for r in found.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_first_words_with_line_breaks(spark, tmp_path):
    texts = [(1, 0, "user", "a b"), (1, 1, "user", "one\nsecond: 2\\n c"), (2, 0, "user", " x"), (3, 0, "user", "k:v+%\n d"), (4, 0, "user", None)]
    spark.createDataFrame(texts, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = sorted(map(tuple, __spark_entry__.queries()["annotations_by_key"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(__spark_entry__.oracle_sql()["annotations_by_key"]).fetchall())
    assert got[0] == (1, "one\nsecond:", 2)
