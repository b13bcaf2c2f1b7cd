"""Driver contract: entry, registered queries and oracle SQL."""
import duckdb
import pytest

import __spark_entry__ as E
from checks.compare import TABLES, table_hash

from conftest import SF001


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["doc_id", "title", "seq", "level", "text", "page"]


def test_every_oracle_has_a_query():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 60


def parity(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF001)
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(sdf.columns)
    assert table_hash(sdf.columns, [tuple(r) for r in sdf.collect()])[0] == table_hash(cols, res.fetchall())[0]


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_parity_small(spark, name):
    """Every query with an oracle equals its DuckDB SQL at sf0.001."""
    parity(spark, name)


def test_language_accuracy(spark):
    from pyspark.sql import functions as F
    from pagewise.operators import language as LG
    from conftest import SF01
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    det = LG.detect_language(docs.where("doc_id % 2 = 1"), LG.language_profiles(docs.where("doc_id % 2 = 0")))  # held out
    acc = docs.join(det, "doc_id").agg(F.avg((F.col("lang") == F.col("language")).cast("double"))).first()[0]
    assert acc > 0.95
