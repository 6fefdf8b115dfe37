import duckdb
import pytest

from gridshift.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in "orders lineitem events embeddings".split():
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_and_sql_agree(spark, sql, name):
    got, want = QUERIES[name](spark, SF).toPandas(), sql.sql(ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    assert a.equals(b)


def test_columns_taller_than_the_memory(spark, tmp_path):
    """One row more than a column chunk of multistage_roundtrip holds."""
    spark.range(5121).selectExpr("id as vec_id", "transform(sequence(0, 63), k -> cast(id * 64 + k as float)) as embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got, want = QUERIES["multistage_roundtrip"](spark, str(tmp_path)).toPandas(), c.sql(ORACLE_SQL["multistage_roundtrip"]).df()
    a, b = (d.sort_values(["i0", "i1"]).reset_index(drop=True) for d in (got[["i0", "i1", "v"]], want))
    assert len(b) == 5121 * 64 and a.equals(b)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
