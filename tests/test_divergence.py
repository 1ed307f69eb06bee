import duckdb
import pytest

from sparkloom.jobs import analysis, calibration, checks, divergence, shapes

SF = "/root/testdata/sf0.001"

QUERIES = divergence.queries() | analysis.queries() | calibration.queries() | shapes.queries() | checks.queries()
ORACLE = divergence.oracle_sql() | analysis.oracle_sql() | calibration.oracle_sql() | shapes.oracle_sql() | checks.oracle_sql()


def rows(df, columns):
    return sorted(tuple(str(float(x)) if hasattr(x, "dtype") or isinstance(x, (int, float)) else str(x) for x in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in divergence.TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
