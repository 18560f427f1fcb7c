import duckdb
import pytest

from tessel.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == names
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert all({"bigint": "BIGINT", "boolean": "BOOLEAN"}[kind] == kinds[c] for c, kind in df.dtypes)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(rel.select(*[f'"{c}"' for c in names]).fetchall())
