"""Queries against their oracles on values that only larger tables have."""

import duckdb
import pytest

import __spark_entry__
from tests.test_oracles import plain

LINES = "SELECT range AS l_orderkey, range % 7 AS l_suppkey, 1000.0::DOUBLE + range % 50000 AS l_quantity FROM range(1024)"  # pixels up to 50 times the least space
VECTORS = "SELECT range AS vec_id, [x, y, 0.1]::FLOAT[] AS embedding, range % 3 AS label FROM (VALUES (0, 0.1, 0.2), (1, 0.2, 0.49), (2, -0.5, -0.47), (3, 0.49, 0.1), (4, 0.05, -0.46), (5, -0.2, -0.1)) t(range, x, y)"
PARTS = "SELECT unnest([7, 1023, 1024, 1048575, 1048576, 5000000, 1073741824, 3298534883328]) AS p_partkey, '12' AS p_brand"
CASES = ["clusterize_blocks", "group_bounds_error", "group_partition", "seam_lock", "mercator_roundtrip", "ecef_to_lonlat", "rotated_bounds", "strict_integer_parse"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    for name, sql in (("lineitem", LINES), ("embeddings", VECTORS), ("part", PARTS)):
        duckdb.sql(f"COPY ({sql}) TO '{at}/{name}.parquet'")
    return str(at)


@pytest.mark.parametrize("name", CASES)
def test_oracle(spark, tables, name):
    df = __spark_entry__.queries()[name](spark, tables)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    c = duckdb.connect()
    for t in ("lineitem", "embeddings", "part"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    rel = c.sql(__spark_entry__.oracle_sql()[name])
    assert got and got == sorted(tuple(plain(r[rel.columns.index(k)]) for k in cols) for r in rel.fetchall())
