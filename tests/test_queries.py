"""Every registered query against its SQL, both on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def _key(row):
    return tuple((v is None, 0 if v is None else v) for v in row)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=_key)
    sql = contract.oracle_sql()[name]
    assert sorted(duck.sql(sql).columns) == columns
    names = ", ".join(f'"{c}"' for c in columns)
    want = sorted(duck.sql(f"SELECT {names} FROM ({sql})").fetchall(), key=_key)
    assert len(want) > 0
    assert got == want


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_coreset_covers_nearly_as_well_as_exact(spark):
    from cloudmill import farthest_point_sample
    from cloudmill.plans.points import embedded_points

    cloud = embedded_points(spark, SF_DIR)
    everything = [tuple(r) for r in cloud.select("x", "y", "z").collect()]

    def radius(sample):
        picked = [tuple(r) for r in sample.select("x", "y", "z").collect()]
        return max(min(math.dist(p, q) for q in picked) for p in everything)

    exact = radius(farthest_point_sample(cloud, 12))
    blocks = radius(farthest_point_sample(cloud.repartition(5), 12, method="coreset"))
    # Greedy is within 2 of the best radius, the two-level form within 4.
    assert blocks <= 4 * exact
