"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from caudal.plans import catalogue, content, courses, exams, offline, selling, structure  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, sql, name):
    found = catalogue.QUERIES[name](spark, SF)
    names = sorted(found.columns)
    rows = sorted(repr(tuple(r[c] for c in names)) for r in found.collect())
    expected = sql.execute(catalogue.ORACLES[name])
    at = [d[0] for d in expected.description]
    assert sorted(at) == names
    assert rows == sorted(repr(tuple(r[at.index(c)] for c in names)) for r in expected.fetchall())


def test_flagship(spark):
    assert catalogue.flagship(spark, SF).count() == 1
