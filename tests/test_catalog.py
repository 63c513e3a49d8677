"""Every query of the catalog against its SQL in DuckDB on the small tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from corpusmill.plans import catalog, corpus_queries  # noqa: F401 - registers its queries

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


def bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, TABLES)
    want = db.execute(catalog.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    expected = bag(want.fetchall(), names)
    assert expected or name == "pending_embeddings"  # the smallest tables have more vectors than documents
    assert bag([tuple(r) for r in got.collect()], got.columns) == expected


def test_entry(spark):
    hits = contract.entry(spark)
    assert {"query_id", "chunk_id", "score"} <= set(hits.columns) and hits.count() > 0
