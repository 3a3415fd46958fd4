"""The driver's contract: every query runs, and equals its SQL where there is some."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from foliospark.plans.catalog import ORACLES, QUERIES

TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def test_flagship(spark):
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "rank0", "score"]


def test_registries():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    if entry.HAS_LLM:
        assert all(any(q.startswith(f"op{n}_") for q in entry.queries()) for n in range(1, 11))


def test_nothing_else_imports_the_corpus_operators():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, names in os.walk(os.path.join(root, "foliospark")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert "llm" not in f.read(), n


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    assert {n: TYPES[t] for n, t in df.dtypes} == {d[0]: str(d[1]) for d in want.description}
    at = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(row[i] for i in at)) for row in want.fetchall())
