import os

import duckdb
import pytest

from lattice.plans import driver_queries as q
from lattice.plans import tree_queries  # noqa: F401  its queries are registered with the others

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_as_sql(spark, duck, sf, name):
    df = q.QUERIES[name](spark, sf)
    want = duck.sql(q.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(want.fetchall(), want.columns)


def test_line_diff_adds_up(spark, sf):
    docs = {r["doc_id"]: r["text"].split("\n") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = {}
    for r in q.q_line_diff(spark, sf).collect():
        seen.setdefault(r["rel"], {"removed": [], "added": []})[r["side"]].append((r["line"], r["text"]))
    assert seen
    for rel, sides in seen.items():
        old, new = (docs[int(x)] for x in rel.split(">"))
        for side, lines in (("removed", old), ("added", new)):
            assert all(lines[i - 1] == text for i, text in sides[side])
        gone, come = ({i for i, _ in sides[s]} for s in ("removed", "added"))
        assert [x for i, x in enumerate(old, 1) if i not in gone] == [x for i, x in enumerate(new, 1) if i not in come]


def test_every_query_is_registered(spark):
    import __spark_entry__ as e

    assert set(q.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["node", "depth"]
    assert os.path.exists("/root/testdata/sf0.001")
