"""What the driver calls."""

import duckdb
import pytest

import __spark_entry__
from tidemark.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if not n.startswith("i")))
def test_query_and_sql_agree(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, FOLDER)
    want = db.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda found: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in found)
    assert rows(got.select(*columns).collect()) == rows(db.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalog.ORACLES[name]})").fetchall())
