"""Every registered query of the library itself against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from vecpack.plans.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(rows):
    return sorted(repr(tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(columns).collect()]
    assert rows
    if name in ORACLE_SQL:
        db = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        sql = ORACLE_SQL[name]()
        assert sorted(db.sql(sql).columns) == columns
        quoted = ", ".join(f'"{c}"' for c in columns)
        assert plain(rows) == plain(db.sql(f"SELECT {quoted} FROM ({sql}) AS expected").fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_search_plans(spark):
    """A search sorts k rows of each partition, not all; columns that it doesn't need aren't read."""
    df = QUERIES["search_topk"](spark, str(DATA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "label" not in plan.split("ReadSchema")[1].split("\n")[0]
    batch = QUERIES["search_topk_batch"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in batch and "CartesianProduct" not in batch and "NestedLoop" not in batch
