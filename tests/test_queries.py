"""Every registered query that has SQL gives the SQL's rows, on the smallest tables."""
import os

import duckdb
import pytest

from notarium.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    r = duck.execute(plans.ORACLES[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == columns
    assert plain(df.select(*columns).collect()) == plain([row[names.index(c)] for c in columns] for row in r.fetchall())


def test_top_k_is_not_a_full_sort(spark):
    plan = plans.semantic_topk(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
