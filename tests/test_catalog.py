import duckdb
import pytest

from marginalia.plans import catalog
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(v) for _, v in sorted(zip(names, r))) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in rows), key=repr)
    assert got == want


def test_texts_are_parsed_once_and_changed_in_pieces(spark):
    plan = lambda name: catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # What is left in the plans: the rewriting of the notes; the parse that makes the patch, and the differences.
    assert plan("rewrite_links").count("MapInArrow") == 1 and plan("unified_diff").count("MapInArrow") == 2
    assert not any(p in plan(n) for n in ("rewrite_links", "unified_diff", "patch_section", "block_ids") for p in ("MapInPandas", "ArrowEvalPython"))
