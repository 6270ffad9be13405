import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from phasemesh.session import session

    s = session("local[4]", 4, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tiny():
    if not os.path.isdir(TINY):
        pytest.skip("the small tables are not here")
    return TINY


@pytest.fixture(scope="session")
def duck(tiny):
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(tiny)):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{tiny}/{f}')")
    return con


def plain(rows, columns):
    """Rows as sorted tuples of texts, columns by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, float):
            return repr(v + 0.0)
        return str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql(spark, tiny, duck):
    """Asserts that a query and its SQL give the same columns, types and rows."""

    def check(query, sql):
        df = query(spark, tiny)
        got = [tuple(r) for r in df.collect()]
        cursor = duck.execute(sql)
        names = [c[0] for c in cursor.description]
        want = cursor.fetchall()
        assert sorted(df.columns) == sorted(names)
        assert plain(got, df.columns) == plain(want, names)

    return check
