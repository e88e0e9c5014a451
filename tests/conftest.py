import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from commentarium.session import local_session

    return local_session(4, shuffle_partitions=4)


@pytest.fixture(scope="session")
def small():
    if not os.path.exists(SMALL):
        pytest.skip("no test tables")
    return SMALL


def oracle(sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con.sql(sql).to_arrow_table().to_pylist()


def alike(rows, columns):
    return sorted(repr([r[c] for c in columns]) for r in rows)


@pytest.fixture(scope="session")
def check_sql(spark, small):
    def check(query, sql):
        got = [r.asDict() for r in query(spark, small).collect()]
        want = oracle(sql, small)
        columns = sorted(got[0]) if got else sorted(want[0]) if want else []
        assert alike(got, columns) == alike(want, columns)

    return check
