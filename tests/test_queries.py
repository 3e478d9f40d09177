import math

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom.plans.oracles import ORACLES
from ledgerloom.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(table):
    def value(v):
        return None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v

    names = sorted(table.column_names)
    return sorted((tuple(value(r[n]) for n in names) for r in table.to_pylist()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DIR).toArrow()
    if name in ORACLES:
        want = con.execute(ORACLES[name]).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        assert rows(got) == rows(want)
    else:
        assert got.num_rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_orders_that_repeat_or_lack(spark, tmp_path):
    """Keys that come twice in orders, and pages whose order isn't there: drafts as in the SQL."""
    own = duckdb.connect()
    own.execute(f"COPY (SELECT * FROM '{DIR}/orders.parquet' WHERE o_orderkey % 11 <> 3 UNION ALL SELECT * FROM '{DIR}/orders.parquet' WHERE o_orderkey % 5 = 0) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    own.execute(f"COPY (SELECT * FROM '{DIR}/lineitem.parquet' WHERE l_orderkey % 10 <> 5) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    for t in ("orders", "lineitem"):
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert rows(QUERIES["create_drafts"](spark, str(tmp_path)).toArrow()) == rows(own.execute(ORACLES["create_drafts"]).to_arrow_table())
