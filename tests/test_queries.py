"""Every query of the reference's own operators against DuckDB on the smallest tables."""

from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

from skylattice import registry

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, (float, Decimal)):
        return round(float(x), 5)
    if isinstance(x, date) and not isinstance(x, datetime):
        return x.isoformat()
    return x


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = db.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted([repr(tuple(map(plain, r))) for r in want.fetchall()])
    assert sorted(repr(tuple(map(plain, r))) for r in got.select(*columns).collect()) == rows
    assert rows
