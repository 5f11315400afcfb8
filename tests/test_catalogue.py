"""Every query against its SQL in DuckDB, on the same tables."""

from __future__ import annotations

import math
from collections import Counter
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from docloom.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


#: Places to which the engines' last bits may differ; more than any query rounds to, so a row that they round apart is a difference.
PLACES = 10


def plain(x):
    """A value without the types' differences between the engines."""
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, PLACES) + 0.0
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x if isinstance(x, (int, str)) else str(x)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    ours = Counter(tuple(plain(v) for _, v in sorted(r.asDict(recursive=True).items())) for r in df.collect())
    got = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(range(len(columns)), key=columns.__getitem__)
    theirs = Counter(tuple(plain(r[k]) for k in order) for r in got.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_gives_rows(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0
