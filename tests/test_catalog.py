"""Every query with a SQL form equals that SQL on the same tables."""

from __future__ import annotations

import numpy as np
import pytest

from __spark_entry__ import FLAGSHIP, entry, oracle_sql, queries
from tests.conftest import SMALL


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if np.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return repr(value)


def rows_of(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(plain(v) for v in row) for row in zip(*[table[n].to_pylist() for n in names])), key=repr)


def kinds(table):
    return {f.name: str(f.type).replace("large_", "") for f in table.schema}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    ours = queries()[name](spark, SMALL).toArrow()
    theirs = duck.execute(oracle_sql()[name]).to_arrow_table()
    assert kinds(ours) == kinds(theirs)
    assert rows_of(ours) == rows_of(theirs)


def test_entry_is_the_flagship(spark):
    frame = entry(spark)
    assert set(frame.columns) == {"y", "p", "n"}
    assert frame.count() > 0
    assert FLAGSHIP in queries()


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
