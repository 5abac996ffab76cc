"""Queries of the subpackage against their SQL."""

from __future__ import annotations

import pytest

from siftline.llm.registry import ORACLES, QUERIES

from ..compare import DATA, canonical, connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    want = connection().sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert canonical(df.select(*columns).collect()) == canonical(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())
