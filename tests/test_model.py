"""The engine on a small library of its own, against rows worked out by hand."""

from __future__ import annotations

import duckdb
import pytest

from model_library import CASES
from stemma.plans.registry import Tables
from test_registry import SF, plain


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    made, sql = CASES[name]
    df, rel = made(Tables(spark, SF)), duckdb.sql(sql)
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    got = sorted(repr(plain([r[c] for c in columns])) for r in df.collect())
    assert got and got == sorted(repr(plain([r[rel.columns.index(c)] for c in columns])) for r in rel.fetchall())
