"""Every query of the raster operators against its SQL, and the contract of the entry module."""

import pytest

import __spark_entry__ as entry
from chromagrid.plans import diffusion, exports, filters, palettes, planes, scalars, tiled

SQL = scalars.SQL | planes.SQL | filters.SQL | exports.SQL | diffusion.SQL | tiled.SQL | palettes.SQL
QUERIES = scalars.QUERIES | planes.QUERIES | filters.QUERIES | exports.QUERIES | diffusion.QUERIES | tiled.QUERIES | palettes.QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, spark, sf_dir, compare):
    compare(QUERIES[name](spark, sf_dir), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
