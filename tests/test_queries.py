"""Every query that SQL can express gives the rows of its SQL; the others run and have rows."""

import pytest

import __spark_entry__ as entry
from tesserae.plans import patrol, relational, spatiotemporal
from tests.compare import same
from tests.conftest import SF

PLANS = (relational, spatiotemporal, patrol)
SQL = {k: v for p in PLANS for k, v in p.SQL.items()} | {"flagship": entry.FLAGSHIP_SQL}
QUERIES = {k: v for p in PLANS for k, v in p.QUERIES.items()} | {"flagship": entry.flagship}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"m13_significant"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_significant_columns_are_those_of_the_summary(spark):
    """None may be; then there is no row."""
    flagged = {r["column"] for r in QUERIES["m12_coef_summary"](spark, SF).where("significant").collect()}
    assert {r["column"] for r in QUERIES["m13_significant"](spark, SF).collect()} == flagged


def test_entry(spark):
    assert entry.entry(spark).count() == 830
    assert set(entry.oracle_sql()) <= set(entry.queries())
