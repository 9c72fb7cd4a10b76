"""Every query against its oracle; queries without one must give rows."""

import pytest

from plumbline.plans import catalog

from .oracle import compare

MAY_BE_EMPTY_ON_SMALL_DATA = {"ledger_conflicts"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf, name):
    n, difference = compare(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name], sf)
    assert not difference
    assert n or name in MAY_BE_EMPTY_ON_SMALL_DATA


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_shuffle_in_row_checks(spark, sf):
    """Checks on one document need no exchange, and read their two columns alone."""
    for name in ("english_residue", "dollar_parity", "visible_text", "plain_text"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    plan = catalog.QUERIES["english_residue"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
