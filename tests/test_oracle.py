"""Every query of the catalogue against its SQL twin."""

import pytest

from ledgerframe.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLE[name])


def test_entry_module_imports(spark):
    import __spark_entry__ as entry

    assert set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
