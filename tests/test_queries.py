"""Every registered query against its SQL."""

import os

import pytest

import __spark_entry__ as entry
from compare import difference

FOLDER = os.environ.get("TRACELAKE_DATA", "/root/testdata/sf0.001")
#: Those of the training-data folder have tests of their own beside its other tests.
NAMES = [name for name in entry.queries() if name not in entry.LLM_QUERIES]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    problem, _ = difference(spark, FOLDER, entry.queries()[name], entry.oracle_sql().get(name))
    assert problem == ""


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    frame = entry.QUERIES[entry.FLAGSHIP](spark, FOLDER)
    assert frame.columns == ["lang", "files", "with_personal_data", "matches", "risk_sum"]
    assert frame.count() > 0
