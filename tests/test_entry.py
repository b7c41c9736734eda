import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from check import connect, differences  # noqa: E402
from tests.conftest import SF_DIR  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry._QUERIES))
def test_query_equals_its_sql(spark, con, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    if name in entry.oracle_sql():
        assert differences(got, con.execute(entry.oracle_sql()[name]).df()) == ""
    else:
        assert len(got) > 0


def test_every_sql_text_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry._QUERIES) - set(entry.oracle_sql()) == {"congestion_gbt", "feature_importance"}


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 50
