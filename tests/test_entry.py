import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not here")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
