import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_catalogue_is_complete():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) >= 50


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "claim_id" in df.columns
