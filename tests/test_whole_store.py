"""The prototype store over all rows of all labels."""

from parity import compare

import __spark_entry__ as entry


def test_whole_store(spark):
    assert compare(spark, "/root/testdata/sf0.001", "s10_prototype_store", entry.queries(), entry.oracle_sql()) == ""
