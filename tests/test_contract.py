import os

import pytest

import __spark_entry__ as entry_point

SMALL = "/root/testdata/sf0.001"


def test_checks_belong_to_queries():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert len(entry_point.queries()) > 200


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the generated tables")
def test_entry_counts_every_product(spark):
    rows = entry_point.entry(spark).collect()
    parts = spark.read.parquet(f"{SMALL}/part.parquet").count()
    assert sum(r.products for r in rows) == parts
    assert {r.tier for r in rows} <= {"clean", "review", "untagged"}
