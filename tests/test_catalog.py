"""Every registered query against its SQL on whole tables."""

import pytest

import __spark_entry__ as entry
from check import compare

NAMES = list(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, name):
    assert compare(spark, sf, name) is None


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    out = entry.entry(spark)
    assert out.columns == ["nps_class", "n", "pct_severe", "pct_normal", "pct_missing"]
    assert out.count() > 0


@pytest.mark.parametrize("partitions", ["1", "4", "37"])
@pytest.mark.parametrize("name", ["r1_pivot_first", "a8_percentiles", "c2_spearman_by_join", "l2_folds", "e3_pr_curve"])
def test_result_does_not_depend_on_partitions(spark, sf, name, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert compare(spark, sf, name) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
