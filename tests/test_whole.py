"""Queries that must read every row of their table."""

import pytest
from pyspark.sql import functions as F

from lectern.plans.catalogue import QUERIES, table


@pytest.mark.parametrize(("name", "by"), [("pivot_mask", 3), ("densify_rows", 2)])
def test_sheets_read_the_whole_table(spark, sf_dir, name, by):
    items = table(spark, sf_dir, "lineitem")
    cells = [(F.col("l_suppkey") % 5).alias("sheet"), F.col("l_orderkey").alias("row"), (F.col("l_partkey") % 12).alias("col")][:by]
    out = QUERIES[name](spark, sf_dir)
    assert out.count() == items.select(*cells).distinct().count()
    assert out.agg(F.max("row")).head()[0] == items.agg(F.max("l_orderkey")).head()[0] > 500
