"""Symbols of rounds side by side: as in rows, without a row for each round or a second sort."""

import itertools

import pytest
from pyspark.sql import functions as F

from plait import queries
from plait.operators import reads


@pytest.mark.parametrize("lag", [1, 2])
def test_as_in_rows(spark, lag):
    rows = spark.createDataFrame([(i, 0, *b) for i, b in enumerate(itertools.product(["a", "c", None], repeat=4))], "sig_id long, v int, a string, b string, c string, d string")
    long = rows.select("sig_id", "v", F.posexplode(F.array("a", "b", "c", "d")).alias("round", "base"))
    got = reads.stable_symbols_of(rows, ["a", "b", "c", "d"], lag)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, reads.stable_symbols(long, 3, lag).collect()), key=str)


@pytest.mark.parametrize("name", ["oscillation_filter", "oscillation_filter_lag"])
def test_one_aggregation(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate(") == 2 and plan.count("+- Exchange") == 1
