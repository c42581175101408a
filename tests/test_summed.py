"""Exports sum shared features once; the sums are those of whole feature lists."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from brindle.functions import scalars as S
from brindle.operators import assemble
from brindle.plans import queries

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("profile", ["f4", "f5"])
def test_sums_are_those_of_feature_lists(spark, profile):
    """Besides, no list is hashed or summed for each row: what whole rows come to after their joins has no lambda."""
    got = queries.QUERIES[f"export_{profile}"](spark, D)
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    whole = assemble.dataset(queries._assembled(spark, D, profile), profile)
    add = lambda f: F.aggregate("features", F.lit(0).cast("long"), lambda s, x: s + f(x))
    want = whole.select(*queries.ROW, "n_features", F.round("norm", 6).alias("norm"), add(lambda x: x["index"]).alias("index_sum"), add(lambda x: x["field"]).alias("field_sum"), add(lambda x: x["field"] * x["index"]).alias("cross_sum"))
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_hash_without_lambdas(spark):
    rows = spark.createDataFrame([(x,) for x in (0, 1, 2**31, 2**32 - 1, -1, 2**62, None)], "x long").select(S.hashed(7, F.col("x"), 200).alias("a"), S.hashed_column(7, F.col("x"), 200).alias("b")).collect()
    assert all(r.a == r.b for r in rows)
