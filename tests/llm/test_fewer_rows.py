"""Wide rows are left out before the joins of near-duplicate detection."""

import numpy as np
from pyspark.sql import functions as F

from flowloom.llm import near_dup


def test_among(spark, monkeypatch):
    rows = spark.range(-20_000, 20_000).select(F.col("id").alias("k"), F.lit("text").alias("t"))
    rows = rows.unionByName(rows.filter("k < -19900")).unionByName(spark.createDataFrame([(None, "t")], "k long, t string"))
    wanted = rows.filter("k % 97 = 0").select("k").distinct()
    want = sorted(r.k for r in rows.filter("k % 97 = 0").collect())
    for most in (near_dup.MOST_FILTER_BITS, 1):  # also where nearly every hash is taken
        monkeypatch.setattr(near_dup, "MOST_FILTER_BITS", max(most, near_dup._FILTER_PART))
        found = near_dup.among(rows, "k", wanted)
        assert found.columns == ["k", "t"]
        assert sorted(r.k for r in found.collect()) == want
    assert near_dup.among(rows, "k", wanted.limit(0)).collect() == []
    # What the join shuffles has passed the filter: the planner must not move the join below it.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("bitmap_construct_agg") and "LeftSemi" not in plan


def test_a_pair_is_named_in_its_first_band_only():
    signatures = np.zeros((3, near_dup.PERMUTATIONS * 2), np.uint8)
    signatures[2] = np.arange(len(signatures[2])) % 251 + 1
    roots, blocks = np.array([5, 6, 7]), np.zeros(3, np.int64)
    assert near_dup.alike(roots, blocks, signatures, [{1}, {2}, set()]) == [(1, 0)]
    assert near_dup.alike(roots, blocks, signatures, [{1}, {1, 2}, set()]) == []
