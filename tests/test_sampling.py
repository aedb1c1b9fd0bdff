"""Exact quotas per group beyond the groups that fit a plan as constants: cuts joined on (group, key prefix)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowloom.functions.numeric import hash_order
from flowloom.operators import sampling


def _half(sizes):
    return sizes.withColumn("quota", (F.col("n") - F.floor(F.col("n") / 2)).cast("bigint"))


def _brute_force(df, group, seed=sampling.fv.SEED):
    rank = F.row_number().over(Window.partitionBy(group).orderBy(hash_order(F.col("id"), seed)))
    size = F.count("*").over(Window.partitionBy(group))
    return df.withColumn("expected", rank <= size - F.floor(size / 2))


def test_fifty_thousand_groups_and_one_with_a_third_of_the_rows(spark):
    rows = spark.range(150_000).withColumn(
        "g",
        F.when(F.col("id") < 50_000, F.lit(0))
        .when(F.col("id") % 7_777 == 0, F.lit(None))
        .otherwise(F.col("id") % 49_999 + 1),
    )
    marked = sampling.mark_selected(rows, F.col("g"), "id", _half)
    assert marked.columns == ["id", "g", "selected"]
    checked = _brute_force(marked, "g")
    found = checked.agg(
        F.count("*").alias("rows"),
        F.sum((F.col("selected") != F.col("expected")).cast("int")).alias("wrong"),
        F.countDistinct("g").alias("groups"),
        F.sum(F.when(F.col("g") == 0, F.col("selected").cast("int"))).alias("hot"),
    ).first()
    assert found.rows == 150_000 and found.wrong == 0 and found.groups == 49_999 + 1 and found.hot == 25_000


def test_constants_and_the_join_choose_the_same_rows(spark, monkeypatch):
    rows = spark.range(3_000).withColumn("g", F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id") % 40))
    rows = rows.withColumn("selected", F.lit("a clashing column"))
    few = sampling.mark_selected(rows, F.col("g"), "id", _half, flag="picked")
    monkeypatch.setattr(sampling, "MAX_GROUPS", 5)
    many = sampling.mark_selected(rows, F.col("g"), "id", _half, flag="picked")
    assert many.columns == few.columns == ["id", "g", "selected", "picked"]
    assert sorted(few.collect()) == sorted(many.collect())
    assert _brute_force(many, "g").filter(F.col("picked") != F.col("expected")).count() == 0
    assert sampling.sample_rows(spark.range(0), 5, "id").count() == 0
