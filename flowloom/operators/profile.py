"""Dataset profiles and class distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom import fixed_values as fv
from flowloom.functions.numeric import ratio


def class_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per class, split by label; the only pass over the flows that a profile needs."""
    return df.groupBy(*by, fv.ATTACK_COLUMN).agg(
        F.count("*").alias("total"),
        F.count_if(F.col(fv.LABEL_COLUMN) == 0).alias("benign"),
        F.count_if(F.col(fv.LABEL_COLUMN) == 1).alias("malicious"),
    )


def profile(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total, benign and malicious rows and the sorted classes, over all or per group.

    Classes are counted first, so the list is built from one row per class, not from flows.
    """
    return (
        class_counts(df, by)
        .groupBy(*by)
        .agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "benign", "malicious")],
            F.array_sort(F.collect_list(fv.ATTACK_COLUMN)).alias("classes"),
        )
    )


def class_distribution(df: DataFrame) -> DataFrame:
    """Rows per class with their percentage of all rows."""
    counts = df.groupBy(fv.ATTACK_COLUMN).agg(F.count("*").alias("flows"))
    everything = F.sum("flows").over(Window.partitionBy(F.lit(0)))  # one row per class
    return counts.withColumn("percent", ratio(F.col("flows"), everything) * 100)


def version_profile(df: DataFrame, version: str = "dataset_version") -> DataFrame:
    """The profile of each dataset version with its percentage of all rows."""
    everything = F.sum("total").over(Window.partitionBy(F.lit(0)))  # one row per version
    return profile(df, [version]).withColumn("percent", ratio(F.col("total"), everything) * 100)


def distinct_classes(df: DataFrame) -> DataFrame:
    return df.select(F.lower(fv.ATTACK_COLUMN).alias("attack_class")).distinct()
