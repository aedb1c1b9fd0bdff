"""Min-max scaling with bounds from the training rows.

Spark's own scaler maps a constant column to the middle of the range; here it becomes 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def fit_bounds(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row with the struct columns ``low`` and ``high``: the bounds of every feature, in one pass."""
    bounds = df.agg(
        *[F.min(f).alias(f"min_{i}") for i, f in enumerate(features)],
        *[F.max(f).alias(f"max_{i}") for i, f in enumerate(features)],
    )
    return bounds.select(
        F.struct(*[F.col(f"min_{i}").alias(f) for i, f in enumerate(features)]).alias("low"),
        F.struct(*[F.col(f"max_{i}").alias(f) for i, f in enumerate(features)]).alias("high"),
    )


def _scaled(feature: str, low: float | None, high: float | None) -> Column:
    value = F.col(feature)
    if low is None:
        return F.lit(None).cast("double")
    if high == low:
        return F.when(value.isNotNull(), F.lit(0.0))
    return (value - F.lit(low)) / F.lit(high - low)


def scale(df: DataFrame, bounds: DataFrame | Row, features: Sequence[str]) -> DataFrame:
    """Scale features in place, without clipping values outside the bounds.

    The one row of bounds is a model parameter: it is computed here and enters the plan as constants,
    so scaling is plain arithmetic per row.
    """
    fitted = bounds.first() if isinstance(bounds, DataFrame) else bounds
    return df.withColumns({f: _scaled(f, fitted["low"][f], fitted["high"][f]) for f in features})


def scaling_stage(bounds: Row, features: Sequence[str], suffix: str = "_scaled") -> SQLTransformer:
    """The fitted scaler as a stage that is saved inside a model, from the collected row of bounds."""
    columns = []
    for f in features:
        low, high = bounds["low"][f], bounds["high"][f]
        if low is None or high == low:
            columns.append(f"0.0D AS {f}{suffix}")
        else:
            columns.append(f"({f} - double('{low!r}')) / (double('{high!r}') - double('{low!r}')) AS {f}{suffix}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")
