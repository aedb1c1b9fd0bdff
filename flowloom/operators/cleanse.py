"""Projection, filtering and alignment of flow tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom import fixed_values as fv
from flowloom.functions.numeric import total
from flowloom.functions.scoring import is_valid_vote
from flowloom.schema import CANONICAL, POSITION, Agent

BITS = "feature_bits"


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null or NaN in any (given) column; infinite values stay."""
    return df.na.drop("any", subset=list(columns) if columns else None)


def features_and_label(df: DataFrame, *, keep_attack: bool = False) -> DataFrame:
    """Drop the identifier columns (and ``Dataset`` where present), keep features and label.

    The label stays beside the features, because rows of two frames have no common order in Spark.
    """
    unwanted = [*fv.ADDRESS_COLUMNS, fv.DATASET_COLUMN]
    if not keep_attack:
        unwanted.append(fv.ATTACK_COLUMN)
    return df.drop(*unwanted)


def presence(df: DataFrame, feature: str) -> Column:
    """Whether a row carries a feature: its column exists and is not null."""
    return F.col(feature).isNotNull() if feature in df.columns else F.lit(False)


def feature_bits(df: DataFrame, features: Sequence[str] = CANONICAL) -> Column:
    """Presence of every feature as one number: bit i is canonical feature i."""
    present = [f for f in features if f in df.columns]
    return total([F.when(F.col(f).isNotNull(), F.lit(1 << POSITION[f])).otherwise(0) for f in present], 0).cast(
        "bigint"
    )


def has_bit(bits: Column, feature: str) -> Column:
    return bits.bitwiseAND(F.lit(1 << POSITION[feature])) != 0


def align(df: DataFrame, keep: Sequence[str] = (), *, track: Sequence[str] = ()) -> DataFrame:
    """The canonical features in order, zero where missing; other columns only if kept by name.

    ``track`` names features whose presence is to be kept as bits, since filling with zeros loses it.
    """
    columns = [F.col(c) for c in keep if c not in POSITION]
    if track:
        columns.append(feature_bits(df, track).alias(BITS))
    for f in CANONICAL:
        value = F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in df.columns else F.lit(0.0)
        columns.append(value.alias(f))
    return df.select(*columns)


def compact(values: Sequence[Column]) -> Column:
    """Array of the non-null values, which must differ from each other."""
    return F.array_except(F.array(*values), F.array(F.lit(None).cast("string")))


def available_columns(df: DataFrame) -> list[str]:
    """Canonical features among the columns of a table, in canonical order."""
    return [f for f in CANONICAL if f in df.columns]


def missing_columns(df: DataFrame) -> list[str]:
    return [f for f in CANONICAL if f not in df.columns]


def available_features(bits: Column) -> Column:
    """Names of the features a row carries, in canonical order."""
    return compact([F.when(has_bit(bits, f), F.lit(f)) for f in CANONICAL])


def feature_mask(bits: Column) -> Column:
    """One boolean per canonical feature."""
    return F.array(*[has_bit(bits, f) for f in CANONICAL])


def feature_counts(bits: Column) -> tuple[Column, Column]:
    """How many features a row carries and how many it lacks."""
    present = F.bit_count(bits).cast("int")
    return present, F.lit(len(CANONICAL)) - present


def common_numeric_features(left: DataFrame, right: DataFrame, identity: str | None = None) -> list[str]:
    """Sorted names of the columns that are numeric in both tables and can be features; an identity can't."""
    reserved = {identity, *fv.ADDRESS_COLUMNS, fv.ATTACK_COLUMN, fv.LABEL_COLUMN, fv.DATASET_COLUMN}

    def numeric(df: DataFrame) -> set[str]:
        return {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}

    return sorted((numeric(left) & numeric(right)) - reserved)


def tag_version(df: DataFrame, version: str) -> DataFrame:
    return df.withColumn("dataset_version", F.lit(version))


def agent_slice(agent: Agent) -> Column:
    """The feature values an agent reads, in canonical order, from an aligned row."""
    return F.array(*[F.col(f) for f in sorted(agent.features, key=POSITION.__getitem__)])


def of_class(df: DataFrame, name: str) -> DataFrame:
    """Rows of an attack class, whatever the case of its spelling."""
    return df.filter(F.lower(fv.ATTACK_COLUMN) == name.lower())


def valid_votes(votes: DataFrame) -> DataFrame:
    return votes.filter(is_valid_vote(F.col("prediction"), F.col("confidence")))
