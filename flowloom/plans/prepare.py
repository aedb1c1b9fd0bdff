"""Data preparation jobs: from raw tables to scaled training and test rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from flowloom import fixed_values as fv
from flowloom.operators import sampling
from flowloom.operators.cleanse import align, common_numeric_features, drop_incomplete, features_and_label, tag_version
from flowloom.operators.scaling import fit_bounds, scale
from flowloom.operators.profile import profile
from flowloom.schema import CANONICAL, V1
from flowloom.session import write_table
from flowloom.sources.flows import first_rows
from flowloom.sources.sinks import write_test_classes


def split_and_scale(
    df: DataFrame, features: Sequence[str], identity: str, test_share: float = fv.TEST_SHARE, seed: int = fv.SEED
) -> DataFrame:
    """Stratified split by label, then scaling of all rows by the bounds of the training rows.

    The split rows are written, since both the bounds and the result read them.
    """
    split = write_table(sampling.stratified_split(df, identity, fv.LABEL_COLUMN, test_share, seed), "split-rows")
    bounds = fit_bounds(split.filter("split = 'train'"), features)
    return scale(split, bounds, features)


def prepare(
    df: DataFrame, identity: str, features: Sequence[str] = V1, test_share: float = fv.TEST_SHARE, seed: int = fv.SEED
) -> DataFrame:
    """One dataset: complete rows, features with label and class, split and scaled."""
    columns = [*features, fv.ATTACK_COLUMN, fv.LABEL_COLUMN]
    rows = features_and_label(drop_incomplete(df.select(identity, *columns), columns), keep_attack=True)
    return split_and_scale(rows, features, identity, test_share, seed)


def mix(
    v1: DataFrame,
    v2: DataFrame,
    identity: str,
    v1_share: float = 0.5,
    test_share: float = fv.TEST_SHARE,
    seed: int = fv.SEED,
) -> DataFrame:
    """Two dataset versions mixed by share on their common numeric features, split and scaled."""
    features = common_numeric_features(v1, v2, identity)
    columns = [identity, *features, fv.ATTACK_COLUMN, fv.LABEL_COLUMN]
    complete = [
        tag_version(drop_incomplete(df).select(*columns), version) for df, version in ((v1, "v1"), (v2, "v2"))
    ]
    shares = {"v1": v1_share, "v2": 1 - v1_share}
    sampled = sampling.sample_by_ratio(sampling.union_versions(*complete), "dataset_version", shares, identity, seed)
    return split_and_scale(write_table(sampled, "mixed-rows"), features, identity, test_share, seed)


def smart_sample(
    v1: DataFrame,
    v2: DataFrame,
    identity: str,
    target: int = fv.SMART_SAMPLE_SIZE,
    other_cap: int = 0,
    seed: int = fv.SEED,
) -> DataFrame:
    """Both versions together, capped per class and as a whole, aligned to the canonical features."""
    both = sampling.union_versions(drop_incomplete(v1), drop_incomplete(v2))
    capped = write_table(sampling.sample_by_class(both, identity, other_cap, seed), "capped-rows")
    return align(sampling.sample_rows(capped, target, identity, seed), [identity, fv.ATTACK_COLUMN, fv.LABEL_COLUMN])


def prepare_smart(v1: DataFrame, v2: DataFrame, identity: str, **options) -> DataFrame:
    """The class-capped sample of both versions over all canonical features, split and scaled."""
    sample = write_table(smart_sample(v1, v2, identity, **options), "smart-sample")
    return split_and_scale(sample, CANONICAL, identity)


def prepare_table(
    spark: SparkSession,
    path: str,
    identity: str,
    target: str,
    limit: int | None = None,
    features: Sequence[str] = V1,
) -> DataFrame:
    """The whole preparation of one parquet table of flows, from its first ``limit`` rows to files below ``target``.

    ``profile`` has the figures of what was read, ``test-classes`` the classes of the test rows, and ``rows``, which is
    returned, the split and scaled rows.
    """
    table = spark.read.parquet(path) if limit is None else first_rows(spark, path, limit)
    profile(table).write.parquet(f"{target}/profile")
    prepare(table, identity, features).write.parquet(f"{target}/rows")
    rows = spark.read.parquet(f"{target}/rows")
    write_test_classes(rows, f"{target}/test-classes", identity)
    return rows
