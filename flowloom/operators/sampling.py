"""Exact seeded sampling and splitting without giving a whole class to one task.

To take the k rows of a group with the smallest order keys, ranking the group would put all its
rows into one task. Instead the keys are counted by a short prefix, which combines well before the
shuffle, and the running count names the bucket in which the k-th row lies. Only the rows of those
buckets (1 in 256) are looked at again, counted by a longer prefix, and only the rows of the bucket
found then (1 in a million) are ranked. The k-th key is a cut: one short text per group. Up to
``MAX_GROUPS`` groups the cuts enter the plan as constants, so selecting is a filter on the full table,
without a join or a shuffle, whatever the planner's settings. Beyond that the buckets and cuts stay tables
and are joined on (group, key prefix): each cut is repeated for the 256 two-digit prefixes up to its own,
so the rows of one group, even one with a third of the table, are spread over 256 join keys, and the
repeated table grows with the number of groups, never with their rows. Both ways give the same rows.

Row identities must be unique; copies of one row need identities of their own
(``sources.flows.with_row_identity`` gives them).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom import fixed_values as fv
from flowloom.functions.numeric import hash_fraction, hash_order
from flowloom.functions.taxonomy import SAMPLED_CLASSES, sampling_cap
from flowloom.session import write_table

_GROUP, _KEY, _BUCKET, _CUT = "_group", "_key", "_bucket", "_cut"
_COARSE, _FINE = 2, 5  # hexadecimal digits of the order key
#: Groups whose cuts fit a plan as constants; more are joined as a table.
MAX_GROUPS = 10_000
_PREFIXES = 16**_COARSE

_EVERYTHING = "*"  # the one group of a table that is sampled as a whole

QuotaRule = Callable[[DataFrame], DataFrame]


def _histogram(keyed: DataFrame, digits: int) -> DataFrame:
    return keyed.groupBy(_GROUP, F.substring(_KEY, 1, digits).alias(_BUCKET)).agg(F.count("*").alias("n"))


def _edges(histogram: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per group the bucket that holds its row number ``nth``, and the number of that row inside it."""
    upto = F.sum("n").over(Window.partitionBy(_GROUP).orderBy(_BUCKET))
    return (
        histogram.withColumn("upto", upto)
        .join(wanted, F.col(_GROUP).eqNullSafe(F.col("_g")))
        .filter((F.col("upto") >= F.col("nth")) & (F.col("upto") - F.col("n") < F.col("nth")))
        .select("_g", F.col(_BUCKET).alias("_b"), (F.col("nth") - F.col("upto") + F.col("n")).alias("nth"))
    )


def _constants(table: DataFrame, group: str, value: str) -> dict:
    """A small table (group, value) as constants; at most ``MAX_GROUPS`` rows (checked by the caller)."""
    return {r[group]: r[value] for r in table.select(group, value).collect()}


def _few(table: DataFrame) -> bool:
    """Whether a table of one row per group has at most ``MAX_GROUPS`` rows."""
    return table.limit(MAX_GROUPS + 1).count() <= MAX_GROUPS


def _of_group(group: Column, constants: dict) -> Column:
    """The constant of a row's group, null for other groups."""
    named = {g: v for g, v in constants.items() if g is not None}
    value = F.lit(None).cast("string")
    if list(constants) == [_EVERYTHING]:
        return F.lit(constants[_EVERYTHING])
    if named:
        pairs = [F.lit(x) for g, v in named.items() for x in (str(g), v)]
        value = F.try_element_at(F.create_map(*pairs), group.cast("string"))
    if None in constants:
        value = F.when(group.isNull(), F.lit(constants[None])).otherwise(value)
    return value


def _in_bucket(keyed: DataFrame, buckets: DataFrame, digits: int, few: bool) -> DataFrame:
    """Rows of ``keyed`` whose key starts with their group's bucket ``_b``: a filter on constants, or a semi join on
    (group, prefix), which spreads a large group over its prefixes."""
    prefix = F.substring(_KEY, 1, digits)
    if few:
        return keyed.filter(prefix == _of_group(F.col(_GROUP), _constants(buckets, "_g", "_b")))
    on = F.col(_GROUP).eqNullSafe(F.col("_g")) & (prefix == F.col("_b"))
    return keyed.join(buckets.select("_g", "_b"), on, "left_semi")


def cut_table(df: DataFrame, group: Column, identity: str, quota: QuotaRule, seed: int = fv.SEED) -> tuple[DataFrame, bool]:
    """Per group the order key of its k-th row, as a table (_g, _cut) without groups whose k is 0, and whether
    there are at most ``MAX_GROUPS`` such groups.

    ``quota`` maps a table (_group, n) of group sizes to one with an added column ``quota``.
    """
    keyed = df.select(group.cast("string").alias(_GROUP), hash_order(F.col(identity), seed).alias(_KEY))
    coarse = write_table(_histogram(keyed, _COARSE), "key-histogram")
    wanted = quota(coarse.groupBy(_GROUP).agg(F.sum("n").alias("n"))).select(
        F.col(_GROUP).alias("_g"), F.least("quota", "n").alias("nth")
    )
    edges = write_table(_edges(coarse, wanted), "cut-buckets")
    few = _few(edges)
    near = write_table(_in_bucket(keyed, edges, _COARSE, few), "near-cuts")
    fine = write_table(_edges(_histogram(near, _FINE), edges.select("_g", "nth")), "fine-buckets")
    rank = F.row_number().over(Window.partitionBy(_GROUP).orderBy(_KEY))
    last = _in_bucket(near, fine, _FINE, few).withColumn("rank", rank)
    cuts = last.join(fine, F.col(_GROUP).eqNullSafe(F.col("_g"))).filter("rank = nth")
    return write_table(cuts.select(F.col(_GROUP).alias("_g"), F.col(_KEY).alias("_cut")), "cuts"), few


def cut_keys(df: DataFrame, group: Column, identity: str, quota: QuotaRule, seed: int = fv.SEED) -> dict:
    """Per group the order key of its k-th row, without groups whose k is 0; at most ``MAX_GROUPS`` groups."""
    cuts, few = cut_table(df, group, identity, quota, seed)
    if not few:
        raise ValueError(f"more than {MAX_GROUPS} groups: use cut_table")
    return _constants(cuts, "_g", "_cut")


def _marked(df: DataFrame, group: Column, identity: str, quota: QuotaRule, seed: int, flag: str) -> DataFrame:
    """``df`` with ``flag`` true for exactly the quota of each group (rows whose order key is at most its cut)."""
    cuts, few = cut_table(df, group, identity, quota, seed)
    key = hash_order(F.col(identity), seed)
    if few:
        return df.withColumn(flag, F.coalesce(key <= _of_group(group, _constants(cuts, "_g", "_cut")), F.lit(False)))
    g, k, cg, cut, p = (f"__sampling_{n}" for n in ("group", "key", "cut_group", "cut", "prefix"))
    keyed = df.withColumns({g: group.cast("string"), k: key})
    prefixes = F.transform(F.sequence(F.lit(0), F.lit(_PREFIXES - 1)), lambda i: F.lower(F.lpad(F.hex(i), _COARSE, "0")))
    salted = cuts.select(F.col("_g").alias(cg), F.col("_cut").alias(cut), F.explode(prefixes).alias(p))
    # It grows with the groups, and its parquet files compress far below its size in memory: never broadcast.
    salted = write_table(salted.filter(F.col(p) <= F.substring(cut, 1, _COARSE)), "salted-cuts").hint("merge")
    on = F.col(g).eqNullSafe(F.col(cg)) & (F.substring(k, 1, _COARSE) == F.col(p))
    joined = keyed.join(salted, on, "left")
    return joined.withColumn(flag, F.coalesce(F.col(k) <= F.col(cut), F.lit(False))).drop(g, k, cg, cut, p)


def mark_selected(
    df: DataFrame, group: Column, identity: str, quota: QuotaRule, seed: int = fv.SEED, flag: str = "selected"
) -> DataFrame:
    """Add a boolean column that is true for exactly the quota of each group."""
    return _marked(df, group, identity, quota, seed, flag)


def _selected(df: DataFrame, group: Column, identity: str, quota: QuotaRule, seed: int) -> DataFrame:
    """Only the quota of each group."""
    flag = "__sampling_selected"
    return _marked(df, group, identity, quota, seed, flag).filter(F.col(flag)).drop(flag)


def sample_by_ratio(
    df: DataFrame, group: str, ratios: Mapping[str, float], identity: str, seed: int = fv.SEED
) -> DataFrame:
    """floor(n * ratio) rows of each named group; rows of other groups are left out."""

    def quota(sizes: DataFrame) -> DataFrame:
        share = F.lit(0.0)
        for value, ratio in ratios.items():
            share = F.when(F.col(_GROUP) == value, F.lit(float(ratio))).otherwise(share)
        return sizes.withColumn("quota", F.floor(F.col("n") * share).cast("bigint"))

    return _selected(df, F.col(group), identity, quota, seed)


def sample_rows(df: DataFrame, n: int, identity: str, seed: int = fv.SEED) -> DataFrame:
    """Exactly n rows of a table, or all of them if it has fewer."""
    return _selected(df, F.lit(_EVERYTHING), identity, lambda sizes: sizes.withColumn("quota", F.lit(n).cast("bigint")), seed)


def sample_by_class(df: DataFrame, identity: str, other_cap: int = 0, seed: int = fv.SEED) -> DataFrame:
    """At most the cap of each class: all of the rare ones, a part of the common ones and of benign.

    Other classes are dropped unless ``other_cap`` gives each of them a cap.
    """
    word = F.lower(F.col(fv.ATTACK_COLUMN))
    kept = df.filter(word.isNotNull()) if other_cap else df.filter(word.isin(*SAMPLED_CLASSES))

    def quota(sizes: DataFrame) -> DataFrame:
        return sizes.withColumn("quota", sampling_cap(F.col(_GROUP), other_cap).cast("bigint"))

    return _selected(kept, word, identity, quota, seed)


def shuffle_rows(df: DataFrame, identity: str, seed: int = fv.SEED) -> DataFrame:
    """All rows in seeded random order: a range-partitioned sort by the order key."""
    return df.withColumn(_KEY, hash_order(F.col(identity), seed)).orderBy(_KEY).drop(_KEY)


def spread_rows(df: DataFrame, identity: str, partitions: int, seed: int = fv.SEED) -> DataFrame:
    """Rows spread evenly and at random over partitions, each in seeded random order.

    Enough for training, and cheaper than a total order: no sampling pass for the ranges.
    """
    keyed = df.withColumn(_KEY, hash_order(F.col(identity), seed))
    return keyed.repartition(partitions, _KEY).sortWithinPartitions(_KEY).drop(_KEY)


def _test_quota(test_share: float) -> QuotaRule:
    """ceil(total * share) test rows, given out over the classes by largest remainder."""

    def quota(sizes: DataFrame) -> DataFrame:
        # One row per class: a window over all of them is small.
        everything = Window.partitionBy(F.lit(0))
        per_class = sizes.select(
            _GROUP, F.col("n").cast("decimal(18,0)").alias("n"), F.sum("n").over(everything).cast("decimal(18,0)").alias("all_n")
        ).withColumn("tests", F.ceil(F.col("all_n").cast("double") * test_share).cast("decimal(18,0)"))
        parts = per_class.withColumn("base", F.expr("(tests * n) div all_n")).withColumn(
            "rest", F.expr("(tests * n) % all_n")
        )
        order = everything.orderBy(F.desc("rest"), F.asc(_GROUP))
        left_over = F.col("tests").cast("bigint") - F.sum("base").over(everything)
        extra = (F.row_number().over(order) <= left_over).cast("bigint")
        return parts.select(_GROUP, F.col("n").cast("bigint").alias("n"), (F.col("base") + extra).alias("quota"))

    return quota


def stratified_split(
    df: DataFrame, identity: str, strata: str = fv.LABEL_COLUMN, test_share: float = fv.TEST_SHARE, seed: int = fv.SEED
) -> DataFrame:
    """Add ``split``: exactly ceil(n * share) rows are 'test', in proportion to the strata."""
    marked = mark_selected(df, F.col(strata), identity, _test_quota(test_share), seed, "_test")
    return marked.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def quick_split(df: DataFrame, identity: str, test_share: float = fv.TEST_SHARE, seed: int = fv.SEED) -> DataFrame:
    """Add ``split`` by the row's hash alone: one pass, no shuffle, shares met in expectation.

    The hash does not depend on the class, so every class is split in the same proportion.
    """
    is_test = hash_fraction(F.col(identity), seed) < test_share
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def background_sample(df: DataFrame, identity: str, n: int = fv.BACKGROUND_ROWS, seed: int = fv.SEED) -> DataFrame:
    """A small fixed-size sample as reference for attributions; its bound makes it fit a broadcast."""
    return df.orderBy(hash_order(F.col(identity), seed)).limit(n)


def union_versions(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by column name; columns that a table lacks are null."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
