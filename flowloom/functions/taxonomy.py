"""Attack names, ids and groups as column expressions.

The taxonomy is a fixed table of a few words, so a lookup is a literal map inside the projection:
no join, and nothing that grows with the data.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom import fixed_values as fv
from flowloom.schema import CLASS_IDS, class_table


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def is_blank(name: Column) -> Column:
    return name.isNull() | (name == "")


def normalize_attack(name: Column) -> Column:
    """Canonical class of an attack name.

    Null and empty are ``Unknown``; a known word in any case is its class; any other name stays.
    """
    known = F.try_element_at(_literal_map(fv.CLASS_ALIASES), F.lower(name))
    return F.when(is_blank(name), F.lit(fv.UNKNOWN_CLASS)).otherwise(F.coalesce(known, name))


def _lookup_id(name: Column, version: Column) -> Column:
    canonical = normalize_attack(name)
    in_v1, in_v2 = (F.try_element_at(_literal_map(CLASS_IDS[v]), canonical) for v in ("v1", "v2"))
    # Every version other than v2 uses the smaller taxonomy.
    return F.when(version == "v2", in_v2).otherwise(in_v1)


def attack_id(name: Column, version: Column) -> Column:
    """Class id within a dataset version, -1 for a class that version does not know."""
    return F.coalesce(_lookup_id(name, version), F.lit(fv.UNKNOWN_CLASS_ID))


def is_known_attack(name: Column, version: Column) -> Column:
    return _lookup_id(name, version).isNotNull()


def canonical_classes(spark: SparkSession) -> DataFrame:
    """The union of the classes of all versions."""
    versions = [class_table(spark).filter(F.col("dataset_version") == v).select("attack_class") for v in CLASS_IDS]
    first, *rest = versions
    for other in rest:
        first = first.union(other)
    return first.distinct()


_GROUPS = (
    ("rare", fv.RARE_CLASSES, fv.RARE_CAP),
    ("common", fv.COMMON_CLASSES, fv.COMMON_CAP),
    ("benign", (fv.BENIGN_CLASS.lower(),), fv.BENIGN_CAP),
)
# Classes that the class-capped sample takes without being asked to.
SAMPLED_CLASSES = tuple(word for _, words, _ in _GROUPS for word in words)


def sampling_group(name: Column) -> Column:
    """rare, common, benign or other."""
    groups = _literal_map({word: group for group, words, _ in _GROUPS for word in words})
    return F.coalesce(F.try_element_at(groups, F.lower(name)), F.lit("other"))


def sampling_cap(name: Column, other_cap: int = 0) -> Column:
    """How many rows of a class the class-capped sample takes at most."""
    caps = _literal_map({word: cap for _, words, cap in _GROUPS for word in words})
    return F.coalesce(F.try_element_at(caps, F.lower(name)), F.lit(other_cap))
