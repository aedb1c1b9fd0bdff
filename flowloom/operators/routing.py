"""Which detectors may judge which flow.

Seven detectors are a constant, so routing is a set of boolean expressions per row. Where one row
per (flow, detector) is wanted, a constant array is exploded; no join takes place.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom import fixed_values as fv
from flowloom.functions.numeric import total
from flowloom.functions.taxonomy import is_blank, normalize_attack
from flowloom.operators.cleanse import BITS, compact, presence
from flowloom.schema import AGENTS, POSITION, Agent

HINTED_CLASS = "_hinted_class"


def _overlap(df: DataFrame, required: Sequence[str]) -> Column:
    if BITS in df.columns:
        wanted = sum(1 << POSITION[f] for f in required)
        return F.bit_count(F.col(BITS).bitwiseAND(F.lit(wanted)))
    return total([presence(df, f).cast("int") for f in required], 0)


def has_features(df: DataFrame, agent: Agent) -> Column:
    """Enough of the required features are there."""
    return _overlap(df, agent.required) >= fv.PARTICIPATION_SHARE * len(agent.required)


def knows_hint(agent: Agent, hint: Column, hinted_class: Column | None = None) -> Column:
    """No hint, or one the detector was trained on; ``hinted_class`` is the hint's class if at hand."""
    named = normalize_attack(hint) if hinted_class is None else hinted_class
    return is_blank(hint) | named.isin(*agent.known_classes)


def knows_class(agent: Agent, attack_class: Column) -> Column:
    """Whether the detector can name this class, spelled canonically."""
    return F.coalesce(attack_class.isin(*agent.known_classes), F.lit(False))


def participates(df: DataFrame, agent: Agent, hint: str | None = None) -> Column:
    rule = has_features(df, agent)
    if not hint:
        return rule
    named = F.col(HINTED_CLASS) if HINTED_CLASS in df.columns else None
    return rule & knows_hint(agent, F.col(hint), named)


def _name_hint(df: DataFrame, hint: str | None) -> DataFrame:
    """Look the hint's class up once per row instead of once per detector."""
    return df.withColumn(HINTED_CLASS, normalize_attack(F.col(hint))) if hint else df


def route(df: DataFrame, hint: str | None = None, agents: Iterable[Agent] = AGENTS) -> DataFrame:
    """Add one boolean column per detector.

    Reads the presence bits of an aligned table, otherwise the (nullable) feature columns.
    """
    named = _name_hint(df, hint)
    return named.withColumns({a.routed: participates(named, a, hint) for a in agents}).drop(HINTED_CLASS)


def route_long(df: DataFrame, hint: str | None = None, agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """One row per flow and detector that may judge it, with the columns of the flow and ``agent``."""
    named = _name_hint(df, hint)
    names = compact([F.when(participates(named, a, hint), F.lit(a.name)) for a in agents])
    # The outer form keeps the optimizer from testing the array for emptiness by computing it twice.
    return named.withColumn("agent", F.explode_outer(names)).drop(HINTED_CLASS).filter("agent is not null")


def participating(agents: Sequence[Agent] = AGENTS) -> Column:
    """Names of the detectors that may judge a routed row, in catalogue order."""
    return compact([F.when(F.col(a.routed), F.lit(a.name)) for a in agents])


def abstaining(agents: Sequence[Agent] = AGENTS, loaded: Iterable[str] | None = None) -> Column:
    """Names of the loaded detectors that do not take part in a routed row."""
    there = {a.name for a in agents} if loaded is None else set(loaded)
    return compact([F.when(~F.col(a.routed), F.lit(a.name)) for a in agents if a.name in there])


def routed_to(df: DataFrame, agent: Agent, hint: str | None = None) -> DataFrame:
    """Only the flows one detector may judge."""
    return df.filter(participates(df, agent, hint))


def classify_table(df: DataFrame, class_column: str, agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """Per detector and class found in the table: rows, and whether the detector can name the class."""
    per_class = df.groupBy(F.col(class_column).alias("attack_class")).agg(F.count("*").alias("flows"))
    answers = F.array(
        *[F.struct(F.lit(a.name).alias("agent"), knows_class(a, F.col("attack_class")).alias("known")) for a in agents]
    )
    return per_class.select("attack_class", "flows", F.inline(answers))


def routing_summary(df: DataFrame, hint: str, agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """Flows per hint and detector.

    Counts the flows of each hint per detector in one wide pass, then unfolds, so that the shuffle
    carries one row per hint instead of seven per flow.
    """
    named = _name_hint(df, hint)
    counts = [F.count_if(participates(named, a, hint)).alias(a.routed) for a in agents]
    wide = named.groupBy(hint).agg(*counts)
    pairs = F.array(*[F.struct(F.lit(a.name).alias("agent"), F.col(a.routed).alias("flows")) for a in agents])
    return wide.select(hint, F.inline(pairs)).filter(F.col("flows") > 0)
