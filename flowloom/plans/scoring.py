"""Batch scoring: flows in, decisions out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.scoring import score_by_rules
from flowloom.operators.cleanse import align
from flowloom.operators.routing import route
from flowloom.operators.voting import vote
from flowloom.schema import AGENTS, Agent

Scorer = Callable[[DataFrame, Sequence[Agent]], DataFrame]


def score_flows(
    flows: DataFrame,
    keep: Sequence[str],
    *,
    hint: str | None = None,
    scorer: Scorer = score_by_rules,
    agents: Sequence[Agent] = AGENTS,
) -> DataFrame:
    """Align, route and score flows: canonical features plus three columns per detector.

    ``scorer`` adds prediction and confidence columns; rules by default, trained models through
    ``plans.training.Registry.score``. Works on tables and on streams, without a shuffle.
    """
    kept = [*keep, hint] if hint and hint not in keep else list(keep)
    needed = dict.fromkeys(f for a in agents for f in a.required)
    aligned = align(flows, kept, track=tuple(needed))
    return scorer(route(aligned, hint, agents), agents)


def decide_flows(flows: DataFrame, keep: Sequence[str], **options) -> DataFrame:
    """Score flows and decide by vote; adds prediction, confidence, vote_benign and vote_anomaly."""
    return vote(score_flows(flows, keep, **options), options.get("agents", AGENTS))


def decision_summary(decided: DataFrame, by: str = "Attack") -> DataFrame:
    """Flows per class and decision."""
    return decided.groupBy(by, "prediction").agg(F.count("*").alias("flows"))
