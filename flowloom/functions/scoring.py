"""Detector outputs as column expressions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom import fixed_values as fv
from flowloom.functions.numeric import is_finite, total


def tree_confidence(probability: Column) -> Column:
    """Largest class probability of a tree model's probability vector."""
    return F.array_max(vector_to_array(probability))


def default_confidence(confidence: Column) -> Column:
    """Confidence of a model that gives no probabilities."""
    return F.coalesce(confidence, F.lit(fv.DEFAULT_CONFIDENCE))


def neural_prediction(p: Column) -> Column:
    return (p > fv.NEURAL_CUT).cast("int")


def neural_confidence(p: Column) -> Column:
    return F.abs(p - fv.NEURAL_CUT) * 2


def mean_squared_residual(values: list[Column], rebuilt: list[Column]) -> Column:
    squares = [(v - r) * (v - r) for v, r in zip(values, rebuilt, strict=True)]
    return total(squares) / float(len(squares))


def reconstruction_prediction(error: Column, threshold: Column | float) -> Column:
    return (error > threshold).cast("int")


def reconstruction_confidence(error: Column, threshold: Column | float) -> Column:
    return F.least(F.abs(error - threshold) / threshold, F.lit(1.0))


def is_valid_vote(prediction: Column, confidence: Column) -> Column:
    """A vote counts when it names one of the two classes with a finite confidence."""
    return F.coalesce(prediction.isin(0, 1), F.lit(False)) & is_finite(confidence)


# Rule per detector as (condition, confidence if it holds, confidence if not).
# The rules stand in for trained models where results must be exactly repeatable; all confidences
# are dyadic fractions, so that vote sums do not depend on the order of addition.
RULES = {
    "agent_1_xgboost_v1": ("IN_PKTS <= 4", 0.9375, 0.75),
    "agent_2_xgboost_v2": ("IN_PKTS <= 4 or IN_PKTS >= 49", 0.96875, 0.625),
    "agent_3_lstm_v1": ("OUT_BYTES < 256", 0.5, 0.375),
    "agent_4_lstm_v2": ("LONGEST_FLOW_PKT >= 1024", 0.625, 0.25),
    "agent_5_rf_v1": ("IN_BYTES > 90000", 0.875, 0.6875),
    "agent_6_rf_v2": ("TCP_FLAGS >= 31", 0.8125, 0.5625),
    "agent_7_unknown": ("OUT_PKTS > 32", 1.0, 0.125),
}


def score_by_rules(aligned: DataFrame, agents) -> DataFrame:
    """Prediction and confidence of each detector's rule, over canonically aligned flows."""
    columns = {}
    for agent in agents:
        rule, if_anomaly, if_benign = RULES[agent.name]
        hit = F.expr(rule)
        columns[agent.prediction] = hit.cast("int")
        columns[agent.confidence] = F.when(hit, F.lit(if_anomaly)).otherwise(F.lit(if_benign))
    return aligned.withColumns(columns)
