"""From detector outputs to one decision per flow.

The wide forms read one column pair per detector and stay row-local: no shuffle. The long forms
take one row per vote and group.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom import fixed_values as fv
from flowloom.functions.numeric import is_finite, total
from flowloom.functions.scoring import is_valid_vote
from flowloom.operators.routing import abstaining, participating
from flowloom.schema import AGENTS, Agent

UNKNOWN = "unknown"
BENIGN = "benign"
ANOMALY = "anomaly"


def votes_long(scored: DataFrame, keep: Sequence[str], agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """One row per vote of a participating detector: (kept columns, agent, prediction, confidence)."""
    votes = F.array(
        *[
            F.struct(
                F.lit(a.name).alias("agent"),
                F.col(a.prediction).alias("prediction"),
                F.col(a.confidence).alias("confidence"),
                F.col(a.routed).alias("routed"),
            )
            for a in agents
        ]
    )
    return scored.select(*keep, F.inline(votes)).filter("routed").drop("routed")


def mask_missing(scored: DataFrame, loaded: Iterable[str], agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """Detectors without a loaded model predict nothing, with confidence 0.0."""
    there = set(loaded)
    gone = [a for a in agents if a.name not in there]
    return scored.withColumns(
        {a.prediction: F.lit(None).cast("int") for a in gone} | {a.confidence: F.lit(0.0) for a in gone}
    )


def _decide(benign: Column, anomaly: Column, n_benign: Column, n_anomaly: Column) -> dict[str, Column]:
    """Outcome columns from the two weights and the two vote counts.

    A tie is benign. The confidence is the mean of the votes that agree with the outcome; when no
    vote agrees (all weights zero) it is the larger share of the weight.
    """
    is_anomaly = anomaly > benign
    agreeing = F.when(is_anomaly, n_anomaly).otherwise(n_benign)
    weight = F.when(is_anomaly, anomaly).otherwise(benign)
    whole = benign + anomaly
    share = F.when(whole > 0, F.greatest(benign, anomaly) / whole).otherwise(F.lit(0.0))
    none = n_benign + n_anomaly == 0
    return {
        "prediction": F.when(none, UNKNOWN).when(is_anomaly, ANOMALY).otherwise(BENIGN),
        "confidence": F.when(none, F.lit(0.0)).when(agreeing > 0, weight / agreeing).otherwise(share),
        "vote_benign": benign,
        "vote_anomaly": anomaly,
    }


def vote(scored: DataFrame, agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """Add prediction, confidence and the two vote weights to routed and scored flows."""

    def side(wanted: int) -> tuple[Column, Column]:
        # Equal to the wanted class also means that it is one of the two valid classes.
        counts = [
            F.col(a.routed) & (F.col(a.prediction) == wanted) & is_finite(F.col(a.confidence)) for a in agents
        ]
        weights = [F.when(c, F.col(a.confidence)).otherwise(F.lit(0.0)) for c, a in zip(counts, agents)]
        return total(weights), total([F.coalesce(c, F.lit(False)).cast("int") for c in counts], 0)

    (benign, n_benign), (anomaly, n_anomaly) = side(0), side(1)
    tallied = scored.withColumns({"_b": benign, "_a": anomaly, "_nb": n_benign, "_na": n_anomaly})
    outcome = _decide(F.col("_b"), F.col("_a"), F.col("_nb"), F.col("_na"))
    return tallied.withColumns(outcome).drop("_b", "_a", "_nb", "_na")


def vote_long(votes: DataFrame, *keys: str) -> DataFrame:
    """The same decision for a table of votes, one group per key.

    Keys whose votes are all invalid come out as unknown. Sums and counts combine before the
    shuffle, so a key with very many votes is no burden.
    """
    valid = is_valid_vote(F.col("prediction"), F.col("confidence"))

    def side(wanted: int) -> tuple[Column, Column]:
        mine = valid & (F.col("prediction") == wanted)
        weight = F.sum(F.when(mine, F.col("confidence")).otherwise(F.lit(0.0)))
        return weight, F.count_if(mine)

    (benign, n_benign), (anomaly, n_anomaly) = side(0), side(1)
    tallied = votes.groupBy(*keys).agg(
        benign.alias("_b"), anomaly.alias("_a"), n_benign.alias("_nb"), n_anomaly.alias("_na")
    )
    outcome = _decide(F.col("_b"), F.col("_a"), F.col("_nb"), F.col("_na"))
    return tallied.select(*keys, *[c.alias(n) for n, c in outcome.items()])


def collapse_requests(
    scored: DataFrame, request: str, order: str, agents: Sequence[Agent] = AGENTS, carry: Sequence[str] = ()
) -> DataFrame:
    """One routed and scored row per request, so that a request gets one answer.

    Each detector has the prediction it gives for its first row of the request and the mean of its
    confidences. ``order`` ranks the rows of a request and must be unique within it; the columns to
    ``carry`` have the value of its first row. All of it combines before the shuffle, so a request may hold any
    number of flows.
    """
    columns = [F.min_by(c, F.col(order)).alias(c) for c in carry]
    for a in agents:
        there = F.col(a.routed)
        columns += [
            F.coalesce(F.bool_or(there), F.lit(False)).alias(a.routed),
            F.min_by(a.prediction, F.when(there, F.col(order))).alias(a.prediction),
            F.avg(F.when(there, F.col(a.confidence))).alias(a.confidence),
        ]
    return scored.groupBy(request).agg(*columns)


def cast_votes(agents: Sequence[Agent] = AGENTS) -> dict[str, Column]:
    """Per detector whether it takes part in the decision on a flow: routed, with a model and a valid vote."""
    return {
        a.name: F.coalesce(F.col(a.routed) & is_valid_vote(F.col(a.prediction), F.col(a.confidence)), F.lit(False))
        for a in agents
    }


def detected_type(hint: Column, prediction: Column) -> Column:
    """The hint for an anomaly, null for an undecided flow, otherwise Benign."""
    return (
        F.when(prediction == ANOMALY, hint)
        .when(prediction == UNKNOWN, F.lit(None).cast("string"))
        .otherwise(F.lit(fv.BENIGN_CLASS))
    )


def routing_error(agents: Sequence[Agent] = AGENTS) -> Column:
    """Message for rows nobody may judge, otherwise null."""
    anyone = F.lit(False)
    for a in agents:
        anyone = anyone | F.col(a.routed)
    return F.when(~anyone, F.lit(fv.NO_PARTICIPANTS_ERROR))


def result_record(voted: DataFrame, keep: Sequence[str], hint: str, agents: Sequence[Agent] = AGENTS) -> DataFrame:
    """The full answer per flow: decision, who took part, each vote, the two weights, the error."""
    ballots = [
        F.when(
            F.col(a.routed) & F.col(a.prediction).isNotNull(),
            F.struct(
                F.lit(a.name).alias("agent"),
                F.col(a.prediction).alias("prediction"),
                F.col(a.confidence).alias("confidence"),
            ),
        )
        for a in agents
    ]
    none = F.lit(None).cast("struct<agent:string,prediction:int,confidence:double>")
    return voted.select(
        *keep,
        "prediction",
        "confidence",
        participating(agents).alias("participating_agents"),
        abstaining(agents).alias("abstaining_agents"),
        F.array_except(F.array(*ballots), F.array(none)).alias("agent_predictions"),
        F.create_map(
            F.lit(BENIGN), F.col("vote_benign"), F.lit(ANOMALY), F.col("vote_anomaly")
        ).alias("votes"),
        detected_type(F.col(hint), F.col("prediction")).alias("detected_attack_type"),
        routing_error(agents).alias("error"),
    )
