"""Canonical feature space, detector catalogue and table schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from flowloom import fixed_values as fv

V1 = fv.V1_FEATURES
CANONICAL = fv.V1_FEATURES + fv.V2_EXTRA_FEATURES
POSITION = {name: i for i, name in enumerate(CANONICAL)}

CLASS_IDS = {"v1": fv.V1_CLASS_IDS, "v2": fv.V2_CLASS_IDS}
ALL_CLASSES = tuple(dict.fromkeys((*fv.V1_CLASS_IDS, *fv.V2_CLASS_IDS)))


@dataclass(frozen=True)
class Agent:
    """What a detector was trained on and what it needs in order to judge a flow."""

    name: str
    dataset_version: str
    model_type: str
    required: tuple[str, ...]
    known_classes: tuple[str, ...]
    features: tuple[str, ...]

    @property
    def prediction(self) -> str:
        return f"{self.name}__prediction"

    @property
    def confidence(self) -> str:
        return f"{self.name}__confidence"

    @property
    def routed(self) -> str:
        return f"{self.name}__routed"


def _agent(name: str, version: str, model_type: str) -> Agent:
    # Version v2 detectors take the whole feature space but are routed by the eight shared features.
    known = {"v1": tuple(fv.V1_CLASS_IDS), "v2": tuple(fv.V2_CLASS_IDS)}.get(
        version, ALL_CLASSES + (fv.UNKNOWN_CLASS,)
    )
    return Agent(name, version, model_type, V1, known, CANONICAL if version == "v2" else V1)


AGENTS = tuple(_agent(*row) for row in fv.AGENT_ROWS)


def doubles(names) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


def flow_table(features=CANONICAL, *, identified: bool = False, dataset: bool = False) -> T.StructType:
    """Schema of a raw flow table, in file order; given explicitly so that no read infers types."""
    src, sport, dst, dport = fv.ADDRESS_COLUMNS
    fields = [T.StructField("flow_id", T.StringType())] if identified else []
    fields += [
        T.StructField(src, T.StringType()),
        T.StructField(sport, T.DoubleType()),
        T.StructField(dst, T.StringType()),
        T.StructField(dport, T.DoubleType()),
        *doubles(features),
        T.StructField(fv.ATTACK_COLUMN, T.StringType()),
        T.StructField(fv.LABEL_COLUMN, T.IntegerType()),
    ]
    if dataset:
        fields.append(T.StructField(fv.DATASET_COLUMN, T.StringType()))
    return T.StructType(fields)


# Features travel as text inside a request so that numbers and numeric strings are both accepted.
REQUEST = T.StructType(
    [
        T.StructField("flows", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in CANONICAL]))),
        T.StructField("dataset_version", T.StringType()),
        T.StructField("attack_type", T.StringType()),
    ]
)

RESPONSE = T.StructType(
    [
        T.StructField("flow_id", T.StringType()),
        T.StructField("prediction", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("participating_agents", T.ArrayType(T.StringType())),
        T.StructField("abstaining_agents", T.ArrayType(T.StringType())),
        T.StructField("explanation", T.StringType()),
        T.StructField("votes", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("detected_attack_type", T.StringType()),
    ]
)

RUN_LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("dataset_name", T.StringType()),
        T.StructField("step", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("errors", T.ArrayType(T.StringType())),
        T.StructField("warnings", T.ArrayType(T.StringType())),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("f1_score", T.DoubleType()),
        T.StructField("start_time", T.TimestampNTZType()),
        T.StructField("end_time", T.TimestampNTZType()),
    ]
)


def agent_table(spark: SparkSession, agents=AGENTS) -> DataFrame:
    """One row per detector: version, model type, required features, known classes, width."""
    return spark.createDataFrame(
        [
            (i, a.name, a.dataset_version, a.model_type, list(a.required), list(a.known_classes), len(a.features))
            for i, a in enumerate(agents)
        ],
        "position int, agent string, dataset_version string, model_type string, "
        "required_features array<string>, known_attacks array<string>, feature_count int",
    )


def feature_table(spark: SparkSession) -> DataFrame:
    """One row per canonical feature: position, name and the version that introduced it."""
    return spark.createDataFrame(
        [(i, n, "v1" if n in V1 else "v2") for i, n in enumerate(CANONICAL)],
        "pos int, name string, since_version string",
    )


def class_table(spark: SparkSession) -> DataFrame:
    """One row per (version, class) with its id."""
    return spark.createDataFrame(
        [(v, c, i) for v, ids in CLASS_IDS.items() for c, i in ids.items()],
        "dataset_version string, attack_class string, attack_id int",
    )
