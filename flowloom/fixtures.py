"""Flow-shaped views over the star-schema test tables.

The expressions read the same in Spark SQL and in DuckDB, so the oracle builds its inputs from the
same text. Only inputs are shared: every operator has its own SQL in the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators.attribution import LinearExplainer
from flowloom.operators.runlog import stamped
from flowloom.schema import AGENTS, V1

_V2_ONLY = "case when l_linestatus = 'O' then %s end"

FLOW_COLUMNS = {
    "flow_id": "md5(concat_ws('|', cast(l_orderkey as string), cast(l_linenumber as string), "
    "cast(l_partkey as string), cast(l_suppkey as string), cast(cast(l_quantity as int) as string), "
    "cast(cast(floor(l_extendedprice) as bigint) as string)))",
    "request_id": "l_orderkey",
    "ts": "l_shipdate",
    "IPV4_SRC_ADDR": "concat('10.0.', cast(l_suppkey % 256 as string), '.', cast(l_partkey % 256 as string))",
    "L4_SRC_PORT": "cast(l_partkey % 65536 as double)",
    "IPV4_DST_ADDR": "concat('192.168.0.', cast(l_suppkey % 16 as string))",
    "L4_DST_PORT": "cast(case l_linenumber when 1 then 80 when 2 then 443 when 3 then 22 "
    "else 1024 + l_linenumber end as double)",
    "PROTOCOL": "cast(case l_suppkey % 3 when 0 then 6 when 1 then 17 else 1 end as double)",
    "L7_PROTO": "cast(l_partkey % 256 as double)",
    "IN_BYTES": "cast(floor(l_extendedprice) as double)",
    "OUT_BYTES": "cast(floor(l_extendedprice * l_discount) as double)",
    "IN_PKTS": "l_quantity",
    "OUT_PKTS": "case when l_partkey % 100 = 0 then null else cast(floor(l_quantity * l_tax * 10) as double) end",
    "TCP_FLAGS": "cast(l_suppkey % 32 as double)",
    "FLOW_DURATION_MILLISECONDS": "case when l_partkey % 50 = 0 then null else cast(l_orderkey % 5000 as double) end",
    "MIN_TTL": _V2_ONLY % "cast(l_partkey % 64 as double)",
    "MAX_TTL": _V2_ONLY % "cast(64 + l_partkey % 64 as double)",
    "LONGEST_FLOW_PKT": _V2_ONLY % "cast(l_suppkey * 15 % 1514 as double)",
    "RETRANSMITTED_IN_PKTS": _V2_ONLY % "cast(l_suppkey % 4 as double)",
    "ICMP_TYPE": _V2_ONLY % "0.0e0",
    "dataset_version": "case when l_linestatus = 'F' then 'v1' else 'v2' end",
    "attack_hint": "case l_orderkey % 8 when 0 then 'port_scan' when 1 then 'Ransomware' when 2 then 'worm' "
    "when 3 then 'unknown' when 4 then '' when 5 then 'dos' else null end",
    "Attack": "case when l_quantity <= 2 then 'ddos' when l_quantity <= 4 then 'dos' "
    "when l_discount < 0.005 then 'scanning' when l_extendedprice > 90000 then 'theft' "
    "when l_linestatus = 'O' and l_quantity >= 49 then 'ransomware' "
    "when l_linestatus = 'O' and l_suppkey % 32 = 31 then 'injection' "
    "when l_linestatus = 'O' and l_tax > 0.075 and l_quantity >= 46 then 'mitm' else 'Benign' end",
}

EVENT_FLOW_COLUMNS = {
    "event_id": "event_id",
    "ts": "ts",
    "user_id": "user_id",
    "PROTOCOL": "6.0e0",
    "L7_PROTO": "cast(user_id % 256 as double)",
    "IN_BYTES": "cast(floor(value * 100) as double)",
    "OUT_BYTES": "cast(floor(value * 10) as double)",
    "IN_PKTS": "cast(1 + user_id % 50 as double)",
    "OUT_PKTS": "cast(user_id % 20 as double)",
    "TCP_FLAGS": "cast(event_id % 32 as double)",
    "FLOW_DURATION_MILLISECONDS": "cast(event_id % 5000 as double)",
    "Attack": "case event_type when 'error' then 'ddos' when 'signup' then 'scanning' else 'Benign' end",
}

LABEL_SQL = "case when Attack = 'Benign' then 0 else 1 end"

# Features that the flow view carries besides the eight shared ones.
VIEW_V2_FEATURES = ("MIN_TTL", "MAX_TTL", "LONGEST_FLOW_PKT", "RETRANSMITTED_IN_PKTS", "ICMP_TYPE")


def select_list(columns: dict[str, str]) -> list[str]:
    return [f"{sql} as {name}" for name, sql in columns.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow records over ``lineitem``."""
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem.selectExpr(*select_list(FLOW_COLUMNS)).withColumn("Label", F.expr(LABEL_SQL))


def as_event_flows(events: DataFrame) -> DataFrame:
    """Flow records over ``events``; works on a table and on a stream."""
    return events.selectExpr(*select_list(EVENT_FLOW_COLUMNS)).withColumn("Label", F.expr(LABEL_SQL))


def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_event_flows(table(spark, sf_dir, "events"))


# --- further inputs derived from the views -------------------------------------------------------

# Training means of the linear explainers used where results must be exact.
EXPLAINER_MEANS = (6.0, 128.0, 50000.0, 2000.0, 25.0, 10.0, 16.0, 2500.0)


def explainer_weight(agent: int, feature: int) -> float:
    """Weight of a linear explainer, by rule; quarters keep all sums exact."""
    return ((3 * agent + 5 * feature) % 9 - 4) / 4


def linear_explainers() -> list[LinearExplainer]:
    return [
        LinearExplainer(
            a.name,
            {f: explainer_weight(i, j) for j, f in enumerate(V1)},
            dict(zip(V1, EXPLAINER_MEANS)),
        )
        for i, a in enumerate(AGENTS, 1)
    ]


# How votes are spoilt to exercise vote validation: by TCP_FLAGS value.
SPOILT_PREDICTION = "case TCP_FLAGS when 7 then null when 9 then 2 else prediction end"
SPOILT_CONFIDENCE = (
    "case TCP_FLAGS when 3 then cast('NaN' as double) when 5 then cast('Infinity' as double) else confidence end"
)

RUN_STEP_COLUMNS = {
    "run_id": "concat('run-', cast(user_id as string))",
    "dataset_name": "case when user_id % 7 = 0 then null else concat('set-', cast(user_id % 5 as string)) end",
    "step": "event_type",
    "status": "case when event_type = 'purchase' then 'completed' else 'running' end",
    "seconds": "floor(value * 4) / 4.0e0",
    "accuracy": "case when event_type = 'purchase' then (event_id % 1024) / 1024.0e0 end",
    "precision": "case when event_type = 'purchase' then (event_id % 512) / 512.0e0 end",
    "recall": "case when event_type = 'purchase' then (event_id % 256) / 256.0e0 end",
    "f1_score": "case when event_type = 'purchase' then (event_id % 128) / 128.0e0 end",
    "start_time": "ts",
}
# An 'error' event of an odd user is an error, a slow one a warning; every step lasts its whole seconds.
IS_ERROR = "event_type = 'error' and user_id % 2 = 1"
IS_SLOW = "value > 100"


def run_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of runs over ``events``: one run per user, one step per event."""
    events = table(spark, sf_dir, "events")
    shown = F.floor("value").cast("string")

    def messages(condition: str, word: str):
        message = stamped(F.concat(F.lit(word), shown), F.col("ts"))
        return F.when(F.expr(condition), F.array(message)).otherwise(F.array().cast("array<string>"))

    return events.selectExpr(*select_list(RUN_STEP_COLUMNS), "event_type", "user_id", "value", "ts").withColumns(
        {
            "errors": messages(IS_ERROR, "failed at "),
            "warnings": messages(IS_SLOW, "slow by "),
            "end_time": F.expr("ts + make_dt_interval(0, 0, 0, cast(floor(value) as int))"),
        }
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON requests over ``lineitem``: (flow_id, request) with none, one or two flows each.

    Line 7 is cut off in the middle, line 6 holds a numeric string, and null features are left out of the text.
    """
    line = table(spark, sf_dir, "lineitem").selectExpr(*select_list(FLOW_COLUMNS), "l_linenumber")
    carried = [*V1, "MIN_TTL"]

    def flow(i: int):
        fields = [F.col(f).alias(f) for f in carried if f not in ("IN_PKTS", "TCP_FLAGS")]
        fields.append((F.col("IN_PKTS") + i).alias("IN_PKTS"))
        as_text = F.col("TCP_FLAGS").cast("int").cast("string")
        fields.append(F.when(F.col("l_linenumber") == 6, as_text).alias("TCP_FLAGS_TEXT"))
        fields.append(F.when(F.col("l_linenumber") != 6, F.col("TCP_FLAGS")).alias("TCP_FLAGS"))
        return F.struct(*fields)

    body = F.to_json(
        F.struct(
            F.slice(F.array(flow(0), flow(1)), F.lit(1), F.col("l_linenumber") % 3).alias("flows"),
            F.col("dataset_version"),
            F.col("attack_hint").alias("attack_type"),
        )
    )
    body = F.replace(body, F.lit("TCP_FLAGS_TEXT"), F.lit("TCP_FLAGS"))
    cut = F.when(F.col("l_linenumber") == 7, F.substring(body, 1, 40)).otherwise(body)
    return line.select("flow_id", cut.alias("request"))
