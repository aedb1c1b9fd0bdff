"""The registered queries: one per operator, each over whole test tables.

Every function takes (spark, folder of the tables) and returns a DataFrame. Lists and maps are
flattened to text or columns, so that results compare value by value with the SQL of ``oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom import fixed_values as fv
from flowloom import fixtures
from flowloom.functions import scoring, taxonomy, text
from flowloom.functions.numeric import finite_or_zero
from flowloom.operators import attribution, cleanse, metrics, profile, routing, runlog, sampling, scaling, voting
from flowloom.plans import predict, prepare, training
from flowloom.plans.scoring import decide_flows, decision_summary, score_flows
from flowloom.schema import AGENTS, CANONICAL, V1, agent_table, feature_table, flow_table
from flowloom.session import scratch_path, short_methods, write_table
from flowloom.sources import flows as flow_source
from flowloom.sources import requests as request_source
from flowloom.sources import sinks
from flowloom.streaming import monitor
from flowloom.streaming import responses as answering

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RAW = [f.name for f in flow_table(V1).fields]
V1_TABLE = [*V1, "Attack", "Label"]
V2_TABLE = [*V1, *fixtures.VIEW_V2_FEATURES, "Attack", "Label"]


def query(name: str):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def listed(names: Column) -> Column:
    return F.concat_ws(",", names)


def of_version(spark: SparkSession, sf_dir: str, version: str) -> DataFrame:
    """One dataset version as a table of its own: version v1 has no columns of v2."""
    columns = V1_TABLE if version == "v1" else V2_TABLE
    rows = fixtures.flows(spark, sf_dir).filter(F.col("dataset_version") == version)
    return rows.select("flow_id", *columns)


def scored(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return score_flows(fixtures.flows(spark, sf_dir), ["flow_id", *keep], hint="attack_hint")


def decided(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return voting.vote(scored(spark, sf_dir, *keep))


def votes(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return voting.votes_long(scored(spark, sf_dir, *keep), ["flow_id", *keep])


def spoilt_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes(spark, sf_dir, "TCP_FLAGS").selectExpr(
        "flow_id",
        "agent",
        f"{fixtures.SPOILT_PREDICTION} as prediction",
        f"{fixtures.SPOILT_CONFIDENCE} as confidence",
    )


# --- sources and sinks ---------------------------------------------------------------------------


@query("q_s1_csv_source")
def csv_source(spark, sf_dir):
    """Two sets of files that order their columns differently, one of them with further columns."""
    path = scratch_path(spark, "flows-csv")
    rows = fixtures.flows(spark, sf_dir)
    plain = rows.filter("dataset_version = 'v1'").select("flow_id", *RAW)
    other = rows.filter("dataset_version <> 'v1'").withColumn("Dataset", F.lit("x"))
    other = other.select("Label", "Attack", "Dataset", *reversed(V1), "MIN_TTL", *[c for c in RAW[:4]], "flow_id")
    for label, table in (("plain", plain), ("other", other)):
        table.write.option("header", True).option("compression", "gzip").csv(f"{path}/{label}")
    return flow_source.read_csv(spark, [f"{path}/plain", f"{path}/other"], flow_table(V1, identified=True))


@query("q_s1_ingest")
def ingest(spark, sf_dir):
    """A partitioned table made from CSV with spoilt lines: rows, identities and quarantined lines per class."""
    path = scratch_path(spark, "ingest")
    rows = fixtures.flows(spark, sf_dir).select(*RAW)
    # A port that is no number spoils a line.
    spoilt = F.when(F.col("L4_SRC_PORT") % 97 == 0, F.lit("none")).otherwise(F.col("L4_SRC_PORT").cast("string"))
    rows.withColumn("L4_SRC_PORT", spoilt).write.option("header", True).csv(f"{path}/csv")
    table = flow_source.ingest_csv(
        spark, f"{path}/csv", f"{path}/table", flow_table(V1), f"{path}/quarantine", partition_by=["Attack"]
    )
    kept = table.groupBy("Attack").agg(F.count("*").alias("n_rows"), F.countDistinct("flow_id").alias("n_ids"))
    bad = spark.read.parquet(f"{path}/quarantine").agg(F.count("*").alias("n_rows"))
    bad = bad.select(F.lit("(quarantine)").alias("Attack"), "n_rows", F.lit(0).cast("long").alias("n_ids"))
    return kept.unionByName(bad)


@query("q_s2_first_rows")
def first_rows(spark, sf_dir):
    rows = flow_source.first_rows(spark, f"{sf_dir}/lineitem.parquet", 5000)
    return rows.selectExpr(*fixtures.select_list(fixtures.FLOW_COLUMNS)).select("flow_id", "IN_BYTES", "Attack")


@query("q_s3_requests")
def request_flows(spark, sf_dir):
    exploded = request_source.explode_requests(fixtures.requests(spark, sf_dir), "flow_id")
    return exploded.select(
        "flow_id", "pos", "dataset_version", "attack_type", F.col("flow.IN_PKTS").try_cast("double").alias("IN_PKTS")
    )


@query("q_s4_validate")
def validate(spark, sf_dir):
    exploded = request_source.explode_requests(fixtures.requests(spark, sf_dir), "flow_id")
    checked = request_source.validate_flows(exploded)
    status = F.when(F.size("missing") == 0, "valid").otherwise("quarantine")
    return checked.select(
        "flow_id", "pos", *V1, "MIN_TTL", "SERVER_TCP_FLAGS", listed("missing").alias("missing"), status.alias("status")
    )


@query("q_s5_test_classes")
def test_classes(spark, sf_dir):
    path = scratch_path(spark, "test-classes")
    rows = cleanse.drop_incomplete(fixtures.flows(spark, sf_dir).select("flow_id", *V1_TABLE))
    sinks.write_test_classes(sampling.stratified_split(rows, "flow_id"), path)
    return sinks.read_test_classes(spark, path)


@query("q_s6_saved_models")
def saved_models(spark, sf_dir):
    train, test = ml_rows(spark, sf_dir)
    path = scratch_path(spark, "models")
    registry = training.train_all(train)
    registry.save(path)
    loaded = training.Registry.load(path)
    # Saved models give what those in memory give: (detector, loaded, test rows, rows with another score).
    outputs = [c for a in AGENTS for c in (a.prediction, a.confidence)]
    with short_methods(spark):
        old, new = (write_table(r.score(test).select("flow_id", *outputs), "saved-scores") for r in (registry, loaded))
    new = new.select("flow_id", *[F.col(c).alias(f"new_{c}") for c in outputs])
    differ = [
        F.count_if(~F.col(a.prediction).eqNullSafe(F.col(f"new_{a.prediction}"))
                   | ~F.col(a.confidence).eqNullSafe(F.col(f"new_{a.confidence}"))).alias(f"d{i}")
        for i, a in enumerate(AGENTS)
    ]
    counts = old.join(new, "flow_id").agg(F.count("*").alias("n_rows"), *differ)
    cells = [
        F.struct(F.lit(a.name).alias("agent"), F.lit(a.name in loaded.models).alias("loaded"), F.col("n_rows"), F.col(f"d{i}").alias("n_differ"))
        for i, a in enumerate(AGENTS)
    ]
    return counts.select(F.inline(F.array(*cells)))


@query("q_s8_response_stream")
def response_stream(spark, sf_dir):
    """Requests written as files and answered by a stream, one file a micro-batch; no SQL (tested against the batch)."""
    path = scratch_path(spark, "response-stream")
    requests_in = fixtures.requests(spark, sf_dir)
    requests_in.repartition(4).write.parquet(f"{path}/in")
    stream = monitor.read_stream(spark, f"{path}/in", requests_in.schema, files_per_trigger=1)
    answered, bad = f"{path}/responses", f"{path}/quarantine"
    answering.run_responses(stream, "flow_id", fixtures.linear_explainers(), answered, bad, f"{path}/checkpoint").awaitTermination()
    return answering.read_responses(spark, answered)


@query("q_s7_report")
def report(spark, sf_dir):
    path = scratch_path(spark, "report")
    sinks.write_report(metrics.quality(metrics.agent_confusion(scored(spark, sf_dir, "Label"))), path)
    return spark.read.parquet(path).select("agent", "accuracy", "precision", "recall", "f1_score")


@query("q_s8_responses")
def responses(spark, sf_dir):
    record = voting.result_record(explained(spark, sf_dir), ["flow_id", "explained"], "attack_hint")
    summary = text.ensemble_text(F.col("prediction"), F.col("explained"))
    brief = text.briefing(F.col("prediction"), F.col("confidence"), F.col("explained"))
    top = F.transform("explained", lambda e: F.struct(e["feature"].alias("feature"), e["importance"].alias("importance")))
    path = scratch_path(spark, "responses")
    sinks.write_responses(sinks.responses(record, sinks.explanation_json(summary, top, brief)), path)
    back = sinks.read_responses(spark, path)
    return back.select(
        "flow_id",
        "prediction",
        "confidence",
        listed("participating_agents").alias("participating_agents"),
        listed("abstaining_agents").alias("abstaining_agents"),
        F.get_json_object("explanation", "$.summary").alias("summary"),
        F.get_json_object("explanation", "$.top_features[0].feature").alias("top_feature"),
        F.get_json_object("explanation", "$.interpretation").alias("interpretation"),
        F.col("votes")["benign"].alias("vote_benign"),
        F.col("votes")["anomaly"].alias("vote_anomaly"),
        "detected_attack_type",
    )


# --- projection, filter, cleansing ---------------------------------------------------------------


@query("q_p1_drop_incomplete")
def drop_incomplete(spark, sf_dir):
    rows = fixtures.flows(spark, sf_dir).select("flow_id", *V1_TABLE)
    return cleanse.drop_incomplete(rows)


@query("q_p2_features_label")
def features_label(spark, sf_dir):
    return cleanse.features_and_label(fixtures.flows(spark, sf_dir).select("flow_id", *RAW))


@query("q_p3_features_attack")
def features_attack(spark, sf_dir):
    rows = fixtures.flows(spark, sf_dir).select("flow_id", *RAW).withColumn("Dataset", F.lit("full"))
    return cleanse.features_and_label(rows, keep_attack=True)


@query("q_p4_canonical")
def canonical(spark, sf_dir):
    return cleanse.align(fixtures.flows(spark, sf_dir), ["flow_id"])


def presence(spark, sf_dir) -> DataFrame:
    rows = fixtures.flows(spark, sf_dir)
    return rows.select("flow_id", cleanse.feature_bits(rows).alias("bits"))


@query("q_p5_available_features")
def available(spark, sf_dir):
    names = cleanse.available_features(F.col("bits"))
    return presence(spark, sf_dir).select("flow_id", listed(names).alias("available"))


@query("q_p6_feature_mask")
def mask(spark, sf_dir):
    flags = cleanse.feature_mask(F.col("bits")).cast("array<int>").cast("array<string>")
    return presence(spark, sf_dir).select("flow_id", F.concat_ws("", flags).alias("mask"))


@query("q_p7_feature_counts")
def feature_counts(spark, sf_dir):
    there, lacking = cleanse.feature_counts(F.col("bits"))
    return presence(spark, sf_dir).select("flow_id", there.alias("available"), lacking.alias("missing"))


@query("q_p8_common_features")
def common_features(spark, sf_dir):
    tables = {v: of_version(spark, sf_dir, v) for v in ("v1", "v2")}
    names = cleanse.common_numeric_features(tables["v1"], tables["v2"])

    def filled(df: DataFrame, name: str) -> DataFrame:
        counts = df.agg(*[F.count(f).alias(f) for f in names])
        return counts.unpivot([], names, "feature", name)

    return filled(tables["v1"], "v1_values").join(filled(tables["v2"], "v2_values"), "feature")


@query("q_p9_tag_version")
def tag_version(spark, sf_dir):
    parts = [cleanse.tag_version(of_version(spark, sf_dir, v), v) for v in ("v1", "v2")]
    return sampling.union_versions(*parts).select("flow_id", "dataset_version", "Attack")


@query("q_p10_agent_slices")
def agent_slices(spark, sf_dir):
    rows = cleanse.align(fixtures.flows(spark, sf_dir), ["flow_id"])
    narrow, wide = (next(a for a in AGENTS if len(a.features) == n) for n in (len(V1), len(CANONICAL)))
    both = rows.select("flow_id", cleanse.agent_slice(narrow).alias("n"), cleanse.agent_slice(wide).alias("w"))
    return both.select(
        "flow_id",
        F.size("n").alias("narrow_size"),
        F.size("w").alias("wide_size"),
        *[F.get("n", F.lit(i)).alias(f"narrow_{i}") for i in range(len(V1))],
        *[F.get("w", F.lit(i)).alias(f"wide_{i}") for i in (0, 7, 12, 13, 14, 21, 33, 38)],
    )


@query("q_p11_class_filter")
def class_filter(spark, sf_dir):
    return cleanse.of_class(fixtures.flows(spark, sf_dir), "BENIGN").select("flow_id", "Attack", "IN_BYTES")


@query("q_p12_valid_votes")
def valid_votes(spark, sf_dir):
    return cleanse.valid_votes(spoilt_votes(spark, sf_dir))


@query("q_p13_finite")
def finite(spark, sf_dir):
    return spoilt_votes(spark, sf_dir).select(
        "flow_id", "agent", finite_or_zero(F.col("confidence")).alias("confidence")
    )


# --- taxonomy -------------------------------------------------------------------------------------


@query("q_t1_normalize")
def normalize(spark, sf_dir):
    return fixtures.flows(spark, sf_dir).select(
        "flow_id",
        taxonomy.normalize_attack(F.col("attack_hint")).alias("hinted_class"),
        taxonomy.normalize_attack(F.upper("Attack")).alias("attack_class"),
    )


@query("q_t2_attack_id")
def attack_ids(spark, sf_dir):
    version = F.col("dataset_version")
    return fixtures.flows(spark, sf_dir).select(
        "flow_id",
        taxonomy.attack_id(F.col("attack_hint"), version).alias("hint_id"),
        taxonomy.attack_id(F.col("Attack"), version).alias("attack_id"),
    )


@query("q_t3_known_attack")
def known_attacks(spark, sf_dir):
    version = F.col("dataset_version")
    return fixtures.flows(spark, sf_dir).select(
        "flow_id",
        taxonomy.is_known_attack(F.col("attack_hint"), version).alias("hint_known"),
        taxonomy.is_known_attack(F.col("Attack"), version).alias("attack_known"),
    )


@query("q_t4_all_classes")
def all_classes(spark, sf_dir):
    flows = fixtures.flows(spark, sf_dir)
    counts = flows.groupBy(taxonomy.normalize_attack(F.col("Attack")).alias("attack_class")).agg(
        F.count("*").alias("flows")
    )
    classes = taxonomy.canonical_classes(spark)
    return classes.join(counts, "attack_class", "left").fillna(0, ["flows"])


@query("q_t5_sampling_group")
def sampling_groups(spark, sf_dir):
    return fixtures.flows(spark, sf_dir).select(
        "flow_id",
        taxonomy.sampling_group(F.col("Attack")).alias("sampling_group"),
        taxonomy.sampling_cap(F.col("Attack")).alias("cap"),
    )


# --- routing ----------------------------------------------------------------------------------------


@query("q_j1_agent_catalogue")
def agent_catalogue(spark, sf_dir):
    """The detectors, with the flows recorded in their dataset version."""
    versions = fixtures.flows(spark, sf_dir).agg(
        *[F.count_if(F.col("dataset_version") == v).alias(v) for v in ("v1", "v2")],
        F.count("dataset_version").alias("both"),
    )
    cells = [F.struct(F.lit(v).alias("dataset_version"), F.col(v).alias("n")) for v in ("v1", "v2", "both")]
    sizes = versions.select(F.inline(F.array(*cells)))
    return (
        agent_table(spark)
        .join(sizes, "dataset_version", "left")
        .select(
            "agent",
            "dataset_version",
            "model_type",
            "feature_count",
            F.size("required_features").alias("required"),
            listed(F.array_sort("known_attacks")).alias("known_attacks"),
            F.coalesce("n", F.lit(0)).alias("version_flows"),
        )
    )


@query("q_j2_feature_catalogue")
def feature_catalogue(spark, sf_dir):
    """The features, with the flows that carry each."""
    rows = fixtures.flows(spark, sf_dir)
    carried = cleanse.available_columns(rows)
    counts = rows.agg(*[F.count(f).alias(f) for f in carried]).unpivot([], carried, "name", "flows")
    return feature_table(spark).join(counts, "name", "left").fillna(0, ["flows"])


@query("q_j3_feature_overlap")
def feature_overlap(spark, sf_dir):
    return routing.route_long(fixtures.flows(spark, sf_dir)).select("flow_id", "agent")


@query("q_j4_attack_aware")
def attack_aware(spark, sf_dir):
    return routing.route_long(fixtures.flows(spark, sf_dir), "attack_hint").select("flow_id", "agent")


@query("q_j5_participating")
def participating(spark, sf_dir):
    rows = routing.route(fixtures.flows(spark, sf_dir), "attack_hint")
    return rows.select("flow_id", listed(routing.participating()).alias("participating"))


@query("q_j5_one_agent")
def one_agent(spark, sf_dir):
    return routing.routed_to(fixtures.flows(spark, sf_dir), AGENTS[0], "attack_hint").select("flow_id", "attack_hint")


@query("q_j6_abstaining")
def abstaining(spark, sf_dir):
    rows = routing.route(fixtures.flows(spark, sf_dir), "attack_hint")
    loaded = [a.name for a in AGENTS if a.model_type != "lstm"]
    return rows.select(
        "flow_id",
        listed(routing.abstaining()).alias("abstaining"),
        listed(routing.abstaining(loaded=loaded)).alias("abstaining_loaded"),
    )


@query("q_j7_can_classify")
def can_classify(spark, sf_dir):
    rows = fixtures.flows(spark, sf_dir).select(taxonomy.normalize_attack(F.col("attack_hint")).alias("named"))
    return routing.classify_table(rows, "named")


@query("q_j8_routing_summary")
def routing_summary(spark, sf_dir):
    return routing.routing_summary(fixtures.flows(spark, sf_dir), "attack_hint")


# --- sampling, splitting, scaling -------------------------------------------------------------------


@query("q_m1_union")
def union_versions(spark, sf_dir):
    both = sampling.union_versions(*[of_version(spark, sf_dir, v) for v in ("v1", "v2")])
    return both.select("flow_id", "IN_BYTES", "MIN_TTL", F.coalesce("MAX_TTL", F.lit(0.0)).alias("MAX_TTL"), "Attack")


@query("q_m2_ratio_sample")
def ratio_sample(spark, sf_dir):
    rows = fixtures.flows(spark, sf_dir).select("flow_id", "dataset_version", "Attack")
    return sampling.sample_by_ratio(rows, "dataset_version", {"v1": 0.25, "v2": 0.75}, "flow_id")


@query("q_m3_mix")
def mix(spark, sf_dir):
    mixed = prepare.mix(*[of_version(spark, sf_dir, v) for v in ("v1", "v2")], "flow_id", v1_share=0.375)
    return mixed.select("flow_id", *V1, "Attack", "Label", "dataset_version", "split")


@query("q_m4_class_capped")
def class_capped(spark, sf_dir):
    rows = fixtures.flows(spark, sf_dir).select("flow_id", "Attack", "IN_BYTES")
    return sampling.sample_by_class(rows, "flow_id")


@query("q_m4_other_classes")
def class_capped_others(spark, sf_dir):
    rows = fixtures.flows(spark, sf_dir).select("flow_id", "Attack", "IN_BYTES")
    return sampling.sample_by_class(rows, "flow_id", other_cap=100)


@query("q_m5_size_cap")
def size_cap(spark, sf_dir):
    rows = fixtures.flows(spark, sf_dir).select("flow_id", "Attack", "IN_BYTES")
    return sampling.sample_rows(rows, 5000, "flow_id")


@query("q_m5_smart_sample")
def smart_sample(spark, sf_dir):
    tables = [of_version(spark, sf_dir, v) for v in ("v1", "v2")]
    sample = prepare.smart_sample(*tables, "flow_id", target=8000)
    return sample.select("flow_id", "Attack", "Label", *V1, "MIN_TTL", "DNS_QUERY_ID")


@query("q_m6_shuffle")
def shuffle(spark, sf_dir):
    shuffled = sampling.shuffle_rows(fixtures.flows(spark, sf_dir).select("flow_id", "Attack"), "flow_id")
    return shuffled.withColumn("order_key", sampling.hash_order(F.col("flow_id")))


@query("q_m7_stratified_split")
def stratified_split(spark, sf_dir):
    rows = fixtures.flows(spark, sf_dir).select("flow_id", "Attack", "Label")
    return sampling.stratified_split(rows, "flow_id")


@query("q_m7_split_by_class")
def split_by_class(spark, sf_dir):
    rows = fixtures.flows(spark, sf_dir).select("flow_id", "Attack", "Label")
    return sampling.stratified_split(rows, "flow_id", "Attack", 0.3)


@query("q_m8_quick_split")
def quick_split(spark, sf_dir):
    return sampling.quick_split(fixtures.flows(spark, sf_dir).select("flow_id", "Label"), "flow_id")


def aligned(spark, sf_dir) -> DataFrame:
    return cleanse.align(fixtures.flows(spark, sf_dir), ["flow_id", "dataset_version", "Label"])


@query("q_m9_fit_bounds")
def fit_bounds(spark, sf_dir):
    split = sampling.stratified_split(aligned(spark, sf_dir), "flow_id")
    bounds = scaling.fit_bounds(split.filter("split = 'train'"), CANONICAL)
    cells = [
        F.struct(F.lit(f).alias("feature"), F.col("low")[f].alias("low"), F.col("high")[f].alias("high")) for f in CANONICAL
    ]
    return bounds.select(F.inline(F.array(*cells)))


@query("q_m10_scale")
def scale(spark, sf_dir):
    rows = sampling.stratified_split(aligned(spark, sf_dir), "flow_id")
    features = [*V1, *fixtures.VIEW_V2_FEATURES]
    bounds = scaling.fit_bounds(rows.filter("split = 'train'"), features)
    return scaling.scale(rows.select("flow_id", *features), bounds, features)


@query("q_m11_smart")
def prepared_smart(spark, sf_dir):
    tables = [of_version(spark, sf_dir, v) for v in ("v1", "v2")]
    rows = prepare.prepare_smart(*tables, "flow_id")
    return rows.select("flow_id", "Attack", "Label", "split", *V1, *fixtures.VIEW_V2_FEATURES)


@query("q_m11_table")
def prepared_table(spark, sf_dir):
    """From a written table to files: the classes of its test rows, read back."""
    path = scratch_path(spark, "prepare")
    fixtures.flows(spark, sf_dir).write.parquet(f"{path}/flows")
    prepare.prepare_table(spark, f"{path}/flows", "flow_id", f"{path}/out")
    return sinks.read_test_classes(spark, f"{path}/out/test-classes")


@query("q_m11_prepare")
def prepared(spark, sf_dir):
    return prepare.prepare(fixtures.flows(spark, sf_dir), "flow_id")


# --- aggregation --------------------------------------------------------------------------------------


@query("q_a1_profile")
def dataset_profile(spark, sf_dir):
    return profile.profile(fixtures.flows(spark, sf_dir)).withColumn("classes", listed(F.col("classes")))


@query("q_a2_class_distribution")
def class_distribution(spark, sf_dir):
    return profile.class_distribution(fixtures.flows(spark, sf_dir))


@query("q_a3_version_profile")
def version_profile(spark, sf_dir):
    return profile.version_profile(fixtures.flows(spark, sf_dir)).withColumn("classes", listed(F.col("classes")))


@query("q_a4_distinct_classes")
def distinct_classes(spark, sf_dir):
    return profile.distinct_classes(fixtures.flows(spark, sf_dir))


@query("q_a5_confusion")
def confusion(spark, sf_dir):
    return metrics.agent_confusion(scored(spark, sf_dir, "Label"))


@query("q_a6_quality")
def quality(spark, sf_dir):
    rows = voting.vote(scored(spark, sf_dir, "Label"))
    return metrics.quality(metrics.agent_confusion(rows, ensemble=metrics.decision_label(F.col("prediction"))))


@query("q_a7_detection_rate")
def detection_rate(spark, sf_dir):
    rows = decided(spark, sf_dir, "Attack", "Label")
    judged = rows.withColumn("decision", metrics.decision_label(F.col("prediction")))
    return metrics.detection_rate(judged, prediction="decision")


# --- training and scoring with Spark ML ------------------------------------------------------------------


def ml_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Aligned training and test rows; both versions together."""
    rows = sampling.quick_split(fixtures.flows(spark, sf_dir), "flow_id")
    train, test = (rows.filter(F.col("split") == s) for s in ("train", "test"))
    return (
        cleanse.align(train, ["flow_id", "Label"]),
        cleanse.align(test, ["flow_id", "Attack", "attack_hint", "Label"], track=V1),
    )


def trained_quality(spark, sf_dir, model_type: str) -> DataFrame:
    agents = [a for a in AGENTS if a.model_type == model_type]
    train, test = ml_rows(spark, sf_dir)
    return learned(training.evaluate(training.train_all(train, agents), test, agents))


def learned(quality: DataFrame) -> DataFrame:
    """Figures of trained detectors as what must hold whatever they learned.

    ``better_than_constant``: finds more of the anomalies than it mistakes of the benign flows.
    """
    figures = ("accuracy", "precision", "recall", "f1_score")
    bounded = F.lit(True)
    for name in figures:
        bounded = bounded & F.coalesce(F.col(name).between(0, 1), F.lit(False))
    found = F.col("tp") / (F.col("tp") + F.col("fn"))
    mistaken = F.col("fp") / (F.col("fp") + F.col("tn"))
    return quality.select("agent", bounded.alias("bounded"), F.coalesce(found > mistaken, F.lit(False)).alias("better_than_constant"))


@query("q_l1_boosted_trees")
def boosted_trees(spark, sf_dir):
    return trained_quality(spark, sf_dir, "xgboost")


@query("q_l2_random_forests")
def random_forests(spark, sf_dir):
    return trained_quality(spark, sf_dir, "random_forest")


@query("q_l3_neural")
def neural(spark, sf_dir):
    return trained_quality(spark, sf_dir, "lstm")


@query("q_l4_reconstruction")
def reconstruction(spark, sf_dir):
    return trained_quality(spark, sf_dir, "autoencoder")


def reconstruction_error() -> Column:
    """A given reconstruction: every feature's distance to a coarse grid."""
    values = [F.col(f) for f in V1]
    return scoring.mean_squared_residual(values, [F.floor(v / 16) * 16.0 for v in values])


@query("q_l5_threshold")
def threshold(spark, sf_dir):
    rows = cleanse.align(fixtures.flows(spark, sf_dir), ["Attack"]).filter("Attack = 'Benign'")
    return training.anomaly_threshold(rows.select(reconstruction_error().alias("error")), "error")


@query("q_l6_train_all")
def train_all(spark, sf_dir):
    train, test = ml_rows(spark, sf_dir)
    registry = training.train_all(train)
    path = scratch_path(spark, "registry")
    registry.save(f"{path}/models")
    sinks.write_report(training.evaluate(registry, test), f"{path}/report")
    return learned(spark.read.parquet(f"{path}/report"))


@query("q_e1_model_votes")
def model_votes(spark, sf_dir):
    """Every test flow with its participants, and whether all votes and the decision are within their bounds."""
    train, test = ml_rows(spark, sf_dir)
    registry = training.train_all(train)
    rows = voting.vote(registry.scores(routing.route(test, "attack_hint"), ["flow_id", "Attack"]))
    sound = F.lit(True)
    for a in AGENTS:
        sound = sound & F.coalesce(F.col(a.prediction).isin(0, 1) & F.col(a.confidence).between(0, 1), F.lit(False))
    decision = F.col("prediction").isin("benign", "anomaly") & F.col("confidence").between(0, 1)
    nobody = (F.size(routing.participating()) == 0) & (F.col("prediction") == "unknown")
    return rows.select(
        "flow_id",
        "Attack",
        listed(routing.participating()).alias("participating"),
        sound.alias("votes_sound"),
        (decision | nobody).alias("decision_sound"),
    )


@query("q_e2_default_confidence")
def default_confidence(spark, sf_dir):
    rows = votes(spark, sf_dir, "TCP_FLAGS")
    known = F.when(F.col("TCP_FLAGS") >= 16, F.col("confidence"))
    return rows.select("flow_id", "agent", scoring.default_confidence(known).alias("confidence"))


@query("q_e3_neural_score")
def neural_score(spark, sf_dir):
    p = cleanse.align(fixtures.flows(spark, sf_dir), ["flow_id"]).select(
        "flow_id", ((F.col("IN_BYTES") % 1024) / 1024).alias("p")
    )
    return p.select(
        "flow_id",
        scoring.neural_prediction(F.col("p")).alias("prediction"),
        scoring.neural_confidence(F.col("p")).alias("confidence"),
    )


@query("q_e4_reconstruction_score")
def reconstruction_score(spark, sf_dir):
    rows = cleanse.align(fixtures.flows(spark, sf_dir), ["flow_id"])
    errors = rows.select("flow_id", reconstruction_error().alias("error"))
    return errors.select(
        "flow_id",
        "error",
        scoring.reconstruction_prediction(F.col("error"), 64.0).alias("prediction"),
        scoring.reconstruction_confidence(F.col("error"), 64.0).alias("confidence"),
    )


@query("q_e5_missing_models")
def missing_models(spark, sf_dir):
    loaded = [a.name for a in AGENTS if a.model_type != "lstm"]
    rows = voting.mask_missing(scored(spark, sf_dir), loaded)
    return voting.vote(rows).select(
        "flow_id", "agent_4_lstm_v2__prediction", "agent_4_lstm_v2__confidence", "prediction", "confidence"
    )


@query("q_e6_rule_scores")
def rule_scores(spark, sf_dir):
    rows = score_flows(fixtures.flows(spark, sf_dir), ["flow_id"])
    return rows.select("flow_id", *[c for a in AGENTS for c in (a.prediction, a.confidence)])


@query("q_e7_votes")
def long_votes(spark, sf_dir):
    return votes(spark, sf_dir)


@query("q_e8_vote")
def wide_vote(spark, sf_dir):
    return decided(spark, sf_dir).select("flow_id", "prediction", "confidence", "vote_benign", "vote_anomaly")


@query("q_e8_vote_long")
def long_vote(spark, sf_dir):
    return voting.vote_long(spoilt_votes(spark, sf_dir), "flow_id")


@query("q_e9_collapse")
def collapse(spark, sf_dir):
    rows = voting.collapse_requests(scored(spark, sf_dir, "request_id"), "request_id", "flow_id")
    return voting.vote(rows).select("request_id", "prediction", "confidence", "vote_benign", "vote_anomaly")


@query("q_e10_result_record")
def result_record(spark, sf_dir):
    record = voting.result_record(decided(spark, sf_dir), ["flow_id"], "attack_hint")
    ballots = F.transform(
        "agent_predictions", lambda v: F.concat_ws("=", v["agent"], v["prediction"].cast("string"))
    )
    return record.select(
        "flow_id",
        "prediction",
        "confidence",
        listed("participating_agents").alias("participating_agents"),
        listed("abstaining_agents").alias("abstaining_agents"),
        listed(ballots).alias("ballots"),
        F.col("votes")["benign"].alias("vote_benign"),
        F.col("votes")["anomaly"].alias("vote_anomaly"),
        "error",
    )


@query("q_e11_detected_type")
def detected_type(spark, sf_dir):
    rows = decided(spark, sf_dir)
    found = voting.detected_type(F.col("attack_hint"), F.col("prediction"))
    return rows.select("flow_id", "prediction", found.alias("detected_attack_type"))


@query("q_e12_score_batch")
def score_batch(spark, sf_dir):
    rows = decided(spark, sf_dir, "Attack")
    found = voting.detected_type(F.col("attack_hint"), F.col("prediction"))
    return write_table(
        rows.select("flow_id", "Attack", "prediction", "confidence", found.alias("detected_attack_type")), "decisions"
    )


@query("q_flagship_summary")
def flagship(spark, sf_dir):
    flows = fixtures.flows(spark, sf_dir)
    return decision_summary(decide_flows(flows, ["Attack"], hint="attack_hint"))


# --- attribution ---------------------------------------------------------------------------------------------


def explained(spark, sf_dir) -> DataFrame:
    """Decided flows with their explanations per detector and the combined one."""
    rows = attribution.explain(decided(spark, sf_dir), fixtures.linear_explainers(), voting.cast_votes())
    return attribution.combine(rows)


@query("q_x1_global_importance")
def global_importance(spark, sf_dir):
    """Of each tree detector: its features, and whether their importances are no less than 0 and sum to 1."""
    agents = [a for a in AGENTS if a.model_type in ("random_forest", "xgboost")]
    train, _ = ml_rows(spark, sf_dir)
    long = training.global_importance(spark, training.train_all(train, agents), agents)
    return long.groupBy("agent").agg(
        F.count("*").alias("n_features"),
        (F.min("importance") >= 0).alias("none_below_0"),
        (F.abs(F.sum("importance") - 1) < 1e-9).alias("sum_is_1"),
    )


@query("q_x2_linear_attribution")
def linear_attribution(spark, sf_dir):
    explainer = fixtures.linear_explainers()[4]
    rows = cleanse.align(fixtures.flows(spark, sf_dir), ["flow_id"])
    return attribution.attributions_long(rows, ["flow_id"], explainer)


@query("q_x2_all_detectors")
def all_linear_attributions(spark, sf_dir):
    rows = cleanse.align(fixtures.flows(spark, sf_dir), ["flow_id"])
    return attribution.all_attributions_long(rows, ["flow_id"], fixtures.linear_explainers())


@query("q_x3_sampled_shapley")
def sampled_shapley(spark, sf_dir):
    agent = next(a for a in AGENTS if a.model_type == "random_forest")
    train, test = ml_rows(spark, sf_dir)
    registry = training.train_all(train, [agent])
    judged = registry.score(routing.route(test, agents=[agent]), [agent])
    flagged = judged.filter(F.col(agent.prediction) == 1).select("flow_id", *V1)
    flagged = write_table(flagged, "flagged")
    background = write_table(sampling.background_sample(train, "flow_id").select("flow_id", *V1), "background")
    values = training.explain_sampled(registry, flagged, "flow_id", background, agent)
    # The values of a flow sum to its score less the mean score of the background.
    mean = registry.probability(agent, background).agg(F.avg("score").alias("mean")).first()["mean"]
    sums = values.groupBy("flow_id").agg(F.sum("shap_value").alias("total"), F.count("*").alias("n"))
    checked = registry.probability(agent, flagged).join(sums, "flow_id", "left")
    exact = (F.abs(F.col("total") - F.col("score") + F.lit(mean)) < 1e-9) & (F.col("n") == len(V1))
    return checked.agg(
        (F.count("*") > 0).alias("any_flagged"),
        F.coalesce(F.bool_and(F.coalesce(exact, F.lit(False))), F.lit(True)).alias("all_sums_exact"),
    )


@query("q_x3_tree_shapley")
def tree_shapley(spark, sf_dir):
    """Exact Shapley values of all four tree detectors for every test flow routed to them, with the largest."""
    agents = [a for a in AGENTS if a.model_type in ("xgboost", "random_forest")]
    train, test = ml_rows(spark, sf_dir)
    registry = training.train_all(train, agents)
    values = training.explain_trees(registry, routing.route(test, agents=agents), "flow_id", agents)
    names = F.create_map(*[x for a in agents for x in (F.lit(a.name), F.array(*map(F.lit, a.features)))])
    biggest = F.array_max(F.transform("shap_values", lambda v, i: F.struct(F.abs(v).alias("size"), (-i).alias("at"))))
    return values.select(
        "flow_id",
        "agent",
        "expected",
        "score",
        "shap_values",
        names[F.col("agent")][-biggest["at"]].alias("top_feature"),
        (F.abs(F.aggregate("shap_values", F.lit(0.0), lambda a, v: a + v) - F.col("score") + F.col("expected")) < 1e-9).alias(
            "efficient"
        ),
    )


@query("q_x3_kernel_shapley")
def kernel_shapley(spark, sf_dir):
    """Kernel Shapley values of the reconstruction detector for every test flow it flags, against the background sample."""
    agent = next(a for a in AGENTS if a.model_type == "autoencoder")
    train, test = ml_rows(spark, sf_dir)
    registry = training.train_all(train, [agent])
    judged = registry.score(routing.route(test, agents=[agent]), [agent])
    flagged = judged.filter(F.col(agent.routed) & (F.col(agent.prediction) == 1)).select("flow_id", *CANONICAL)
    background = sampling.background_sample(train, "flow_id")
    values = training.explain_reconstruction(registry, flagged, "flow_id", background, agent)
    return values.select(
        "flow_id",
        F.lit(agent.name).alias("agent"),
        "expected",
        "score",
        "shap_values",
        (F.abs(F.aggregate("shap_values", F.lit(0.0), lambda a, v: a + v) - F.col("score") + F.col("expected")) < 1e-9).alias(
            "efficient"
        ),
    )


@query("q_x3_deep_shapley")
def deep_shapley(spark, sf_dir):
    """Backward-multiplier values of both neural detectors for every test flow each of them flags."""
    agents = [a for a in AGENTS if a.model_type == "lstm"]
    train, test = ml_rows(spark, sf_dir)
    registry = training.train_all(train, agents)
    background = sampling.background_sample(train, "flow_id")
    values = training.explain_neural(registry, test, "flow_id", background, agents)
    return values.withColumn(
        "efficient",
        F.abs(F.aggregate("shap_values", F.lit(0.0), lambda a, v: a + v) - F.col("score") + F.col("expected")) < 1e-9,
    )


@query("q_x4_background")
def background(spark, sf_dir):
    return sampling.background_sample(cleanse.align(fixtures.flows(spark, sf_dir), ["flow_id"]), "flow_id").select(
        "flow_id", *V1
    )


@query("q_x5_batch_importance")
def batch_importance(spark, sf_dir):
    rows = scored(spark, sf_dir)
    routed = {a.name: F.col(a.routed) for a in AGENTS}
    long = attribution.batch_importance(rows, fixtures.linear_explainers(), routed)
    return attribution.top_rows(long, ["agent"])


@query("q_x6_top_per_flow")
def top_per_flow(spark, sf_dir):
    long = attribution.unfold(explained(spark, sf_dir), ["flow_id"], "explanations")
    first = F.get("top", F.lit(0))
    return long.select(
        "flow_id",
        "agent",
        listed(F.col("top.feature")).alias("features"),
        first["importance"].alias("importance"),
        first["shap_value"].alias("shap_value"),
    )


@query("q_x7_combined")
def combined(spark, sf_dir):
    rows = attribution.unfold(explained(spark, sf_dir), ["flow_id"], "explained")
    return rows.select("flow_id", (F.col("place") + 1).alias("rank"), "feature", "importance")


@query("q_x8_agent_text")
def agent_texts(spark, sf_dir):
    rows = explained(spark, sf_dir)
    agent = AGENTS[6].name
    tops = rows.select("flow_id", attribution.top_of(F.col("explanations"), agent).alias("top"))
    return tops.select("flow_id", text.agent_text(F.lit(agent), F.col("top")).alias("explanation"))


@query("q_x8_all_detectors")
def all_agent_texts(spark, sf_dir):
    """The text of every detector for every flow, also where it does not judge the flow."""
    detectors = [
        F.struct(F.lit(a.name).alias("agent"), attribution.top_of(F.col("explanations"), a.name).alias("top"))
        for a in AGENTS
    ]
    tops = explained(spark, sf_dir).select("flow_id", F.inline(F.array(*detectors)))
    return tops.select("flow_id", "agent", text.agent_text(F.col("agent"), F.col("top")).alias("explanation"))


@query("q_x9_ensemble_text")
def ensemble_texts(spark, sf_dir):
    words = text.ensemble_text(F.col("prediction"), F.col("explained"))
    return explained(spark, sf_dir).select("flow_id", words.alias("summary"))


@query("q_x10_contribution")
def contributions(spark, sf_dir):
    shares = [attribution.contribution(F.col("explained"), i).alias(f"share_{i + 1}") for i in range(fv.TEXT_FEATURES)]
    return explained(spark, sf_dir).select("flow_id", *shares)


@query("q_x11_raw_value")
def raw_values(spark, sf_dir):
    rows = cleanse.align(fixtures.flows(spark, sf_dir), ["flow_id"])
    values = {f: F.col(f) / 1024 for f in V1}
    return rows.select(
        "flow_id",
        *[text.raw_value(F.lit(f), v).alias(f"raw_{f}") for f, v in values.items()],
        *[text.raw_value_text(F.lit(f), values[f]).alias(f"text_{f}") for f in V1[1:3] + V1[4:5] + V1[7:]],
    )


@query("q_x12_briefing")
def briefings(spark, sf_dir):
    words = text.briefing(F.col("prediction"), F.col("confidence"), F.col("explained"))
    return explained(spark, sf_dir).select("flow_id", words.alias("briefing"))


@query("q_x12_missing_model")
def briefings_without_model(spark, sf_dir):
    """With one detector's model missing, flows that only it may judge have no vote and so no explanation."""
    loaded = [a.name for a in AGENTS[:-1]]
    rows = voting.vote(voting.mask_missing(scored(spark, sf_dir), loaded))
    rows = attribution.combine(attribution.explain(rows, fixtures.linear_explainers(), voting.cast_votes()))
    words = text.briefing(F.col("prediction"), F.col("confidence"), F.col("explained"))
    return rows.select("flow_id", words.alias("briefing"), F.size("explanations").alias("n_explained"))


@query("q_x12_filtered")
def filtered_briefings(spark, sf_dir):
    """The whole prediction, then only flows whose briefing calls them an anomaly and names a certain feature first."""
    rows = predict.predict(fixtures.flows(spark, sf_dir), ["flow_id"], fixtures.linear_explainers(), hint="attack_hint")
    chosen = rows.filter(F.col("briefing").contains("ANOMALY") & (F.get("explained", F.lit(0))["feature"] == "IN_BYTES"))
    return chosen.select("flow_id", "summary", "briefing", F.size("explanations").alias("n_explained"))


@query("q_x13_answers")
def answers(spark, sf_dir):
    turns = fixtures.table(spark, sf_dir, "conversations")
    return turns.select(
        "conv_id", "turn", text.answer_rule(F.col("text")).alias("rule"), text.answer(F.col("text")).alias("answer")
    )


# --- streaming -------------------------------------------------------------------------------------------------


def event_stream(spark, sf_dir) -> DataFrame:
    schema = fixtures.table(spark, sf_dir, "events").schema
    events = monitor.read_stream(spark, sf_dir, schema, "events.parquet")
    return fixtures.as_event_flows(events)


def record_stream(spark, sf_dir) -> DataFrame:
    kept = ["event_id", "ts", "Attack", "Label"]
    decisions = monitor.score_stream(event_stream(spark, sf_dir), kept)
    return monitor.monitor_record(decisions, ["event_id", "ts"])


def appended(spark: SparkSession, frame: DataFrame, label: str) -> DataFrame:
    """Run an append-mode stream over what is there and read its output table."""
    path = scratch_path(spark, label)
    monitor.run_append(frame, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{path}/rows")


@query("q_r1_score_stream")
def score_stream(spark, sf_dir):
    decisions = monitor.score_stream(event_stream(spark, sf_dir), ["event_id", "Attack"])
    rows = decisions.select("event_id", "Attack", "prediction", "confidence", "vote_benign", "vote_anomaly")
    return appended(spark, rows, "scored-stream")


@query("q_r2_totals")
def totals(spark, sf_dir):
    path = scratch_path(spark, "totals")
    records = record_stream(spark, sf_dir)
    monitor.run_totals(records, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return monitor.last_snapshot(spark, f"{path}/rows", monitor.running_totals(records).schema)


@query("q_r3_latest")
def latest(spark, sf_dir):
    path = scratch_path(spark, "latest")
    points = monitor.chart_points(record_stream(spark, sf_dir), "event_id", "ts")
    monitor.run_latest(points, "event_id", "ts", f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return monitor.last_snapshot(spark, f"{path}/rows", points.schema).drop("ts")


@query("q_r3_latest_state")
def latest_state(spark, sf_dir):
    path = scratch_path(spark, "latest-state")
    points = monitor.chart_points(record_stream(spark, sf_dir), "event_id", "ts")
    monitor.run_latest_state(points, "event_id", "ts", f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return monitor.latest_from_state(spark, f"{path}/rows", points.schema, "event_id", "ts").drop("ts")


@query("q_r4_alerts")
def alert_stream(spark, sf_dir):
    return appended(spark, monitor.alerts(record_stream(spark, sf_dir), ["event_id"]), "alerts")


@query("q_r5_windowed")
def windowed(spark, sf_dir):
    records = record_stream(spark, sf_dir).withColumn("ts", monitor.as_utc_instant(F.col("ts")))
    return appended(spark, monitor.windowed_rates(records, "ts", "1 hour", late="1 hour"), "windows")


@query("q_r6_records")
def records(spark, sf_dir):
    return appended(spark, record_stream(spark, sf_dir).drop("ts"), "records")


# --- run metadata -------------------------------------------------------------------------------------------------


@query("q_g1_run_log")
def run_log(spark, sf_dir):
    path = scratch_path(spark, "run-log")
    for _ in range(2):  # a repeated job: its second append writes nothing
        runlog.append_log(fixtures.run_steps(spark, sf_dir), path)
    return runlog.read_log(spark, path).select(
        "run_id",
        "dataset_name",
        "step",
        "status",
        listed("errors").alias("errors"),
        listed("warnings").alias("warnings"),
        "seconds",
        "accuracy",
        "f1_score",
        F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("started"),
        F.date_format("end_time", "yyyy-MM-dd HH:mm:ss").alias("ended"),
    )


def log(spark, sf_dir) -> DataFrame:
    return runlog.log_steps(fixtures.run_steps(spark, sf_dir))


@query("q_g2_run_summary")
def run_summary(spark, sf_dir):
    summary = runlog.run_summary(log(spark, sf_dir))
    steps = ("click", "error", "purchase", "signup", "view")
    return summary.select(
        "run_id",
        "dataset",
        "current_step",
        "workflow_status",
        "error_count",
        "warning_count",
        *[F.try_element_at("processing_time", F.lit(s)).alias(f"seconds_{s}") for s in steps],
        "accuracy",
        "precision",
        "recall",
        "f1_score",
    )


@query("q_g3_ready_runs")
def ready_runs(spark, sf_dir):
    return runlog.ready_runs(log(spark, sf_dir))


@query("q_g4_duration")
def duration(spark, sf_dir):
    return runlog.run_duration(log(spark, sf_dir)).select("run_id", "total_seconds")


@query("q_g5_last_errors")
def last_errors(spark, sf_dir):
    return runlog.last_errors(log(spark, sf_dir)).select("run_id", "recency", "error")
