"""Hand-made frames for the cases the test tables do not hold."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowloom import fixed_values as fv
from flowloom.functions import taxonomy, text
from flowloom.functions.numeric import fixed_decimals, hash_order
from flowloom.operators import attribution, cleanse, metrics, profile, routing, runlog, sampling, scaling, voting
from flowloom.plans import prepare
from flowloom.schema import AGENTS, CANONICAL, V1, flow_table

NAN, INF = float("nan"), float("inf")
VOTES = {
    "tie": [(0, 0.5), (1, 0.5)],
    "benign": [(0, 0.75), (0, 0.25)],
    "anomaly": [(1, 0.75), (1, 0.5)],
    "nan": [(1, NAN), (0, 0.25)],
    "inf": [(1, INF), (0, 0.25)],
    "null": [(None, 0.0), (1, 0.5)],
    "two": [(2, 0.9), (1, 0.5)],
    "only_nan": [(1, NAN)],
    "zero": [(1, 0.0)],
}
OUTCOMES = {
    "tie": ("benign", 0.5),
    "benign": ("benign", 0.5),
    "anomaly": ("anomaly", 0.625),
    "nan": ("benign", 0.25),
    "inf": ("benign", 0.25),
    "null": ("anomaly", 0.5),
    "two": ("anomaly", 0.5),
    "only_nan": ("unknown", 0.0),
    "zero": ("benign", 0.0),
}


def test_vote_long(spark):
    rows = [(k, f"a{i}", p, c) for k, vs in VOTES.items() for i, (p, c) in enumerate(vs)]
    votes = spark.createDataFrame(rows, "k string, agent string, prediction int, confidence double")
    assert {r.k: (r.prediction, r.confidence) for r in voting.vote_long(votes, "k").collect()} == OUTCOMES


def test_vote_wide_equals_long(spark):
    two = AGENTS[:2]
    rows = [
        (k, *[x for p, c in (vs + [(None, None)])[:2] for x in (p, c)], True, len(vs) > 1) for k, vs in VOTES.items()
    ]
    schema = "k string, " + ", ".join(f"{a.prediction} int, {a.confidence} double" for a in two)
    wide = spark.createDataFrame(rows, schema + "".join(f", {a.routed} boolean" for a in two))
    assert {r.k: (r.prediction, r.confidence) for r in voting.vote(wide, two).collect()} == OUTCOMES


def test_nobody_votes(spark):
    one = AGENTS[:1]
    wide = spark.createDataFrame(
        [("x", 1, 0.5, False)], f"k string, {one[0].prediction} int, {one[0].confidence} double, {one[0].routed} boolean"
    )
    row = voting.vote(wide, one).withColumn("error", voting.routing_error(one)).first()
    assert (row.prediction, row.confidence, row.error) == ("unknown", 0.0, fv.NO_PARTICIPANTS_ERROR)


def test_names(spark):
    cases = {
        None: "Unknown", "": "Unknown", "DDoS": "DDoS", "PORT_SCAN": "Reconnaissance", "data_theft": "Theft",
        "Worm": "Worm", "unknown": "Unknown",
    }
    df = spark.createDataFrame([(n,) for n in cases], "n string")
    got = {r.n: r for r in df.select(
        "n", taxonomy.normalize_attack(F.col("n")).alias("c"), taxonomy.attack_id(F.col("n"), F.lit("v1")).alias("v1"),
        taxonomy.attack_id(F.col("n"), F.lit("v2")).alias("v2"), taxonomy.attack_id(F.lit("xss"), F.lit("v3")).alias("v3"),
    ).collect()}
    assert {n: r.c for n, r in got.items()} == cases
    assert (got["data_theft"].v1, got["Worm"].v2, got["DDoS"].v3) == (4, -1, -1)


@pytest.mark.parametrize("hint, who", [
    (None, 7), ("", 7), ("dos", 7), ("ransomware", 4), ("unknown", 1), ("worm", 0),
])
def test_routing_by_hint(spark, hint, who):
    df = spark.createDataFrame([(hint, *[1.0] * 8)], "hint string, " + ", ".join(f"{f} double" for f in V1))
    assert routing.route_long(df, "hint").count() == who


@pytest.mark.parametrize("present, ok", [(8, True), (7, True), (6, False)])
def test_routing_by_features(spark, present, ok):
    row = [1.0] * present + [None] * (8 - present)
    df = spark.createDataFrame([tuple(row)], ", ".join(f"{f} double" for f in V1))
    assert (routing.route_long(df).count() == 7) is ok
    tracked = cleanse.align(df, track=V1)
    assert (routing.route_long(tracked).count() == 7) is ok


def test_absent_column_is_not_available(spark):
    df = spark.createDataFrame([(1.0, "x")], "IN_BYTES double, extra string")
    row = cleanse.align(df, track=CANONICAL).select(
        "*", cleanse.available_features(F.col(cleanse.BITS)).alias("a")
    ).first()
    assert row.a == ["IN_BYTES"] and row.OUT_BYTES == 0.0 and "extra" not in row.asDict()
    assert cleanse.available_columns(df) == ["IN_BYTES"] and len(cleanse.missing_columns(df)) == 38


def test_drop_incomplete_keeps_infinity(spark):
    df = spark.createDataFrame([(1.0,), (None,), (NAN,), (INF,)], "x double")
    assert sorted(r.x for r in cleanse.drop_incomplete(df).collect()) == [1.0, INF]


def test_dataset_column_is_dropped(spark):
    df = spark.createDataFrame([], flow_table(V1, dataset=True))
    assert cleanse.features_and_label(df).columns == [*V1, "Label"]
    assert cleanse.features_and_label(df, keep_attack=True).columns == [*V1, "Attack", "Label"]


def test_scaling(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    test = spark.createDataFrame([(5.0, 9.0), (None, None)], "a double, c double")
    bounds = scaling.fit_bounds(train, ["a", "c"])
    assert [tuple(r) for r in scaling.scale(test, bounds, ["a", "c"]).collect()] == [(2.0, 0.0), (None, None)]
    stage = scaling.scaling_stage(bounds.first(), ["a", "c"])
    assert [(r.a_scaled, r.c_scaled) for r in stage.transform(train).collect()] == [(0.0, 0.0), (1.0, 0.0)]


def labelled(spark, sizes):
    rows = [(f"{label}-{i}", label) for label, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "id string, Label int").repartition(3)


@pytest.mark.parametrize("sizes, tests", [
    ({0: 1, 1: 5}, {0: 0, 1: 2}), ({0: 4000, 1: 2000, 2: 3}, {0: 800, 1: 400, 2: 1}), ({0: 10}, {0: 2}), ({}, {}),
])
def test_split_sizes(spark, sizes, tests):
    df = labelled(spark, sizes)
    split = sampling.stratified_split(df, "id").collect()
    assert len(split) == sum(sizes.values()) == len({r.id for r in split})
    for label in sizes:
        assert sum(r.split == "test" and r.Label == label for r in split) == tests[label]
    assert sum(r.split == "test" for r in split) == math.ceil(sum(sizes.values()) * 0.2)


def test_sample_against_brute_force(spark):
    df = labelled(spark, {0: 3000, 1: 200, 2: 7})
    keys = {r.id: (r.k, r.Label) for r in df.select("id", "Label", hash_order(F.col("id")).alias("k")).collect()}
    for ratio in (0.0, 0.001, 0.5, 1.0):
        got = {r.id for r in sampling.sample_by_ratio(df, "Label", {0: ratio, 2: ratio}, "id").collect()}
        want = set()
        for label, size in ((0, 3000), (2, 7)):
            mine = sorted((k, i) for i, (k, g) in keys.items() if g == label)
            want |= {i for _, i in mine[: math.floor(size * ratio)]}
        assert got == want
    everything = sorted((k, i) for i, (k, _) in keys.items())
    assert {r.id for r in sampling.sample_rows(df, 11, "id").collect()} == {i for _, i in everything[:11]}
    assert sampling.sample_rows(df, 10**9, "id").count() == 3207
    assert [r.id for r in sampling.shuffle_rows(df, "id").collect()] == [i for _, i in everything]
    assert sampling.spread_rows(df, "id", 5).count() == 3207


def test_quick_split_is_proportional(spark):
    split = sampling.quick_split(labelled(spark, {0: 4000, 1: 400}), "id")
    shares = {r.Label: r.share for r in split.groupBy("Label").agg(F.avg((F.col("split") == "test").cast("int")).alias("share")).collect()}
    assert abs(shares[0] - 0.2) < 0.03 and abs(shares[1] - 0.2) < 0.08


def test_other_classes(spark):
    df = spark.createDataFrame([(str(i), "theft" if i % 2 else "DDoS", 1) for i in range(20)], "id string, Attack string, Label int")
    assert {r.Attack for r in sampling.sample_by_class(df, "id").collect()} == {"DDoS"}
    assert sampling.sample_by_class(df, "id", other_cap=3).filter("Attack = 'theft'").count() == 3


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([("1", 1.0, "ddos", 1)], "id string, IN_BYTES double, Attack string, Label int")
    b = spark.createDataFrame([("2", 2.0, 3.0, "ddos", 1)], "id string, IN_BYTES double, MIN_TTL double, Attack string, Label int")
    rows = {r.id: r for r in prepare.smart_sample(a, b, "id").collect()}
    assert rows["1"].MIN_TTL == 0.0 and rows["2"].MIN_TTL == 3.0 and len(rows["1"]) == 3 + len(CANONICAL)


def test_common_features_need_numbers_on_both_sides(spark):
    a = spark.createDataFrame([], "x double, y int, Label int, z string")
    b = spark.createDataFrame([], "y bigint, x string, Label int, z double")
    assert cleanse.common_numeric_features(a, b) == ["y"]


def test_empty_profile(spark):
    df = spark.createDataFrame([], "Attack string, Label int")
    assert profile.profile(df).first().asDict() == {"total": 0, "benign": 0, "malicious": 0, "classes": []}


def test_quality_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (None, 1)], "prediction int, Label int")
    row = metrics.quality(metrics.confusion(df)).first()
    assert (row.tn, row.accuracy, row.precision, row.recall, row.f1_score) == (1, 1.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("value, digits, up, shown", [
    (81.25, 1, False, "81.2"), (81.25, 1, True, "81.3"), (93.75, 1, False, "93.8"), (0.03125, 4, False, "0.0312"),
    (0.5, 4, False, "0.5000"), (1e25, 1, False, "1" + "0" * 25 + ".0"), (0.0, 6, False, "0.000000"),
])
def test_fixed_decimals(spark, value, digits, up, shown):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(fixed_decimals(F.col("v"), digits, half_up=up)).first()[0] == shown


@pytest.mark.parametrize("question, rule", [
    ("Why is this an ATTACK?", "why"), ("Which agent voted?", "agents"), ("What should I do?", "actions"),
    ("Is it a false positive", "false_positive"), ("most important ones", "features"), ("hello", "default"), ("", None),
    (None, None),
])
def test_answers(spark, question, rule):
    df = spark.createDataFrame([(question,)], "q string")
    row = df.select(text.answer_rule(F.col("q")).alias("r"), text.answer(F.col("q")).alias("a")).first()
    assert row.r == rule and (row.a is None) == (rule is None)
    assert rule != "default" or "'hello'" in row.a


def test_texts_without_features(spark):
    empty = F.array().cast("array<struct<importance:double,order:int,feature:string,shap_value:double>>")
    row = spark.range(1).select(
        text.agent_text(F.lit("a"), empty).alias("a"), text.briefing(F.lit("benign"), F.lit(0.8125), empty).alias("b")
    ).first()
    assert row.a == fv.NO_FEATURES_TEXT and row.b == "System classified this as BENIGN with 81.2% confidence."


def test_indicator_line(spark):
    explainer = attribution.LinearExplainer("a", {"IN_PKTS": 1.0, "IN_BYTES": 3.0}, {"IN_PKTS": 0.0, "IN_BYTES": 0.0})
    df = spark.createDataFrame([(0.25, 0.25)], "IN_PKTS double, IN_BYTES double")
    top = attribution.top_entries(attribution.attributions(explainer))
    row = df.select(text.indicator_text(top, 0, F.col("IN_BYTES")).alias("t")).first()
    assert row.t == "IN_BYTES: 75.0% contribution, SHAP value: 0.7500 (Actual: 0.250000 normalized, ~25000 bytes estimated)"


def test_top_entries_break_ties_by_position(spark):
    explainer = attribution.LinearExplainer("a", {f: 1.0 for f in V1}, {f: 0.0 for f in V1})
    df = spark.createDataFrame([tuple([1.0] * 7 + [NAN])], ", ".join(f"{f} double" for f in V1))
    top = df.select(attribution.top_entries(attribution.attributions(explainer)).alias("t")).first().t
    assert [e.feature for e in top] == list(V1[:5])


def test_sampled_shapley_of_a_linear_model_is_exact_in_sum(spark):
    features = ["a", "b", "c"]
    flows = spark.createDataFrame([("x", 1.0, 2.0, 3.0), ("y", 0.0, 5.0, 1.0)], "id string, a double, b double, c double")
    background = spark.createDataFrame([(0.0, 0.0, 0.0), (2.0, 2.0, 2.0)], "a double, b double, c double")
    score = lambda df: df.withColumn("score", F.expr("2 * a - b + a * c"))
    rows = attribution.sampled_shapley(flows, "id", features, score, background, permutations=4).collect()
    value = lambda a, b, c: 2 * a - b + a * c
    mean = (value(0, 0, 0) + value(2, 2, 2)) / 2
    for key, want in (("x", value(1, 2, 3) - mean), ("y", value(0, 5, 1) - mean)):
        assert sum(r.shap_value for r in rows if r.id == key) == pytest.approx(want)
    assert len(rows) == 6
    b = {r.id: r.shap_value for r in rows if r.feature == "b"}  # b takes no part in the product
    assert b["x"] == pytest.approx(-1.0) and b["y"] == pytest.approx(-4.0)


def test_sampled_shapley_uses_every_background_row(spark):
    flows = spark.createDataFrame([("x", 1.0)], "id string, a double")
    background = spark.createDataFrame([(float(i),) for i in range(3)], "a double")
    score = lambda df: df.withColumn("score", F.col("a") * 2)
    rows = attribution.sampled_shapley(flows, "id", ["a"], score, background).collect()
    assert rows[0].shap_value == pytest.approx(0.0)
    with pytest.raises(ValueError, match="equally often"):
        attribution.sampled_shapley(flows, "id", ["a"], score, background, permutations=4)
    with pytest.raises(ValueError, match="more than 2"):
        attribution.sampled_shapley(flows, "id", ["a"], score, background, max_background=2)


def test_run_log(spark):
    rows = [("r1", "d", "load", "running", [], ["w"], 1.0), ("r1", "d", "fit", "completed", [], [], 2.0),
            ("r2", "d", "load", "running", ["e1", "e2", "e3", "e4", "e5"], [], 1.0), ("r3", None, "load", "running", [], [], 1.0)]
    steps = spark.createDataFrame(rows, "run_id string, dataset_name string, step string, status string, errors array<string>, warnings array<string>, seconds double")
    steps = steps.withColumns({m: F.lit(None).cast("double") for m in ("accuracy", "precision", "recall", "f1_score")})
    minute = F.when(F.col("step") == "fit", "01").otherwise("00")
    at = lambda s: F.concat(F.lit("2024-01-01 00:"), minute, F.lit(s)).cast("timestamp_ntz")
    log = runlog.log_steps(steps.withColumns({"start_time": at(":00"), "end_time": at(":30")}))
    summary = {r.run_id: r for r in runlog.run_summary(log).collect()}
    assert summary["r1"].current_step == "fit" and summary["r1"].processing_time == {"load": 1.0, "fit": 2.0}
    assert (summary["r2"].workflow_status, summary["r2"].error_count, summary["r1"].warning_count) == ("error", 5, 1)
    assert [r.run_id for r in runlog.ready_runs(log).collect()] == ["r1"]
    assert {r.run_id: r.total_seconds for r in runlog.run_duration(log).collect()}["r1"] == 90.0
    assert [r.error for r in runlog.last_errors(log).orderBy("recency").collect()] == ["e5", "e4", "e3"]


def test_appending_twice_gives_the_rows_once(spark):
    from flowloom.session import scratch_path

    rows = [("r1", "d", "load", "completed", [], [], 1.0), ("r1", "d", "load", "completed", [], [], 1.0)]
    steps = spark.createDataFrame(rows, "run_id string, dataset_name string, step string, status string, errors array<string>, warnings array<string>, seconds double")
    steps = steps.withColumns({m: F.lit(None).cast("double") for m in ("accuracy", "precision", "recall", "f1_score")})
    steps = steps.withColumns({"start_time": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "end_time": F.lit(None).cast("timestamp_ntz")})
    path = scratch_path(spark, "log-test")
    assert runlog.read_log(spark, path).count() == 0
    assert runlog.append_log(steps, path) and not runlog.append_log(steps.repartition(3), path)
    assert runlog.read_log(spark, path).count() == 2  # repeated rows of one batch stay; the repeated batch does not
    runlog.log_steps(steps).write.parquet(f"{path}/attempts/lost.attempt")  # an attempt that never committed
    assert runlog.append_log(steps.withColumn("step", F.lit("fit")), path)
    assert sorted(r.step for r in runlog.read_log(spark, path).collect()) == ["fit", "fit", "load", "load"]
