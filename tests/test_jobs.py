"""Sources, training and streaming end to end."""

import json
import os
import shutil
import time

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from flowloom import fixtures
from flowloom.catalog import queries as catalog
from flowloom.functions.scoring import score_by_rules
from flowloom.operators import routing, sampling, voting
from flowloom.plans import training
from flowloom.plans.scoring import decide_flows
from flowloom.schema import AGENTS, V1, flow_table
from flowloom.sources import flows as flow_source
from flowloom.sources import requests, sinks
from flowloom.streaming import monitor


def test_csv_with_and_without_gzip(spark, tmp_path):
    header = ",".join(f.name for f in flow_table(V1).fields)
    line = "10.0.0.1,80,10.0.0.2,443,6,7.0,1000,710,5,4,27,4294872,Benign,0"
    (tmp_path / "a.csv").write_text(f"{header}\n{line}\n{line}\n")
    table = flow_source.ingest_csv(spark, str(tmp_path / "a.csv"), str(tmp_path / "t"), flow_table(V1))
    rows = table.collect()
    assert len(rows) == 2 == len({r.flow_id for r in rows}) and rows[0].FLOW_DURATION_MILLISECONDS == 4294872.0
    table.drop("flow_id").write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "gz"))
    assert flow_source.read_csv(spark, str(tmp_path / "gz"), flow_table(V1), partitions=2).count() == 2


def test_headers_of_many_files_in_one_job(spark, tmp_path):
    import gzip

    names = [f.name for f in flow_table(V1).fields]
    line = "10.0.0.1,80,10.0.0.2,443,6,7.0,1000,710,5,4,27,4294872,Benign,0".split(",")
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(30):
        order = names if i % 2 else names[::-1]
        text = ",".join(order) + "\n" + ",".join(line if i % 2 else line[::-1]) + "\n"
        if i % 3:
            (folder / f"{i}.csv").write_text(text)
        else:
            (folder / f"{i}.csv.gz").write_bytes(gzip.compress(text.encode()))
    (folder / "empty.csv").write_text("")
    context = spark.sparkContext
    context.setJobGroup("headers", "headers of many files")
    try:
        found = flow_source._headers(spark, str(folder))
    finally:
        context.setJobGroup("other", "other")
    assert len(context.statusTracker().getJobIdsForGroup("headers")) == 1
    assert sorted(len(files) for files in found.values()) == [15, 15] and set(found) == {tuple(names), tuple(names[::-1])}
    table = flow_source.read_csv(spark, str(folder), flow_table(V1))
    assert table.count() == 30 and table.filter(F.col("FLOW_DURATION_MILLISECONDS") == 4294872.0).count() == 30


def test_first_rows_over_many_files(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(0, 1000, 1, 7).write.parquet(path)
    place = spark.read.parquet(path).select("id", "_metadata.file_path", "_metadata.row_index").collect()
    order = [r.id for r in sorted(place, key=lambda r: (r.file_path, r.row_index))]
    for n in (0, 1, 143, 500, 999, 1000, 5000):
        assert {r.id for r in flow_source.first_rows(spark, path, n).collect()} == set(order[:n])


def test_requests(spark):
    full = {f: 1.5 for f in V1}
    bodies = {
        "full": json.dumps({"flows": [{**full, "MIN_TTL": 3}], "dataset_version": "v2", "attack_type": "ddos"}),
        "text": json.dumps({"flows": [{**full, "IN_BYTES": "12"}]}),
        "optional": json.dumps({"flows": [{**full, "MIN_TTL": None}, full]}),
        "required": json.dumps({"flows": [{k: v for k, v in full.items() if k != "IN_PKTS"}]}),
        "unreadable": json.dumps({"flows": [{**full, "MIN_TTL": "many"}]}),
        "malformed": '{"flows": [{"PROTOCOL"',
        "empty": json.dumps({"flows": []}),
        "none": json.dumps({"dataset_version": "v1"}),
    }
    df = spark.createDataFrame(list(bodies.items()), "id string, request string")
    checked = requests.validate_flows(requests.explode_requests(df, "id"))
    good = requests.valid(checked).collect()
    bad = {r.id: r.missing for r in requests.quarantined(checked).collect()}
    assert sorted(r.id for r in good) == ["full", "optional", "optional", "text"]
    assert {r.IN_BYTES for r in good if r.id == "text"} == {12.0}
    assert {r.MIN_TTL for r in good if r.id == "full"} == {3.0} and {r.dataset_version for r in good} == {"v1", "v2"}
    assert bad == {"required": ["IN_PKTS"], "unreadable": ["MIN_TTL"], "malformed": list(V1), "none": list(V1)}


def test_test_classes_by_partition(spark, tmp_path):
    rows = sampling.stratified_split(fixtures.flows(spark, SMALL).select("flow_id", "Attack", "Label"), "flow_id")
    sinks.write_test_classes(rows, str(tmp_path / "p"), format="parquet")
    assert spark.read.parquet(str(tmp_path / "p")).count() == rows.filter("split = 'test'").count() == 1200


@pytest.fixture(scope="module")
def trained(spark):
    train, test = catalog.ml_rows(spark, SMALL)
    return training.train_all(train), train, test


def test_detectors_learn(spark, trained):
    registry, _, test = trained
    quality = {r.agent: r for r in training.evaluate(registry, test).collect()}
    assert len(quality) == 7
    # Always answering benign would have an F1 of 0, always anomaly one of twice the share of attacks.
    attacks = test.filter("Label = 1").count() / test.count()
    constant = 2 * attacks / (1 + attacks)
    for agent in AGENTS:
        if agent.model_type in ("xgboost", "random_forest"):
            assert quality[agent.name].f1_score > constant + 0.2


def test_registry_tolerates_missing_models(spark, trained, tmp_path):
    registry, _, test = trained
    some = {n: registry.models[n] for n in (AGENTS[0].name, AGENTS[6].name)}
    training.Registry(registry.preparation, some).save(str(tmp_path / "r"))
    loaded = training.Registry.load(str(tmp_path / "r"))
    assert set(loaded.models) == set(some)
    routed = routing.route(test)
    first = loaded.score(routed).select(AGENTS[0].prediction, AGENTS[0].confidence, AGENTS[6].confidence, AGENTS[1].prediction)
    again = registry.score(routed).select(AGENTS[0].prediction, AGENTS[0].confidence, AGENTS[6].confidence, F.lit(None).cast("int"))
    assert first.exceptAll(again).count() == 0
    assert voting.vote(loaded.score(routed)).filter("prediction = 'unknown'").count() == test.filter("bit_count(feature_bits) < 7").count()


def test_confidences_are_shares(spark, trained):
    registry, _, test = trained
    scored = registry.score(routing.route(test))
    for a in AGENTS:
        assert scored.filter(~F.col(a.confidence).between(0.0, 1.0)).count() == 0


def test_shapley_of_a_forest_sums_to_the_score(spark, trained):
    registry, train, test = trained
    agent = AGENTS[4]
    flows = test.select("flow_id", *V1).limit(5)
    background = sampling.background_sample(train, "flow_id", 4).select(*V1)
    from flowloom.operators.attribution import sampled_shapley

    values = sampled_shapley(flows, "flow_id", V1, lambda df: registry.probability(agent, df), background, permutations=8)
    sums = {r.flow_id: r.s for r in values.groupBy("flow_id").agg(F.sum("shap_value").alias("s")).collect()}
    base = registry.probability(agent, background).agg(F.avg("score")).first()[0]
    for r in registry.probability(agent, flows).collect():
        assert sums[r.flow_id] == pytest.approx(r.score - base, abs=1e-9)


def test_global_importance(spark, trained):
    rows = training.global_importance(spark, trained[0]).collect()
    assert {r.agent for r in rows} == {a.name for a in AGENTS if a.model_type in ("xgboost", "random_forest")}
    assert all(r.shap_value == 0.0 for r in rows)


def event_files(spark, folder, bounds):
    events = fixtures.table(spark, SMALL, "events")
    for i, (low, high) in enumerate(bounds):
        part = events.filter(F.col("event_id").between(low, high - 1)).coalesce(1)
        part.write.mode("append").parquet(str(folder / f"{i}"))
    return events.schema


def replay(spark, folder, schema, count):
    """One micro-batch per file, in the order of the files."""
    target = folder / "in"
    target.mkdir()
    for i in range(count):
        source = next((folder / f"{i}").glob("*.parquet"))
        shutil.copy(source, target / f"{i}.parquet")
        stamp = time.time() - 1000 + i
        os.utime(target / f"{i}.parquet", (stamp, stamp))
    return fixtures.as_event_flows(monitor.read_stream(spark, str(target), schema, files_per_trigger=1))


def records_of(flows):
    decided = monitor.score_stream(flows, ["event_id", "ts", "Attack", "Label"])
    return monitor.monitor_record(decided, ["event_id", "ts"])


def test_state_over_many_batches(spark, tmp_path):
    schema = event_files(spark, tmp_path, [(500, 1000), (0, 200), (200, 500)])
    stream = records_of(replay(spark, tmp_path, schema, 3))
    batch = records_of(fixtures.event_flows(spark, SMALL))
    out = str(tmp_path / "totals")
    monitor.run_totals(stream, out, str(tmp_path / "c1")).awaitTermination()
    totals = monitor.running_totals(batch)
    assert monitor.last_snapshot(spark, out, totals.schema).collect() == totals.collect()
    points = monitor.chart_points(stream, "event_id", "ts")
    out = str(tmp_path / "latest")
    monitor.run_latest(points, "event_id", "ts", out, str(tmp_path / "c2")).awaitTermination()
    got = {r.event_id for r in monitor.last_snapshot(spark, out, points.schema).collect()}
    assert got == set(range(980, 1000))


def test_latest_points_kept_in_the_state_store(spark, tmp_path):
    schema = event_files(spark, tmp_path, [(500, 1000), (0, 200), (200, 500)])
    target = tmp_path / "in"
    target.mkdir()
    stream = monitor.read_stream(spark, str(target), schema)
    points = monitor.chart_points(records_of(fixtures.as_event_flows(stream)), "event_id", "ts")
    out, checkpoint = str(tmp_path / "latest"), str(tmp_path / "c")
    want = monitor.latest_points(monitor.chart_points(records_of(fixtures.event_flows(spark, SMALL)), "event_id", "ts"), "event_id", "ts")
    for i in range(3):  # one file, then a restart from the checkpoint with the next
        shutil.copy(next((tmp_path / f"{i}").glob("*.parquet")), target / f"{i}.parquet")
        monitor.run_latest_state(points, "event_id", "ts", out, checkpoint).awaitTermination()
    got = monitor.latest_from_state(spark, out, points.schema, "event_id", "ts")
    assert got.columns == points.columns and sorted(got.collect()) == sorted(want.collect())
    appended = spark.read.parquet(out)
    per_version = appended.groupBy(monitor._SALT, monitor._VERSION).count()
    assert per_version.agg(F.max("count")).first()[0] <= 20  # the state of a key is 20 rows at most
    assert per_version.agg(F.max(monitor._VERSION)).first()[0] <= 3  # one version per batch, none repeated


def test_late_rows_are_dropped(spark, tmp_path):
    schema = event_files(spark, tmp_path, [(0, 400), (450, 900), (900, 1000), (400, 450)])
    flows = replay(spark, tmp_path, schema, 4)
    records = records_of(flows).withColumn("ts", monitor.as_utc_instant(F.col("ts")))
    windows = monitor.windowed_rates(records, "ts", "1 day", late="1 hour")
    out = str(tmp_path / "w")
    monitor.run_append(windows, out, str(tmp_path / "c")).awaitTermination()
    on_time = fixtures.event_flows(spark, SMALL).filter("event_id not between 400 and 449")
    want = on_time.groupBy(F.unix_date(F.col("ts").cast("date")).alias("d")).count().collect()
    got = {r.window_start // 86400: r.flows for r in spark.read.parquet(out).collect()}
    last = max(r.d for r in want)
    assert got == {r.d: r["count"] for r in want if r.d < last}


# Three of the sample flows of the dashboard, in the order of the eight shared features.
PRESETS = {
    "benign": (6.0, 7.0, 1000.0, 710.0, 5.0, 4.0, 27.0, 4294872.0),
    "ddos": (0.3125, 0.03431373, 0.0009277, 0.00055627, 0.00430571, 0.00215983, 0.87096774, 0.00003378),
    "injection": (0.3125, 0.03431373, 0.00364483, 0.00048, 0.01829925, 0.00539957, 0.77419355, 0.0277991),
}


def test_presets(spark):
    rows = [(n, *v) for n, v in PRESETS.items()]
    df = spark.createDataFrame(rows, "name string, " + ", ".join(f"{f} double" for f in V1))
    got = {r.name: r.prediction for r in decide_flows(df, ["name"], scorer=score_by_rules).collect()}
    assert got == {"benign": "benign", "ddos": "anomaly", "injection": "anomaly"}


def test_plan_of_the_vote_has_no_shuffle(spark):
    plan = decide_flows(fixtures.flows(spark, SMALL), ["flow_id"], hint="attack_hint")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_selection_never_shuffles_the_flows(spark):
    """Also where the planner may broadcast nothing."""
    rows = fixtures.flows(spark, SMALL).select("flow_id", "Label", "Attack", "dataset_version", "IN_BYTES")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for table in (
            sampling.stratified_split(rows, "flow_id"),
            sampling.stratified_split(rows, "flow_id", "Attack"),
            sampling.sample_by_ratio(rows, "dataset_version", {"v1": 0.5}, "flow_id"),
            sampling.sample_by_class(rows, "flow_id", other_cap=5),
            sampling.sample_rows(rows, 100, "flow_id"),
        ):
            plan = table._jdf.queryExecution().executedPlan().toString()
            assert "Join" not in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("flow_id,IN_BYTES,Attack,Label\nx,5,ddos,1\n")
    (tmp_path / "b.csv").write_text("Label,Other,Attack,flow_id\n0,9,Benign,y\nmany,9,dos,z\n")
    (tmp_path / "c.csv").write_text("")
    schema = "flow_id string, IN_BYTES double, Attack string, Label int"
    from pyspark.sql.types import StructType

    table = flow_source.read_csv(spark, str(tmp_path), StructType.fromDDL(schema), keep_malformed=True)
    rows = {r.flow_id: (r.IN_BYTES, r.Attack, r.Label, r[flow_source.MALFORMED]) for r in table.collect()}
    assert rows["x"] == (5.0, "ddos", 1, None) and rows["y"] == (None, "Benign", 0, None)
    assert rows["z"][:3] == (None, "dos", None) and rows["z"][3] == "many,9,dos,z"


def test_rows_of_partitioned_tables_have_their_own_identity(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 3).selectExpr("id", "id % 7 as part").write.partitionBy("part").parquet(path)
    table = flow_source.with_row_identity(spark.read.parquet(path), path)
    assert table.select("flow_id").distinct().count() == 1000
    assert sampling.sample_rows(table, 101, "flow_id").count() == 101


def test_threshold_is_the_exact_element(spark):
    import math
    import random

    rng = random.Random(1)
    for values in (
        [rng.lognormvariate(0, 4) for _ in range(30_000)],
        [1.0] * 50 + [2.0],
        [rng.choice([0.0, 1e-300, 5.0, 1e300]) for _ in range(999)],
        [7.5],
        [float(i % 20_011) for i in range(40_000)],
    ):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "e double")
        got = training.anomaly_threshold(df, "e").first()[0]
        assert got == sorted(values)[math.ceil(0.95 * len(values)) - 1]
    assert training.anomaly_threshold(df.limit(0), "e").first()[0] is None


def test_preparation_scans_its_source_three_times_at_most(spark, tmp_path):
    from flowloom.plans import prepare

    fixtures.flows(spark, SMALL).write.parquet(str(tmp_path / "flows"))
    rows = prepare.prepare_table(spark, str(tmp_path / "flows"), "flow_id", str(tmp_path / "out"), limit=500)
    assert rows.count() <= 500 and {r.split for r in rows.select("split").distinct().collect()} == {"train", "test"}
    assert spark.read.parquet(str(tmp_path / "out/profile")).count() > 0
    tests = sinks.read_test_classes(spark, str(tmp_path / "out/test-classes"))
    assert tests.count() == rows.filter("split = 'test'").count()
    split = prepare.prepare(fixtures.flows(spark, SMALL), "flow_id")
    assert "lineitem" not in split._jdf.queryExecution().executedPlan().toString()  # reads what was written


def test_prediction_of_requests_with_trained_detectors(spark, trained):
    from flowloom.plans import predict

    registry, train, _ = trained
    explainers = training.fit_linear_explainers(train)
    assert len(explainers) == len(AGENTS) and all(set(e.weights) == set(a.features) for e, a in zip(explainers, AGENTS))
    full = {f: 1.5 for f in V1}
    bodies = [
        ("known", json.dumps({"flows": [full, {**full, "IN_BYTES": 9e9}], "attack_type": "ddos"})),
        ("odd", json.dumps({"flows": [{k: v for k, v in full.items() if k != "IN_PKTS"}]})),
    ]
    requests_in = spark.createDataFrame(bodies, "flow_id string, request string")
    predicted, bad = predict.predict_requests(requests_in, "flow_id", explainers, scorer=registry.score)
    rows = predicted.orderBy("pos").collect()
    assert [(r.flow_id, r.pos) for r in rows] == [("known", 0), ("known", 1)] and bad.count() == 1
    assert all(r.prediction in ("benign", "anomaly") and r.explained and r.briefing for r in rows)
    assert {e.agent for e in rows[0].explanations} == {p.agent for p in rows[0].agent_predictions}
    answers = predict.as_responses(predicted).collect()
    assert all(json.loads(a.explanation)["top_features"] for a in answers)
    whole = predict.answer_requests(requests_in, "flow_id", scorer=registry.score).collect()
    assert [r.flow_id for r in whole] == ["known"] and whole[0].detected_attack_type in ("ddos", "Benign")
    # A filter on a text reads the written explanations.
    plan = predicted.filter(F.col("briefing").contains("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000


def test_responses_of_a_request_stream_equal_the_batch_also_after_a_repeat(spark, tmp_path):
    from flowloom.plans import predict
    from flowloom.streaming import responses

    requests_all = fixtures.requests(spark, SMALL)
    target = tmp_path / "in"
    target.mkdir()
    for i, part in enumerate((requests_all.filter("flow_id < '5'"), requests_all.filter("flow_id >= '5'"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"{i}"))
        source = next((tmp_path / f"{i}").glob("*.parquet"))
        shutil.copy(source, target / f"{i}.parquet")
        os.utime(target / f"{i}.parquet", (time.time() - 1000 + i, time.time() - 1000 + i))
    stream = monitor.read_stream(spark, str(target), requests_all.schema, files_per_trigger=1)
    explainers = fixtures.linear_explainers()
    out, bad, checkpoint = (str(tmp_path / n) for n in ("responses", "quarantine", "checkpoint"))
    responses.run_responses(stream, "flow_id", explainers, out, bad, checkpoint).awaitTermination()
    predicted, quarantined = predict.predict_requests(requests_all, "flow_id", explainers)
    want = sorted(predict.as_responses(predicted).collect())
    assert sorted(responses.read_responses(spark, out).collect()) == want and len(want) > 0
    assert spark.read.json(f"{bad}/batch=*").count() == quarantined.count() > 0
    # The first batch once more, as after a failure before its commit: its folders are replaced, nothing doubles.
    again = spark.read.parquet(str(target / "0.parquet"))
    responses.answer_batch(again, 0, "flow_id", explainers, out, bad)
    assert sorted(responses.read_responses(spark, out).collect()) == want
    assert spark.read.json(f"{bad}/batch=*").count() == quarantined.count()


def test_flows_without_a_vote_are_not_explained(spark):
    from flowloom.plans import predict

    nobody = lambda df, agents: voting.mask_missing(score_by_rules(df, agents), [], agents)
    rows = fixtures.flows(spark, SMALL).limit(20)
    predicted = predict.predict(rows, ["flow_id"], fixtures.linear_explainers(), hint="attack_hint", scorer=nobody)
    assert {(r.prediction, len(r.explanations)) for r in predicted.collect()} == {("unknown", 0)}
    assert predicted.filter("briefing like '%ANOMALY%' or briefing like '%Block%'").count() == 0
    assert predict.as_responses(predicted).filter("explanation is not null").count() == 0


def test_first_lines_longer_than_one_read(tmp_path):
    import gzip

    import pandas as pd

    long_header = ",".join(f"column_{i}" for i in range(20_000))  # over 64 KiB, so several reads
    (tmp_path / "long.csv").write_text(long_header + "\r\n1,2\n")
    (tmp_path / "z.csv.gz").write_bytes(gzip.compress(b"a,b\n1,2\n"))
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "a name with spaces, 100% #1.csv").write_text("c,d\n")
    names = ("long.csv", "z.csv.gz", "empty.csv", "a name with spaces, 100% #1.csv")
    paths = [f"file:{tmp_path / n}" for n in names]  # decoded, as Spark lists them
    (found,) = list(flow_source._first_lines(iter([pd.DataFrame({"path": paths})])))
    assert list(found["line"]) == [long_header, "a,b", "", "c,d"]
