"""Exact tree Shapley values against all coalitions, scored by the recursive cover expectation of each tree."""

import itertools
import math

import numpy as np
import pytest
from conftest import SMALL
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

import __spark_entry__ as entry
from flowloom.operators import tree_shap
from flowloom.session import scratch_path

WIDTH = 5


@pytest.fixture(scope="module")
def flows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, WIDTH))
    x[::17, 3] = np.nan  # missing values follow right branches, as Spark sends them
    y = ((x[:, 0] + x[:, 1] * x[:, 2] > 0.3) | (np.nan_to_num(x[:, 3]) > 1.0)).astype(float)
    schema = T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("features", VectorUDT()), T.StructField("label", T.DoubleType())]
    )
    rows = [(i, Vectors.dense(r), float(label)) for i, (r, label) in enumerate(zip(x, y))]
    clean = spark.createDataFrame([(i, Vectors.dense(np.nan_to_num(r)), lab) for i, r, lab in rows], schema)
    return x, clean, spark.createDataFrame(rows, schema)


def brute_force(spark, model, x):
    """Shapley values of one flow from f(S) of all 2^WIDTH coalitions."""
    path = scratch_path(spark, "brute-trees")
    model.write().save(path)
    trees = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        trees.setdefault(r.treeID, {})[r.id] = r
    boosted = hasattr(model, "treeWeights") and type(model).__name__.startswith("GBT")

    def cover(n):
        return n.impurityStats[0] if boosted else sum(n.impurityStats)

    def value(t, n):
        return model.treeWeights[t] * n.prediction if boosted else n.impurityStats[1] / sum(n.impurityStats) / len(trees)

    def f(coalition):
        total = 0.0
        for t, nodes in trees.items():
            def down(i):
                n = nodes[i]
                if n.leftChild < 0:
                    return value(t, n)
                j, cut = n.split.featureIndex, n.split.leftCategoriesOrThreshold[0]
                if j in coalition:
                    return down(n.leftChild if x[j] <= cut else n.rightChild)
                left, right = nodes[n.leftChild], nodes[n.rightChild]
                return (cover(left) * down(n.leftChild) + cover(right) * down(n.rightChild)) / cover(n)

            total += down(0)
        return total

    phi = np.zeros(WIDTH)
    for i in range(WIDTH):
        others = [k for k in range(WIDTH) if k != i]
        for size in range(WIDTH):
            weight = math.factorial(size) * math.factorial(WIDTH - size - 1) / math.factorial(WIDTH)
            for s in itertools.combinations(others, size):
                phi[i] += weight * (f(set(s) | {i}) - f(set(s)))
    return phi, f(set(range(WIDTH))), f(set())


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_exact_values_equal_all_coalitions(spark, flows, kind):
    x, clean, with_nan = flows
    estimator = (
        RandomForestClassifier(numTrees=3, maxDepth=4, seed=1)
        if kind == "forest"
        else GBTClassifier(maxIter=3, maxDepth=3, seed=1)
    )
    model = estimator.fit(clean)
    found = {r.id: r for r in tree_shap.explain(with_nan, "id", "features", tree_shap.ensemble_leaves(spark, model), WIDTH).collect()}
    own = {
        r.id: r
        for r in model.transform(with_nan)
        .select("id", vector_to_array("probability")[1].alias("p"), vector_to_array("rawPrediction")[1].alias("m"))
        .collect()
    }
    assert len(found) == len(x)
    for i in range(0, len(x), 17 * 3):
        phi, whole, empty = brute_force(spark, model, x[i])
        r = found[i]
        assert np.abs(np.array(r.shap_values) - phi).max() < 1e-12
        assert abs(r.score - whole) < 1e-12 and abs(r.expected - empty) < 1e-12
        assert abs(r.score - (own[i].p if kind == "forest" else own[i].m)) < 1e-9
    assert all(abs(sum(r.shap_values) - r.score + r.expected) < 1e-9 for r in found.values())


def test_tree_shapley_query(spark):
    rows = entry.queries()["q_x3_tree_shapley"](spark, SMALL).collect()
    assert rows and all(r.efficient for r in rows)
    assert {r.agent for r in rows} == {"agent_1_xgboost_v1", "agent_2_xgboost_v2", "agent_5_rf_v1", "agent_6_rf_v2"}
    assert all(len(r.shap_values) == (8 if r.agent.endswith("v1") else 39) for r in rows)


# kernel Shapley values


def test_kernel_values_are_exact_shapley_values(spark):
    from flowloom.operators import kernel_shap

    rng = np.random.default_rng(7)
    background = rng.normal(size=(7, WIDTH))
    flows = rng.normal(size=(40, WIDTH)) * 2

    def model(h):
        return ((h[..., 0] * h[..., 1] + h[..., 2] ** 2 - h[..., 4]) > 0.5).astype(np.float64)

    def v(x, coalition):
        mixed = background.copy()
        mixed[:, list(coalition)] = x[list(coalition)]
        return model(mixed).mean()

    frame = spark.createDataFrame(
        [(i, *map(float, x)) for i, x in enumerate(flows)], "id long, " + ", ".join(f"f{k} double" for k in range(WIDTH))
    )
    found = {r.id: r for r in kernel_shap.explain(frame, "id", [f"f{k}" for k in range(WIDTH)], background, model).collect()}
    for i, x in enumerate(flows):
        phi = np.zeros(WIDTH)
        for j in range(WIDTH):
            others = [k for k in range(WIDTH) if k != j]
            for size in range(WIDTH):
                weight = math.factorial(size) * math.factorial(WIDTH - size - 1) / math.factorial(WIDTH)
                for s in itertools.combinations(others, size):
                    phi[j] += weight * (v(x, set(s) | {j}) - v(x, set(s)))
        r = found[i]
        assert np.abs(np.array(r.shap_values) - phi).max() < 1e-12
        assert r.score == model(x) and abs(r.expected - model(background).mean()) < 1e-15
    with pytest.raises(ValueError):
        kernel_shap.explain(frame, "id", [f"f{k}" for k in range(WIDTH)], background[:0], model)


def test_kernel_shapley_query(spark):
    rows = entry.queries()["q_x3_kernel_shapley"](spark, SMALL).collect()
    assert rows and all(r.efficient and r.score == 1.0 and len(r.shap_values) == 8 for r in rows)


# backward multipliers of perceptrons


@pytest.fixture(scope="module")
def perceptron(flows):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    _, clean, _ = flows
    return MultilayerPerceptronClassifier(layers=[WIDTH, 6, 3, 2], maxIter=60, seed=3).fit(clean)


def test_multipliers_sum_to_the_change_and_follow_the_gradient(spark, flows, perceptron):
    from flowloom.operators import deep_lift

    x, clean, _ = flows
    network = deep_lift.layers_of(perceptron)
    background = deep_lift.background_vectors(clean, "features", 20)
    found = {r.id: r for r in deep_lift.explain(clean, "id", "features", network, background).collect()}
    own = {r.id: r.p for r in perceptron.transform(clean).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    for i, r in found.items():
        assert abs(r.score - own[i]) < 1e-9
        assert abs(sum(r.shap_values) - (r.score - r.expected)) < 1e-12
    point = np.nan_to_num(x[5])
    for j in range(WIDTH):  # one background row a small step away: values are the gradient times the step
        near = point.copy()
        near[j] -= 1e-6
        values, _, _ = deep_lift.attribution_chunk(network, point[None], near[None])
        up, down = point.copy(), point.copy()
        up[j] += 1e-6
        down[j] -= 1e-6
        slope = (deep_lift.forward(network, up[None])[-1][0] - deep_lift.forward(network, down[None])[-1][0]) / 2e-6
        assert abs(values[0, j] - slope * 1e-6) < 1e-11
        assert np.abs(np.delete(values[0], j)).max() == 0


def test_deep_shapley_query(spark):
    rows = entry.queries()["q_x3_deep_shapley"](spark, SMALL).collect()
    assert rows and all(r.efficient and r.score >= 0.5 for r in rows)
    assert {len(r.shap_values) for r in rows} <= {8, 39}


def test_standardisation_folds_into_the_first_layer():
    from flowloom.operators import deep_lift

    rng = np.random.default_rng(2)
    network = [(rng.normal(size=(4, 3)), rng.normal(size=4)), (rng.normal(size=(1, 4)), rng.normal(size=1))]
    mean, std = np.array([1.0, -2.0, 0.5]), np.array([2.0, 0.0, 0.25])
    x = rng.normal(size=(10, 3))
    standard = np.where(std != 0, (x - mean) / np.where(std != 0, std, 1), 0.0)
    assert np.allclose(
        deep_lift.forward(network, standard)[-1], deep_lift.forward(deep_lift.unstandardised(network, mean, std), x)[-1], atol=1e-14
    )


@pytest.mark.parametrize("tabulated", [True, False])
def test_sampled_orders_by_leaf_equal_scored_coalitions(spark, flows, tabulated, monkeypatch):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from flowloom.operators import attribution

    _, clean, _ = flows
    model = RandomForestClassifier(numTrees=4, maxDepth=4, seed=3, featuresCol="features", labelCol="label").fit(clean)
    names = [f"f{i}" for i in range(WIDTH)]
    rows = clean.select("id", *[vector_to_array("features")[i].alias(f) for i, f in enumerate(names)])

    def score(df):
        scored = model.transform(df.withColumn("features", array_to_vector(F.array(*names))))
        return scored.withColumn("score", vector_to_array("probability")[1])

    some = rows.filter("id < 12").unionByName(rows.filter("id = 3"))  # a repeated identity: its copies are summed
    background = rows.filter("id between 20 and 23")
    trees = tree_shap.ensemble_leaves(spark, model)
    want = attribution.sampled_shapley(some, "id", names, score, background, permutations=8)
    found = attribution.sampled_shapley(some, "id", names, trees, background, permutations=8)
    assert found.columns == want.columns
    key = lambda r: (r.id, r.feature)
    want, found = {key(r): r for r in want.collect()}, {key(r): r for r in found.collect()}
    assert len(want) == 12 * WIDTH and want.keys() == found.keys()
    for k, r in want.items():
        assert found[k].shap_value == pytest.approx(r.shap_value, abs=1e-12)
        assert found[k].importance == abs(found[k].shap_value)
    if not tabulated:
        monkeypatch.setattr(tree_shap, "TABLE_ENTRIES", 0)
        at = np.array([[r[f] for f in names] for r in some.filter("id = 5").collect()])
        reference = np.array([[r[f] for f in names] for r in background.collect()])
        ranks = np.argsort(attribution.feature_orders(WIDTH, 8), axis=1)
        phi, _, _ = tree_shap.shapley_chunk(at, trees, WIDTH, tree_shap.SampledParts(reference, ranks))
        assert phi[0] == pytest.approx([want[5, f].shap_value for f in names], abs=1e-12)
