"""Attribution of multilayer perceptrons by backward multipliers against a background (the rescale rule).

For a flow x and a background row b, every sigmoid unit passes back the ratio of its output change to its input change,
(σ(z) - σ(z_b)) / (z - z_b), or its slope σ'(z) where the two inputs agree; affine layers pass multipliers back through
their weights. The anomaly probability of Spark's perceptron is a softmax over two outputs, which is the sigmoid of
their difference, so the last layer is one affine map to that difference and one sigmoid. The multipliers times
(x - b), averaged over the background rows, are the values: they sum exactly to p(x) less the mean of p over the
background, and for b close to x they are the gradient times the step.

The weights are read from the fitted ``MultilayerPerceptronClassificationModel`` (Spark stores each layer as its
out x in matrix, column-major, then its bias); they and at most ``MAX_BACKGROUND`` background rows reach every task as
constants. Flows are explained in ``mapInPandas`` tasks, a block of (flow, background row, unit) at a time; nothing is
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MAX_BACKGROUND = 50
CHUNK = 256
#: Input changes below this count as none: the slope stands for the ratio.
SAME = 1e-9

Network = list[tuple[np.ndarray, np.ndarray]]


def layers_of(model) -> Network:
    """(weights out x in, bias) of every affine layer, the last reduced to the difference of the two outputs."""
    sizes = list(model.getLayers())
    flat = model.weights.toArray()
    network, at = [], 0
    for n_in, n_out in zip(sizes[:-1], sizes[1:]):
        w = flat[at : at + n_in * n_out].reshape(n_out, n_in, order="F")
        b = flat[at + n_in * n_out : at + n_in * n_out + n_out]
        network.append((w, b))
        at += n_in * n_out + n_out
    w, b = network[-1]
    network[-1] = ((w[1] - w[0])[None, :], np.array([b[1] - b[0]]))
    return network


def unstandardised(network: Network, mean: np.ndarray, std: np.ndarray) -> Network:
    """The same network on raw inputs, when it was fitted on (x - mean) / std (an input of std 0 gives 0)."""
    (w, b), rest = network[0], network[1:]
    scale = np.divide(1.0, std, out=np.zeros_like(std, dtype=np.float64), where=std != 0)
    return [(w * scale, b - (w * scale) @ mean), *rest]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def forward(network: Network, x: np.ndarray) -> list[np.ndarray]:
    """Inputs of every sigmoid layer, then the probability, for rows of ``x`` (any leading shape)."""
    found, h = [], x
    for w, b in network:
        z = h @ w.T + b
        found.append(z)
        h = _sigmoid(z)
    return [*found, h[..., 0]]


def attribution_chunk(network: Network, x: np.ndarray, background: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(values: flows x features, p(x), mean p over the background)."""
    # A unit's input and output depend on the flow or on the background row alone; only their differences pair the two.
    here, there = forward(network, x), forward(network, background)
    multiplier = np.ones((1, 1, 1))  # d p / d p
    for layer in range(len(network) - 1, -1, -1):
        w, _ = network[layer]
        z, z_ref = here[layer], there[layer]
        s, s_ref = _sigmoid(z), _sigmoid(z_ref)
        step = z[:, None, :] - z_ref[None, :, :]
        same = np.abs(step) <= SAME
        change = s[:, None, :] - s_ref[None, :, :]
        step[same] = 1.0
        ratio = change / step
        if same.any():
            ratio = np.where(same, (s * (1 - s))[:, None, :], ratio)
        multiplier = multiplier * ratio
        if layer:
            multiplier = multiplier @ w  # back through the affine map to its inputs
    # The first affine map comes after the mean over the background: Σ_b (m_b w)(x - b) = (Σ_b m_b) w x - Σ_u w_u Σ_b m_bu b.
    # Both are taken from one background row, so that a feature without a difference gets exactly 0.
    origin = background[0]
    weighted = multiplier.transpose(0, 2, 1) @ (background - origin)  # flows x units x features
    values = ((multiplier.sum(axis=1) @ w) * (x - origin) - np.einsum("uf,nuf->nf", w, weighted)) / len(background)
    return values, here[-1], float(there[-1].mean())


def explain(rows: DataFrame, key: str, vector: str, network: Network, background: np.ndarray) -> DataFrame:
    """(key, expected, score, shap_values) for every row of a feature vector column."""
    background = np.asarray(background, np.float64)
    if not 0 < len(background) <= MAX_BACKGROUND:
        raise ValueError(f"the background needs 1 to {MAX_BACKGROUND} rows")
    schema = T.StructType(
        [
            T.StructField(key, rows.schema[key].dataType),
            T.StructField("expected", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("shap_values", T.ArrayType(T.DoubleType())),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.iloc[at : at + CHUNK]
                x = np.vstack(part["x"].to_numpy()).astype(np.float64) if len(part) else np.zeros((0, background.shape[1]))
                values, score, expected = attribution_chunk(network, x, background)
                yield pd.DataFrame({key: part[key].to_numpy(), "expected": expected, "score": score, "shap_values": list(values)})

    return rows.select(key, vector_to_array(vector).alias("x")).mapInPandas(run, schema)


def background_vectors(rows: DataFrame, vector: str, limit: int = MAX_BACKGROUND) -> np.ndarray:
    """At most ``limit`` rows of a vector column, as the reference of absent features."""
    return np.array([r[0] for r in rows.select(vector_to_array(vector)).limit(limit).collect()], np.float64)

