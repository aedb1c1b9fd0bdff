"""Kernel Shapley values: weighted least squares over coalitions, the normal matrix factored once for all flows.

For a flow x, a coalition S is scored as the mean of the model over the background rows with the features of S taken
from x: v(S) = mean_b f(x_S, b_rest). Shapley values are the solution of the weighted least squares of v(S) on the
coalition indicators with the Shapley kernel weights (m - 1) / (C(m, |S|) |S| (m - |S|)), under the constraint that they
sum to v(all) - v(none). With every coalition of m features enumerated, that solution is the exact Shapley value of v.

The design and weights depend only on m: the constraint is eliminated by the last feature, the normal matrix is factored
once on the driver, and each flow's values are then one projection of its coalition values (an (m - 1) x 2^m matrix).
Flows are scored in ``mapInPandas`` tasks in chunks, a product over (flow, coalition, background row); nothing is
shuffled. The background is a bounded sample (at most ``MAX_BACKGROUND`` rows) that reaches every task as a constant.

Coalitions are enumerated, so at most ``MAX_FEATURES`` features are explained this way; wider models raise an error
rather than being explained by a sample of coalitions. Missing feature values are whatever the model function makes of
them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_FEATURES = 12
MAX_BACKGROUND = 50
#: Largest number of hybrid rows (flows x coalitions x background rows) scored at once in a task.
BLOCK = 1 << 20
#: The same where they are scored by products, whose tables then stay in a core's cache.
PRODUCT_BLOCK = 1 << 18
#: Relative distance to a threshold below which sums in another order might fall on its other side.
NEAR = 1e-11
#: From coalitions and background rows a function that gives the coalition values (flows x coalitions) of flows.
CoalitionMeans = Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray], np.ndarray]]


def coalitions(m: int) -> np.ndarray:
    """All coalitions but the empty and the full one, as rows of 0/1."""
    codes = np.arange(1, 2**m - 1)
    return ((codes[:, None] >> np.arange(m)) & 1).astype(np.float64)


def projection(m: int) -> tuple[np.ndarray, np.ndarray]:
    """(coalitions, P): the first m - 1 values are P @ y with y = v(S) - v(none) - s_last (v(all) - v(none))."""
    z = coalitions(m)
    size = z.sum(axis=1)
    weight = (m - 1) / (np.array([comb(m, int(k)) for k in size]) * size * (m - size))
    x = z[:, :-1] - z[:, -1:]
    normal = x.T @ (weight[:, None] * x)
    return z, np.linalg.solve(normal, (weight[:, None] * x).T)


def values_of(v_all: np.ndarray, v_none: np.ndarray, v_some: np.ndarray, z: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Shapley values (flows x m) from coalition values (flows x coalitions)."""
    delta = v_all - v_none
    y = v_some - v_none[:, None] - z[None, :, -1] * delta[:, None]
    first = y @ p.T
    return np.concatenate([first, (delta - first.sum(axis=1))[:, None]], axis=1)


def beyond(
    means: np.ndarray, rest: np.ndarray, threshold: float, model: Callable[[np.ndarray], np.ndarray]
) -> CoalitionMeans:
    """Coalition values of ``model``: whether the mean square of ``(h - means) @ rest`` is above ``threshold``.

    The residual of a hybrid row is a part of the flow plus a part of the background row, so its square is two squares
    and twice a product, which is a matrix product per coalition. Rows too near the threshold to tell, and those without
    a finite square, are given to ``model``.
    """

    def prepare(z: np.ndarray, background: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        absent = ((1 - z[:, None, :]) * background[None, :, :] - means) @ rest
        absent_square = np.square(absent).sum(axis=-1)
        twice = 2 * absent.transpose(0, 2, 1)
        limit = threshold * z.shape[1]

        def values(x: np.ndarray) -> np.ndarray:
            with np.errstate(invalid="ignore", over="ignore"):
                own = (z[:, None, :] * x[None, :, :]) @ rest
                scale = np.square(own).sum(axis=-1)[:, :, None] + absent_square[:, None, :]
                over = own @ twice
                over += scale - limit
                scale += abs(limit)
                votes = over > 0
                unsure = np.nonzero(~(np.abs(over) > NEAR * scale))
            s, f, b = unsure
            if len(s):
                votes[unsure] = model(z[s] * x[f] + (1 - z[s]) * background[b]) > 0
            return votes.mean(axis=2).T

        return values

    return prepare


def shapley_chunk(
    x: np.ndarray,
    background: np.ndarray,
    model: Callable[[np.ndarray], np.ndarray],
    plan: tuple[np.ndarray, np.ndarray],
    means: Callable[[np.ndarray], np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray, float]:
    """(values: flows x m, scores f(x), expectation v(none)) of a block of flows.

    ``means`` gives the coalition values of flows (flows x coalitions), by default those of all hybrid rows.
    """
    z, p = plan
    if means is None:
        hybrid = z[None, :, None, :] * x[:, None, None, :] + (1 - z[None, :, None, :]) * background[None, None, :, :]
        v_some = model(hybrid).mean(axis=2)
    else:
        v_some = means(x)
    v_none = np.full(len(x), float(model(background).mean()))
    v_all = model(x)
    return values_of(v_all, v_none, v_some, z, p), v_all, float(v_none[0]) if len(x) else float(model(background).mean())


def explain(
    rows: DataFrame,
    key: str,
    columns: Sequence[str],
    background: np.ndarray,
    model: Callable[[np.ndarray], np.ndarray],
    coalition_means: CoalitionMeans | None = None,
) -> DataFrame:
    """(key, expected, score, shap_values in the order of ``columns``) for every row.

    ``coalition_means`` gives the coalition values of ``model`` where there is a faster way than scoring every hybrid row.
    """
    m = len(columns)
    if m > MAX_FEATURES:
        raise ValueError(f"kernel Shapley values enumerate coalitions: at most {MAX_FEATURES} features, not {m}")
    if not 0 < len(background) <= MAX_BACKGROUND:
        raise ValueError(f"the background needs 1 to {MAX_BACKGROUND} rows")
    background = np.asarray(background, np.float64)
    plan = projection(m)
    step = max(1, (PRODUCT_BLOCK if coalition_means else BLOCK) // (len(plan[0]) * len(background)))
    schema = T.StructType(
        [
            T.StructField(key, rows.schema[key].dataType),
            T.StructField("expected", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("shap_values", T.ArrayType(T.DoubleType())),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        means = coalition_means(plan[0], background) if coalition_means else None
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                x = part[list(columns)].to_numpy(np.float64)
                phi, score, expected = shapley_chunk(x, background, model, plan, means)
                yield pd.DataFrame({key: part[key].to_numpy(), "expected": expected, "score": score, "shap_values": list(phi)})

    return rows.select(key, *[F.col(c).cast("double") for c in columns]).mapInPandas(run, schema)
