"""Coalition values of the reconstruction vote by matrix products."""

import numpy as np

from flowloom.operators import kernel_shap


def test_votes_equal_those_of_every_hybrid_row():
    rng = np.random.default_rng(1)
    m, plan = 8, kernel_shap.projection(8)
    axes, _ = np.linalg.qr(rng.normal(size=(m, 4)))
    rest, means = np.eye(m) - axes @ axes.T, rng.normal(size=m)
    background = rng.integers(0, 3, (50, m)) / 2
    x = np.concatenate([rng.integers(0, 3, (30, m)) / 2, rng.normal(size=(20, m)), background[:10]])
    x[3, 2], x[4, 1], x[5, 0] = np.nan, np.inf, 1e200
    # The threshold is the error of a background row, as that of a trained detector is one of a training row.
    threshold = np.mean(np.square((background[7] - means) @ rest))
    scored = []

    def vote(h):
        scored.append(h.size // m)
        residual = (h - means) @ rest
        return (np.mean(residual * residual, axis=-1) > threshold).astype(np.float64)

    with np.errstate(all="ignore"):
        plain = kernel_shap.shapley_chunk(x, background, vote, plan)
        every, scored = scored[0], []
        votes = kernel_shap.beyond(means, rest, threshold, vote)(plan[0], background)
        fast = kernel_shap.shapley_chunk(x, background, vote, plan, votes)
    assert np.allclose(plain[0], fast[0], rtol=0, atol=1e-12, equal_nan=True)
    assert np.array_equal(plain[1], fast[1]) and plain[2] == fast[2]
    assert sum(scored) < every / 10
