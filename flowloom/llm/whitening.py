"""Whitening of embeddings: the exact covariance of quantised vectors, float32 eigenvectors refined to double precision.

Each entry c of a vector becomes the integer x = floor(256 c). The fit list holds every distinct x vector once; over it,
n vectors with sums S and Gram matrix G give n² V = n G - S Sᵀ, the covariance without rounding. Spark computes n, S and G
exactly: integer products per Arrow batch (Python integers where int64 could overflow), per-partition sums sent as decimals,
summed by a grouped aggregation, so the driver receives one value per pair of dimensions, not vectors.

The eigenvectors start from float32 (``numpy.linalg.eigh`` on single precision) and are refined by the iteration of Ogita
and Aishima for symmetric matrices, with its products in extended precision (``numpy.longdouble``): from R = I - XᵀX and
S = XᵀAX, eigenvalue estimates sᵢᵢ / (1 - rᵢᵢ), and the correction X ← X + XE with Eᵢⱼ = (sᵢⱼ + λⱼrᵢⱼ) / (λⱼ - λᵢ). Each
step roughly squares the error. Where estimates lie closer than the iteration's bound δ they form a cluster; there Eᵢⱼ only
restores orthogonality (rᵢⱼ / 2), and the cluster's subspace is resolved by a sub-solve: its k x k matrix XⱼᵀAXⱼ, less its
mean eigenvalue so that the spread inside the cluster is resolved, gets its own float32 start and refinement, by which the
cluster's vectors are rotated.

Rows are then whitened by expressions on the JVM: (n x - S) · v / (n √e) for each of the first ``COMPONENTS`` components,
and ``deviation`` = Σ (n x - S)² in decimals. The covariance of the whitened values over the fit list, from a second
aggregation, gives ``identity_error``.

Odd rows: rows whose vector is null or holds a null, NaN or infinite entry are dropped, as are entries whose 256 c lies
beyond ±2⁶³, and vectors of a length other than the most frequent one (ties: the shorter) — one covariance needs one
dimension. Repeated vectors enter the fit list once but every row is returned. A component whose eigenvalue is zero to
the precision of the trace (at most ``ZERO`` of it) has null ``whitened`` and stays out of ``identity_error``; with a zero
trace (one distinct vector) ``explained`` is null too. No remaining row or no dimension gives an empty result. Only
``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_table

COMPONENTS = 4
SCALE = 256
ZERO = 1e-12
STEPS = 8
#: Eigenvalues closer than this share of the norm are refined as a cluster, by a sub-solve.
CLUSTER = 1e-6
#: Largest magnitude of an entry for which a batch's Gram matrix is summed in int64.
_SAFE = 2**20

EXACT = T.DecimalType(38, 0)
RESULT = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType()),
    ]
)


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that remain, x as array<long>."""
    c = F.col("embedding")
    ok = c.isNotNull() & F.forall(
        c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double") * SCALE) < F.lit(2.0**63))
    )
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), c).filter(ok)
    sizes = rows.groupBy(F.size(c).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return rows.select("vec_id", F.transform(c, lambda e: F.floor(e.cast("double") * SCALE)).alias("x")).limit(0)
    return rows.filter(F.size(c) == sizes["d"]).select(
        "vec_id", F.transform(c, lambda e: F.floor(e.cast("double") * SCALE)).alias("x")
    )


def _moments(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, S and G of the fit list, exactly."""
    parts = T.StructType([T.StructField(f, T.IntegerType()) for f in ("i", "j")] + [T.StructField("v", T.StringType())])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, gram = 0, None, None
        for batch in batches:
            if not len(batch):
                continue
            x = np.vstack(batch["x"].to_numpy()).astype(np.int64)
            if x.ndim != 2 or x.shape[1] == 0:
                n += len(batch)
                continue
            big = np.abs(x).max(initial=0) >= _SAFE or len(x) >= 2**20
            own = (x.astype(object).T @ x.astype(object)) if big else (x.T @ x).astype(object)
            sums = x.astype(object).sum(axis=0)
            n += len(x)
            total = sums if total is None else total + sums
            gram = own if gram is None else gram + own
        rows = [(-1, -1, str(n))]
        if total is not None:
            d = len(total)
            rows += [(i, -1, str(total[i])) for i in range(d)]
            rows += [(i, j, str(gram[i, j])) for i in range(d) for j in range(i, d)]
        yield pd.DataFrame(rows, columns=["i", "j", "v"])

    sums = (
        fit.mapInPandas(partial, parts)
        .groupBy("i", "j")
        .agg(F.sum(F.col("v").cast(EXACT)).alias("v"))
        .collect()
    )
    n, total, gram = 0, {}, {}
    for r in sums:
        if r.i < 0:
            n = int(r.v)
        elif r.j < 0:
            total[r.i] = int(r.v)
        else:
            gram[r.i, r.j] = gram[r.j, r.i] = int(r.v)
    d = len(total)
    return n, [total[i] for i in range(d)], [[gram[i, j] for j in range(d)] for i in range(d)]


def _extended(values: np.ndarray) -> np.ndarray:
    """Python integers as long doubles, rounded once (numpy alone goes through float64)."""
    high = values.astype(np.float64)
    low = (values - np.vectorize(int, otypes=[object])(high)).astype(np.float64)
    return high.astype(np.longdouble) + low.astype(np.longdouble)


def _norm(m: np.ndarray) -> float:
    return float(np.sqrt(np.sum(np.square(m.astype(np.float64)))))


def refine(a: np.ndarray, x: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of symmetric ``a`` from approximate eigenvectors ``x``, in extended precision."""
    a = a.astype(np.longdouble)
    x = x.astype(np.longdouble)
    k = len(a)
    eye = np.eye(k, dtype=np.longdouble)
    scale = max(_norm(a), 1e-300)
    for _ in range(steps):
        r = eye - x.T @ x
        s = x.T @ a @ x
        lam = np.diag(s) / (1 - np.diag(r))
        delta = max(2 * (_norm(s - np.diag(lam)) + scale * _norm(r)), CLUSTER * scale)
        gap = lam[None, :] - lam[:, None]
        apart = np.abs(gap) > delta
        e = np.where(apart, (s + lam[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        order = np.argsort(-lam.astype(np.float64), kind="stable")
        lam, x = lam[order], x[:, order]
        clusters = _clusters(lam, delta)
        for members in clusters:
            if len(members) == k:  # all alike: any orthonormal basis is right to this precision
                continue
            sub = x[:, members]
            t = sub.T @ a @ sub
            t = (t + t.T) / 2
            shift = np.trace(t) / len(members)
            inner = t - shift * np.eye(len(members), dtype=np.longdouble)
            if _norm(inner) > 0:
                _, start = np.linalg.eigh(inner.astype(np.float32))
                _, turn = refine(inner, start.astype(np.float64), steps)
                x[:, members] = sub @ turn
        if _norm(e) < 1e-17 and not clusters:
            break
    x = x / np.sqrt(np.sum(x * x, axis=0))
    lam = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-lam.astype(np.float64), kind="stable")
    return lam[order], x[:, order]


def _clusters(lam: np.ndarray, delta: float) -> list[list[int]]:
    found, current = [], [0]
    for i in range(1, len(lam)):
        if abs(lam[i - 1] - lam[i]) <= delta:
            current.append(i)
        else:
            if len(current) > 1:
                found.append(current)
            current = [i]
    if len(current) > 1:
        found.append(current)
    return found


def components(n: int, total: list[int], gram: list[list[int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Eigenvalues of V (falling), unit eigenvectors as columns with their largest entry positive, and trace(n² V)."""
    s = np.array(total, dtype=object)
    exact = n * np.array(gram, dtype=object) - np.outer(s, s)
    trace = int(sum(exact[i, i] for i in range(len(s))))
    a = _extended(exact) / np.longdouble(n) ** 2
    top = max(float(np.abs(a.astype(np.float64)).max(initial=0)), 1e-300)
    _, start = np.linalg.eigh((a / top).astype(np.float32))
    lam, x = refine(a, start.astype(np.float64))
    lead = np.argmax(np.abs(x.astype(np.float64)), axis=0)
    x = x * np.sign(x[lead, np.arange(x.shape[1])])
    return lam, x, trace


def _dot(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda acc, y: acc + y)


def whiten(embeddings: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component (see ``RESULT``)."""
    spark = embeddings.sparkSession
    rows = write_table(quantised(embeddings), "whitening-rows")
    fit = write_table(rows.select("x").distinct(), "whitening-fit")
    n, total, gram = _moments(fit)
    d = len(total)
    if n == 0 or d == 0:
        return spark.createDataFrame([], RESULT)
    lam, vectors, trace = components(n, total, gram)
    k = min(count, d)
    sums = F.array(*[F.lit(v) for v in total])
    centred = F.transform("x", lambda v, i: v * F.lit(n) - sums[i])  # n x - S, exact longs
    plain = lam.astype(np.float64)
    positive = [bool(plain[c] > ZERO * trace / n**2) and trace > 0 for c in range(k)]
    scores = []
    for c in range(k):
        if not positive[c]:
            scores.append(F.lit(None).cast("double"))
            continue
        v = F.array(*[F.lit(float(vectors[i, c])) for i in range(d)])
        scale = float(n * np.sqrt(lam[c]))
        scores.append(_dot(F.transform(centred, lambda t, i: t.cast("double") * v[i])) / F.lit(scale))
    w = fit.select(*[s.alias(f"w{c}") for c, s in enumerate(scores)])
    live = [c for c in range(k) if positive[c]]
    error = None
    if live:
        moments = w.agg(
            F.count(F.lit(1)).alias("m"),
            *[F.sum(f"w{c}").alias(f"s{c}") for c in live],
            *[F.sum(F.col(f"w{a}") * F.col(f"w{b}")).alias(f"p{a}_{b}") for a in live for b in live if a <= b],
        ).first()
        m = moments["m"]
        error = max(
            abs(moments[f"p{a}_{b}"] / m - (moments[f"s{a}"] / m) * (moments[f"s{b}"] / m) - (1.0 if a == b else 0.0))
            for a in live
            for b in live
            if a <= b
        )
    deviation = F.aggregate(
        F.transform(centred, lambda t: t.cast(EXACT) * t.cast(EXACT)), F.lit(0).cast(EXACT), lambda acc, y: acc + y
    ).cast("long")
    explained = [None if trace == 0 else float(lam[c] * n**2 / trace) for c in range(k)]
    each = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c + 1).alias("component"),
                    scores[c].alias("whitened"),
                    F.lit(explained[c]).cast("double").alias("explained"),
                )
                for c in range(k)
            ]
        )
    )
    return rows.select("vec_id", deviation.alias("deviation"), each.alias("e")).select(
        "vec_id",
        F.col("e.component").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.col("e.whitened").alias("whitened"),
        F.col("e.explained").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )

