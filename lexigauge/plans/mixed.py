"""Linear mixed models with uncorrelated random slopes, by maximum likelihood on per-subject sufficient statistics."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Predictors of reading times; the baseline has those without surprisal. Fixed values.
FULL_TERMS = ["Surprisal", "Surprisal1p", "Surprisal2p", "wordnum", "wlen", "wlen1p", "wlen2p", "freq", "freq1p", "freq2p"]
BASE_TERMS = ["wordnum", "wlen", "wlen1p", "wlen2p", "freq", "freq1p", "freq2p"]
#: Subjects whose statistics may come to the driver; beyond it each evaluation, of value and gradient, is one aggregation in Spark.
DRIVER_SUBJECTS = 20_000
#: Subjects whose blocks are handled at once.
BLOCK = 2000
_WORST = 1e18


def subject_statistics(df: DataFrame, subject: str, response: Column, design: list[Column]) -> DataFrame:
    """(subject, n, xx, xy, yy): sums of products by subject, combined before the shuffle. xx has the upper triangle by rows."""
    x = [c.alias(f"x{k}") for k, c in enumerate(design)]
    rows = df.select(F.col(subject).alias("subject"), response.alias("y"), *x)
    p = len(design)
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    return rows.groupBy("subject").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in upper]).alias("xx"), F.array(*[F.sum(F.col(f"x{i}") * F.col("y")) for i in range(p)]).alias("xy"), F.sum(F.col("y") * F.col("y")).alias("yy"))


def _unpack(n, xx, xy, p: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.triu_indices(p)
    full = np.zeros((len(n), p, p))
    full[:, i, j] = xx
    full[:, j, i] = xx
    return full, np.asarray(xy, float).reshape(len(n), p)


def block_sums(theta: np.ndarray, zz: np.ndarray, zy: np.ndarray) -> np.ndarray | None:
    """What the deviance and its gradient need of subjects, summed, as one vector; None if a block isn't positive definite.

    With A = T ZZ T + I for T = diag(theta): the log-determinant, RZX'RZX, RZX'cu, cu'cu; then
    the log-determinant's derivatives, and for each component k the matrix M_k by which the
    penalised sum of squares changes: minus twice (1, b)' M_k (1, b) at coefficients b. So
    one pass serves both, though b is known only after it.
    """
    p = len(theta)
    a = theta[None, :, None] * zz * theta[None, None, :] + np.eye(p)
    try:
        low = np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        return None
    logdet = 2 * np.log(np.diagonal(low, axis1=1, axis2=2)).sum()
    cu = np.linalg.solve(low, (theta * zy)[..., None])[..., 0]
    rzx = np.linalg.solve(low, theta[None, :, None] * zz)
    inverse = np.linalg.inv(a)
    down = inverse * theta[None, None, :]  # A^-1 T
    turn = 2 * np.einsum("skj,sjk->k", zz, theta[None, :, None] * inverse)
    w = np.concatenate([zy[..., None], -zz], 2)  # Z'(y - X b) = w (1, b)
    u = down @ w
    g = w - zz @ (theta[None, :, None] * u)
    m = np.einsum("ski,skj->kij", u, g)
    return np.concatenate([[logdet], np.einsum("sij,sik->jk", rzx, rzx).ravel(), np.einsum("sij,si->j", rzx, cu), [(cu * cu).sum()], turn, m.ravel()])


def deviance(sums: np.ndarray | None, n: int, xx: np.ndarray, xy: np.ndarray, yy: float) -> tuple[float, np.ndarray]:
    """The profiled deviance, log-determinant + n (1 + ln(2 pi r2 / n)), and its gradient."""
    p = len(xy)
    worst = _WORST, np.zeros(p)
    if sums is None:
        return worst
    at = 1 + p * p
    rr = xx - sums[1:at].reshape(p, p)
    c = xy - sums[at : at + p]
    try:
        low = np.linalg.cholesky(rr)
    except np.linalg.LinAlgError:
        return worst
    cb = np.linalg.solve(low, c)
    r2 = yy - sums[at + p] - float(cb @ cb)
    if not r2 > 0:
        return worst
    b = np.concatenate([[1.0], np.linalg.solve(low.T, cb)])
    turn, m = sums[at + p + 1 : at + 2 * p + 1], sums[at + 2 * p + 1 :].reshape(p, p + 1, p + 1)
    return float(sums[0] + n * (1 + math.log(2 * math.pi * r2 / n))), turn - 2 * n / r2 * np.einsum("kij,i,j->k", m, b, b)


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 200, tol: float = 1e-9) -> tuple[np.ndarray, float]:
    """A minimum over non-negative vectors of f, which gives a value and a gradient: quasi-Newton steps on the variables that aren't held at 0.

    f may be even in each variable, so that its gradient vanishes at 0: before the search
    ends, each variable at 0 is tried a little above it.
    """
    x, (value, gradient) = start.copy(), f(start)
    h = np.eye(len(x))
    for _ in range(steps):
        free = (x > 0) | (gradient < 0)
        d = np.zeros_like(x)
        d[free] = -h[np.ix_(free, free)] @ gradient[free]
        if free.any() and d @ gradient > -1e-16:
            h = np.eye(len(x))
            d = np.where(free, -gradient, 0)
        size, new = 1.0, None
        while free.any() and size > 1e-10:
            y = np.maximum(x + size * d, 0)
            v, g = f(y)
            if v < value - 1e-4 * abs(gradient @ (y - x)):
                new = y, v, g
                break
            size /= 2
        done = new is None
        if new:
            y, v, g = new
            s, t = y - x, g - gradient
            done = value - v < tol * (abs(value) + 1)
            if s @ t > 1e-14:
                rho = 1 / (s @ t)
                left = np.eye(len(x)) - rho * np.outer(s, t)
                h = left @ h @ left.T + rho * np.outer(s, s)
            x, value, gradient = y, v, g
        if done:
            for k in np.flatnonzero(x == 0):
                y = x.copy()
                y[k] = 0.01
                v, g = f(y)
                if v < value - tol * (abs(value) + 1):
                    x, value, gradient, h, done = y, v, g, np.eye(len(x)), False
            if done:
                break
    return x, value


@dataclass(frozen=True)
class MixedFit:
    n: int
    theta: list[float]
    loglik: float


def packed_statistics(stats: DataFrame, p: int) -> DataFrame:
    """(zz, zy): subjects' matrices and vectors as the bytes of arrays, a row for BLOCK of them at most, so that each evaluation reads them as they are."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(a, BLOCK) for a in range(0, batch.num_rows, BLOCK)):
                xx = part.column("xx").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                zz, zy = _unpack(xx, xx, part.column("xy").flatten().to_numpy(zero_copy_only=False), p)
                yield pa.RecordBatch.from_arrays([pa.array([zz.tobytes()], pa.binary()), pa.array([zy.tobytes()], pa.binary())], names=["zz", "zy"])

    return stats.select("xx", "xy").mapInArrow(run, "zz binary, zy binary")


def fit_statistics(stats: DataFrame, p: int) -> MixedFit:
    """The maximum likelihood over theta >= 0, from three starts, of statistics by subject."""
    i, j = np.triu_indices(p)
    total = stats.agg(F.sum("n").alias("n"), F.count("*").alias("subjects"), F.array(*[F.sum(F.get("xx", F.lit(k))) for k in range(len(i))]).alias("xx"), F.array(*[F.sum(F.get("xy", F.lit(k))) for k in range(p)]).alias("xy"), F.sum("yy").alias("yy")).first()
    if not total["subjects"]:
        return MixedFit(0, [], math.nan)
    xx = np.zeros((p, p))
    xx[i, j] = xx[j, i] = total["xx"]
    xy, n, yy = np.array(total["xy"]), total["n"], total["yy"]
    packed = None
    if total["subjects"] <= DRIVER_SUBJECTS:
        rows = stats.select("n", "xx", "xy").toPandas()
        zz, zy = _unpack(rows["n"], np.array(rows["xx"].tolist()), rows["xy"].tolist(), p)

        def sums(theta):
            parts = [block_sums(theta, zz[a : a + BLOCK], zy[a : a + BLOCK]) for a in range(0, len(zz), BLOCK)]
            return None if any(x is None for x in parts) else sum(parts)

    else:

        packed = packed_statistics(stats, p).persist()

        def sums(theta):
            def run(batches):
                # a task's blocks come back as one vector, null if one isn't positive definite
                parts = [block_sums(theta, np.frombuffer(zz).reshape(-1, p, p), np.frombuffer(zy).reshape(-1, p)) for b in batches for zz, zy in zip(b.column("zz").to_pylist(), b.column("zy").to_pylist(), strict=True)]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array([None if any(x is None for x in parts) else sum(parts)], pa.list_(pa.float64()))], names=["v"])

            got = [r["v"] for r in packed.mapInArrow(run, "v array<double>").collect()]
            return None if any(v is None for v in got) else np.sum(np.array(got), 0)

    def f(theta):
        return deviance(sums(theta), n, xx, xy, yy)

    try:
        # the searches don't need each other, so their jobs run side by side
        with ThreadPoolExecutor(3) as pool:
            theta, dev = min(pool.map(lambda s: minimise(f, np.full(p, s)), (1.0, 0.5, 2.0)), key=lambda r: r[1])
    finally:
        if packed is not None:
            packed.unpersist()
    return MixedFit(n, theta.tolist(), -dev / 2)


def mixed_model(df: DataFrame, subject: str, response: str, names: list[str]) -> MixedFit:
    """response on the scaled columns and an intercept, with slopes of all of them by subject.

    Columns are scaled over all rows; then rows that lack the response or one of these
    columns are left out.
    """
    from ..operators.frames import z_scores

    rows = z_scores(df, names).na.drop(subset=[subject, response, *[f"z_{c}" for c in names]])
    stats = subject_statistics(rows, subject, F.col(response).cast("double"), [F.lit(1.0), *[F.col(f"z_{c}") for c in names]])
    stats = stats.persist()
    try:
        return fit_statistics(stats, len(names) + 1)
    finally:
        stats.unpersist()


def delta_loglik(df: DataFrame, subject: str, response: str, full: list[str], base: list[str]) -> dict[str, float]:
    """Log-likelihoods of the full and the base model, their difference, and 1 - full / base. Each leaves out its own incomplete rows."""
    a, b = mixed_model(df, subject, response, full), mixed_model(df, subject, response, base)
    return {"full": a.loglik, "base": b.loglik, "delta": a.loglik - b.loglik, "mcfadden": 1 - a.loglik / b.loglik}
