"""Least squares from one aggregation, and what it explains beyond a baseline."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import t_test

#: Predictors of reading times: frequency, length and context length; with the word before for self-paced reading. Fixed values.
EYE_BASE = ["Subtlex_log10", "length", "context_length"]
EYE_MEASURES = ["RTfirstfix", "RTfirstpass", "RTgopast", "RTrightbound"]
SELF_PACED_BASE = [*EYE_BASE, "prev_length", "prev_pred"]
SELF_PACED_MEASURE = "self_paced_reading_time"


@dataclass(frozen=True)
class Fit:
    n: int
    r2: float
    names: list[str]
    coef: list[float]
    t: list[float]
    p: list[float]
    aic: float


def terms(mains: list[str], interactions: bool = True) -> dict[str, Column]:
    """Columns of a design without its intercept: main effects and all products of two."""
    out = {m: F.col(m).cast("double") for m in mains}
    if interactions:
        out |= {f"{a}:{b}": F.col(a).cast("double") * F.col(b).cast("double") for a, b in combinations(mains, 2)}
    return out


def moments(df: DataFrame, columns: dict[str, Column]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, covariances) over rows that have all columns: one aggregation, in the stable form that combines partial results."""
    names = [f"c{k}" for k in range(len(columns))]
    rows = df.select(*[c.alias(n) for n, c in zip(names, columns.values(), strict=True)]).na.drop()
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    r = rows.agg(F.count("*").alias("n"), *[F.avg(a).alias(f"m_{a}") for a in names], *[F.covar_pop(a, b).alias(f"v_{a}_{b}") for a, b in pairs]).first()
    n = r["n"]
    mean = np.array([r[f"m_{a}"] if n else np.nan for a in names], float)
    cov = np.full((len(names), len(names)), np.nan)
    if n:
        for a, b in pairs:
            i, j = names.index(a), names.index(b)
            cov[i, j] = cov[j, i] = r[f"v_{a}_{b}"]
    return n, mean, cov


def least_squares(df: DataFrame, response: str, design: dict[str, Column]) -> Fit:
    """Coefficients (the intercept first), t, p, R2 and AIC of response on the design, over complete rows.

    Columns are scaled before they are solved; those that depend on others get least-norm
    coefficients. Without a row more than there are coefficients t and p are NaN.
    """
    n, mean, cov = moments(df, {"y": F.col(response).cast("double")} | design)
    k = len(design)
    names = ["intercept", *design]
    if n == 0 or not cov[0, 0] > 0:
        return Fit(n, math.nan, names, [math.nan] * (k + 1), [math.nan] * (k + 1), [math.nan] * (k + 1), math.nan)
    scale = np.sqrt(np.where(np.diag(cov)[1:] > 0, np.diag(cov)[1:], 1))
    a = cov[1:, 1:] / np.outer(scale, scale)
    inverse = np.linalg.pinv(a, rcond=1e-12, hermitian=True)
    beta = inverse @ (cov[1:, 0] / scale)
    rss = max(n * (cov[0, 0] - float(beta @ (cov[1:, 0] / scale))), 0.0)
    coef = beta / scale
    intercept = mean[0] - coef @ mean[1:]
    free = n - k - 1
    s2 = rss / free if free > 0 else math.nan
    se = np.sqrt(np.maximum(np.diag(inverse), 0) * s2 / n) / scale
    se0 = math.sqrt(s2 * (1 / n + float((mean[1:] / scale) @ inverse @ (mean[1:] / scale)) / n)) if free > 0 else math.nan
    every = np.array([intercept, *coef])
    with np.errstate(divide="ignore", invalid="ignore"):
        t = every / np.array([se0, *se])
    aic = n * (math.log(2 * math.pi * rss / n) + 1) + 2 * (k + 1) if rss > 0 else -math.inf
    return Fit(n, 1 - rss / (n * cov[0, 0]), names, every.tolist(), t.tolist(), [t_test(float(x), free) for x in t], aic)


def partial_r2(base: float, full: float) -> float:
    """The share of what a baseline leaves unexplained that the full model explains."""
    return (full - base) / (1 - base)


def predictive_power(df: DataFrame, responses: list[str], base: list[str], predictor: str, interactions: bool = True) -> float:
    """The mean partial R2 of a predictor over responses, each over rows that are complete for the model in question."""
    gains = []
    for y in responses:
        low = least_squares(df, y, terms(base, interactions))
        high = least_squares(df, y, terms(base, interactions) | {predictor: F.col(predictor).cast("double")})
        gains.append(partial_r2(low.r2, high.r2))
    return float(np.mean(gains))
