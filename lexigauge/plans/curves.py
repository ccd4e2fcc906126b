"""Sigmoid curves of acquisition: bounded fits by word, in groups that Spark deals out."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import correlation_test

RESULT = "word string, n int, a double, b double, c double, d double, aoa double, category string"


def sigmoid(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, b, c, d = p
    return a / (1 + np.exp(-np.clip(b * (x - c), -500, 500))) + d


def _slopes(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, b, c, _ = p
    s = 1 / (1 + np.exp(-np.clip(b * (x - c), -500, 500)))
    return np.stack([s, a * s * (1 - s) * (x - c), -a * s * (1 - s) * b, np.ones_like(x)], 1)


def bounded_fit(x: np.ndarray, y: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 1000) -> np.ndarray | None:
    """Least squares of the sigmoid within bounds: damped Gauss-Newton steps on the parameters that aren't held at a bound."""
    p = np.clip(start, low, high)
    r = y - sigmoid(p, x)
    cost, damp = float(r @ r), 1e-3
    for _ in range(steps):
        j = _slopes(p, x)
        g = j.T @ r
        free = ~((p <= low) & (g < 0) | (p >= high) & (g > 0))
        if not free.any():
            break
        h = j[:, free].T @ j[:, free]
        moved = False
        while damp < 1e12:
            q = p.copy()
            q[free] += np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-12), g[free])
            q = np.clip(q, low, high)
            s = y - sigmoid(q, x)
            if (new := float(s @ s)) < cost:
                moved, gain = True, cost - new
                p, r, cost, damp = q, s, new, max(damp / 3, 1e-12)
                break
            damp *= 4
        if not moved or gain < 1e-14 * (cost + 1e-14):
            break
    return p if np.isfinite(p).all() else None


def _sigmoids(p: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, 1 / (1 + exp(-b (x - c)))) of a curve a row."""
    a, b, c, d = (p[:, k, None] for k in range(4))
    s = 1 / (1 + np.exp(-np.clip(b * (x - c), -500, 500)))
    return a * s + d, s


def bounded_fits(x: np.ndarray, y: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 1000) -> np.ndarray:
    """bounded_fit of many curves with equally many points, a curve a row, each with its own damping; rows of NaN where there is no fit.

    All curves take a step at once, and those that are done leave.
    """
    out = np.clip(start, low, high)
    live, p = np.arange(len(x)), out.copy()
    value, s = _sigmoids(p, x)
    r = y - value
    cost, damp, taken = (r * r).sum(1), np.full(len(x), 1e-3), np.zeros(len(x), np.int64)
    while len(live):
        a, b, c = (p[:, k, None] for k in range(3))
        slope = a * s * (1 - s)
        j = np.stack([s, slope * (x - c), -slope * b, np.ones_like(s)], 2)
        g = np.einsum("npk,np->nk", j, r)
        free = ~((p <= low) & (g < 0) | (p >= high) & (g > 0))
        h = np.einsum("npk,npl->nkl", j, j) * (free[:, :, None] & free[:, None, :])
        diagonal = np.einsum("nkk->nk", h)
        h += np.eye(4) * np.where(free, damp[:, None] * (diagonal + 1e-12), 1.0)[:, None, :]
        q = np.clip(p + np.linalg.solve(h, (g * free)[:, :, None])[:, :, 0] * free, low, high)
        value, t = _sigmoids(q, x)
        rest = y - value
        new = (rest * rest).sum(1)
        better, going = new < cost, free.any(1)
        gain = np.where(better, cost - new, np.inf)
        better &= going
        p[better], r[better], s[better], cost[better] = q[better], rest[better], t[better], new[better]
        damp = np.where(better, np.maximum(damp / 3, 1e-12), damp * 4)
        taken += better
        done = ~going | (gain < 1e-14 * (cost + 1e-14)) | (damp >= 1e12) | (taken >= steps) | ~np.isfinite(cost)
        out[live[done]] = p[done]
        live, p, r, s, cost, damp, taken, x, y, low, high = (v[~done] for v in (live, p, r, s, cost, damp, taken, x, y, low, high))
    return np.where(np.isfinite(out).all(1)[:, None], out, np.nan)


def child_age(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray | None, float | None, str]:
    """(parameters, age at which half of children know a word, category), from shares by age."""
    if len(x) < 3:
        return None, None, "too few points"
    p = bounded_fit(x, y, np.array([1, 0.1, x.mean(), 0]), np.array([0, 0, x.min(), -0.5]), np.array([2, 1, x.max(), 0.5]))
    if p is None:
        return None, None, "no fit"
    return p, *_crossing(p, 0.5, x.min(), x.max())


def _crossing(p: np.ndarray, level: float, low: float, high: float, least: float = 0.0) -> tuple[float | None, str]:
    """Where a curve crosses a level, and what came of it."""
    a, b, c, d = p
    if a <= least or b <= least:
        return None, "bad shape"
    if level <= d:
        return None, "already acquired"
    if level >= a + d:
        return None, "never reached"
    at = c - math.log(a / (level - d) - 1) / b
    return (at, "ok") if low <= at <= high else (None, "outside range")


def model_age(steps: np.ndarray, surprisal: np.ndarray, chance: float) -> tuple[np.ndarray | None, float | None, str]:
    """(parameters, log10 of the step at which surprisal is midway between chance and its least, category)."""
    if len(steps) < 3:
        return None, None, "too few points"
    x, y = np.log10(steps + 1), -surprisal
    if np.ptp(y) == 0:
        return None, None, "bad shape"
    level = -(chance + surprisal.min()) / 2
    span = float(np.ptp(y))
    low = np.array([0, 0, x.min() - 1, y.min() - 2 * span - 1])
    high = np.array([10 * span + 1, 100, x.max() + 1, y.max() + 1])
    p = bounded_fit(x, y, np.array([span, 1.0, x.mean(), y.min()]), low, high, 20_000)
    if p is None:
        return None, None, "no fit"
    return p, *_crossing(p, level, x.min(), x.max(), 1e-6)


def _curves(points: DataFrame, x: str, y: str, more: list, ages) -> DataFrame:
    """RESULT for each word of points (word, x, y), rows without y left out: a word's points become a row of arrays, and ages fits the curves of many words with equally many points at once."""
    point = F.when(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(y), F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    rows = points.groupBy("word").agg(F.sort_array(F.collect_list(point)).alias("points"), *more)
    rows = rows.select("word", F.col("points.x").alias("x"), F.col("points.y").alias("y"), *rows.columns[2:])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = f["x"].map(len)
            for size, own in f.groupby(n):
                xs, ys = (np.array(own[c].tolist(), float).reshape(len(own), size) for c in ("x", "y"))
                found = ages(xs, ys, own) if size >= 3 else [(None, None, "too few points")] * len(own)
                yield _rows(own["word"], size, found)

    return rows.mapInPandas(run, RESULT)


def _rows(words: pd.Series, n: int, found: list[tuple]) -> pd.DataFrame:
    p = np.array([[np.nan] * 4 if x[0] is None else x[0] for x in found], float).reshape(len(found), 4)
    out = {"word": words.to_numpy(), "n": np.full(len(found), n, np.int32)} | {k: pd.array(p[:, i], "Float64") for i, k in enumerate("abcd")}
    out |= {"aoa": pd.array([x[1] for x in found], "Float64"), "category": [x[2] for x in found]}
    return pd.DataFrame(out)


def child_curves(shares: DataFrame) -> DataFrame:
    """RESULT for each word of (word, age, proportion), null proportions left out. A word has a point an age, so groups are small."""

    def ages(x: np.ndarray, y: np.ndarray, _) -> list[tuple]:
        one, low, high = np.ones(len(x)), x.min(1), x.max(1)
        p = bounded_fits(x, y, np.stack([one, 0.1 * one, x.mean(1), 0 * one], 1), np.stack([0 * one, 0 * one, low, -0.5 * one], 1), np.stack([2 * one, one, high, 0.5 * one], 1))
        return [(q, *_crossing(q, 0.5, a, b)) if np.isfinite(q).all() else (None, None, "no fit") for q, a, b in zip(p, low, high, strict=True)]

    points = shares.groupBy("word", "age").agg(F.avg("proportion").alias("proportion"))
    return _curves(points, "age", "proportion", [], ages)


def model_curves(surprisals: DataFrame) -> DataFrame:
    """RESULT for each word of STEP_SURPRISAL rows; aoa is the log10 of a step. Contexts are averaged in Spark before curves are fitted; a NaN makes its point void."""
    points = surprisals.groupBy("word", "step").agg(F.avg("surprisal").alias("s"), F.max("n_subword").alias("k"), F.max("vocab_size").alias("v"))

    def ages(steps: np.ndarray, surprisal: np.ndarray, own: pd.DataFrame) -> list[tuple]:
        chance = own["k"].to_numpy(float) * np.log(own["v"].to_numpy(float))
        x, y = np.log10(steps + 1), -surprisal
        span, least, most = np.ptp(y, 1), y.min(1), y.max(1)
        level = -(chance + surprisal.min(1)) / 2
        zero, p = np.zeros(len(x)), np.full((len(x), 4), np.nan)
        low = np.stack([zero, zero, x.min(1) - 1, least - 2 * span - 1], 1)
        high = np.stack([10 * span + 1, zero + 100, x.max(1) + 1, most + 1], 1)
        some = span > 0
        p[some] = bounded_fits(x[some], y[some], np.stack([span, zero + 1, x.mean(1), least], 1)[some], low[some], high[some], 20_000)
        ends = zip(p, span, level, x.min(1), x.max(1), strict=True)
        return [(None, None, "bad shape") if w == 0 else (q, *_crossing(q, v, a, b, 1e-6)) if np.isfinite(q).all() else (None, None, "no fit") for q, w, v, a, b in ends]

    return _curves(points, "step", "s", [F.max("k").alias("k"), F.max("v").alias("v")], ages)


def curve_fitness(model: DataFrame, child: DataFrame) -> dict[str, float]:
    """The correlation of model and child ages of words that have both; 0 for under 3 words or p over 0.1."""
    both = model.where("aoa is not null").select("word", F.col("aoa").alias("m")).join(child.where("aoa is not null").select("word", F.col("aoa").alias("c")), "word")
    r = both.agg(F.count("*").alias("n"), F.corr("m", "c").alias("r")).first()
    n, value = r["n"], r["r"]
    if n < 3 or value is None or math.isnan(value):
        return {"n": n, "r": value or 0.0, "p": 1.0, "fitness": 0.0}
    p = correlation_test(value, n)
    return {"n": n, "r": value, "p": p, "fitness": value if p <= 0.1 else 0.0}


def divergences(betas: Iterable[float], human: np.ndarray, model: np.ndarray) -> list[float]:
    """For each beta the mean divergence of the softmax of scores times it from human shares; what doesn't depend on beta is worked out once, and one logarithm is taken a row."""
    p = np.clip(human, 1e-10, 1)
    own = float((p * np.log(p)).sum())
    scores = np.ascontiguousarray((model - model.max(1, keepdims=True)).T)
    p, least, out = np.ascontiguousarray(p.T), math.log(1e-10), []
    for beta in betas:
        z = beta * scores
        z -= np.log(np.exp(z).sum(0))
        out.append((own - float((p * np.clip(z, least, 0, out=z)).sum())) / len(human))
    return out


def divergence_at(beta: float, human: np.ndarray, model: np.ndarray) -> float:
    """The mean divergence of the softmax of scores times beta from human shares."""
    return divergences([beta], human, model)[0]


def best_beta(human: np.ndarray, model: np.ndarray, low: float = 0.025, high: float = 40.0) -> tuple[float, float]:
    """The inverse temperature at which the softmax of a model's scores is closest to human shares, and the mean divergence there: a grid of logarithms, then golden sections."""

    def kl(log_beta: float) -> float:
        return divergence_at(math.exp(log_beta), human, model)

    grid = np.linspace(math.log(low), math.log(high), 120)
    k = int(np.argmin([kl(b) for b in grid]))
    a, b = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if kl(c) < kl(d) else (c, b)
    best = min((a, b, grid[k]), key=kl)
    return math.exp(best), kl(best)


def beta_by_group(trials: DataFrame, group: str, human: str, model: str, low: float = 0.025, high: float = 40.0) -> DataFrame:
    """(group, n, beta, kl) of trials with arrays of human shares and model scores; rows that lack one are left out.

    As best_beta, but each grid of temperatures is one aggregation of partial sums, so that no
    task holds a group: 120 points first, then twice 101 around the best one, 2.5e-5 apart in the
    logarithm at the end, and the vertex of the parabola through the last best and its neighbours.
    """
    rows = trials.select(F.col(group).alias("g"), F.col(human).alias("h"), F.col(model).alias("m")).na.drop()
    kind = rows.schema["g"].dataType.simpleString()
    found = None
    for points in (120, 101, 101):

        def run(frames: Iterator[pd.DataFrame], points: int = points) -> Iterator[pd.DataFrame]:
            for f in frames:
                for (g, lo, hi), own in f.groupby(["g", "lo", "hi"]):
                    h, m = np.array(own["h"].tolist(), float), np.array(own["m"].tolist(), float)
                    sums = [len(own) * x for x in divergences(np.exp(np.linspace(lo, hi, points)), h, m)]
                    yield pd.DataFrame({"g": [g], "lo": [lo], "hi": [hi], "n": [len(own)], "sums": [sums]})

        ranged = rows.withColumns({"lo": F.lit(math.log(low)), "hi": F.lit(math.log(high))}) if found is None else rows.join(found.select("g", "lo", "hi"), "g")
        sums = ranged.select("g", "lo", "hi", "h", "m").mapInPandas(run, f"g {kind}, lo double, hi double, n long, sums array<double>")
        means = F.array(*[F.sum(F.get("sums", F.lit(k))) / F.sum("n") for k in range(points)])
        found = sums.groupBy("g").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.sum("n").alias("n"), means.alias("kl"))
        step = (F.col("hi") - F.col("lo")) / (points - 1)
        found = found.withColumn("step", step).withColumn("k", F.array_position("kl", F.array_min("kl")).cast("int") - 1).withColumn("best", F.col("lo") + F.col("k") * step)
        found = found.select("g", "n", "kl", "k", "step", "best", F.greatest("lo", F.col("best") - F.col("step")).alias("lo"), F.least("hi", F.col("best") + F.col("step")).alias("hi"))
    before, here, after = F.when(F.col("k") > 0, F.get("kl", F.col("k") - 1)), F.get("kl", F.col("k")), F.get("kl", F.col("k") + 1)
    found = found.withColumns({"here": here, "slope": before - after, "bend": before - 2 * here + after})
    inside = F.col("bend") > 0  # null at an end of the range
    best = F.when(inside, F.col("best") + F.col("step") * F.col("slope") / (2 * F.col("bend"))).otherwise(F.col("best"))
    kl = F.when(inside, F.col("here") - F.col("slope") * F.col("slope") / (8 * F.col("bend"))).otherwise(F.col("here"))
    return found.select(F.col("g").alias(group), "n", F.exp(best).alias("beta"), kl.alias("kl"))
