"""Numeric expressions on columns and arrays, and the distributions that tests need."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def no_nan(x: Column) -> Column:
    """Null for NaN, which Spark would sort first and average over."""
    return F.when(~F.isnan(x), x)


def surprisal(p: Column) -> Column:
    return -F.ln(p)


def log_softmax(scores: Column, temperature: float | Column = 1.0) -> Column:
    """Log-probabilities of an array of scores at a temperature."""
    scaled = F.transform(scores, lambda s: s / temperature)
    top = F.array_max(scaled)
    rest = F.ln(total(F.transform(scaled, lambda s: F.exp(s - top))))
    return F.transform(scaled, lambda s: s - top - rest)


def softmax(scores: Column, beta: float | Column = 1.0) -> Column:
    """Shares of an array of scores at an inverse temperature."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp((s - top) * beta))
    return F.transform(powers, lambda p: p / total(powers))


def divergence(p: Column, q: Column, least: float = 1e-10) -> Column:
    """Kullback-Leibler divergence of q from p; shares under least count as that."""
    clip = lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(least))
    return total(F.zip_with(p, q, lambda a, b: clip(a) * F.ln(clip(a) / clip(b))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def sigmoid(x: Column, a: float, b: float, c: float, d: float) -> Column:
    return F.lit(a) / (1 + F.exp(-b * (x - c))) + d


def temperatures(low: float, high: float | None = None, step: float = 0.05) -> list[float]:
    """Temperatures from low to high, both included, none below 1e-6; only low without high."""
    if high is None:
        return [max(low, 1e-6)]
    n = math.ceil((high + step - low) / step - 1e-9)
    return [max(low + k * step, 1e-6) for k in range(n)]


def revisions(small: bool) -> list[str]:
    """Names of checkpoints in order: each million to ten, each ten to a hundred and, unless small, each hundred to a thousand."""
    ladder = [*range(1, 10), *range(10, 101 if small else 100, 10), *([] if small else range(100, 1001, 100))]
    return [f"chck_{m}M" for m in ladder]


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def t_test(t: float, freedom: float) -> float:
    """The two-sided p-value of Student's t."""
    return incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t)) if freedom > 0 and math.isfinite(t) else float("nan") if math.isnan(t) else 0.0


def correlation_test(r: float, n: int) -> float:
    """The two-sided p-value of a correlation of n pairs."""
    if n < 3 or math.isnan(r):
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    return t_test(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def text_hash(*parts: Column | str) -> Column:
    """48 bits of the MD5 of the parts as text, joined by |: the same number in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])), 1, 12), 16, 10).cast("long")
