"""Samples and splits by hashes of an id: the same rows on every run, whatever the partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import text_hash
from .frames import numbered


def draw(seed: int, *keys: str) -> Column:
    """An even number in [0, 1) for each row, from its keys."""
    return text_hash(F.lit(seed), *keys) / float(1 << 48)


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, or all if there are fewer: a top-n by hash, which each task limits first."""
    return df.withColumn("__d", draw(seed, key)).orderBy("__d", key).limit(n).drop("__d")


def share_split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """df with `split`: each row goes by its own hash, so shares hold in expectation and nothing is shuffled."""
    if not math.isclose(sum(shares.values()), 1.0, abs_tol=1e-9):
        raise ValueError("shares must sum to 1")
    out, at = F.lit(list(shares)[-1]), 1.0
    for name in reversed(list(shares)[:-1]):
        at = sum(list(shares.values())[: list(shares).index(name) + 1])
        out = F.when(draw(seed, key) < at, name).otherwise(out)
    return df.withColumn("split", out)


def exact_split(df: DataFrame, group: list[str], order: Column, shares: dict[str, float]) -> DataFrame:
    """df with `split`: of each group's rows in order exactly the given shares, rounded down but for the first name; groups of under 3 rows go to the first. Null is a group of its own."""
    if not math.isclose(sum(shares.values()), 1.0, abs_tol=1e-9):
        raise ValueError("shares must sum to 1")
    names = list(shares)
    out, taken = F.lit(names[0]), F.lit(0)
    column = None
    for name in names[1:]:
        taken_after = taken + F.floor(F.col("__n") * F.lit(shares[name]) + 1e-9)
        hit = (F.col("__r") > taken) & (F.col("__r") <= taken_after)
        column = F.when(hit, name) if column is None else column.when(hit, name)
        taken = taken_after
    column = out if column is None else F.when(F.col("__n") < 3, names[0]).otherwise(column.otherwise(names[0]))
    return numbered(df, group, order, "__r", size="__n").withColumn("split", column).drop("__r", "__n")


def uniform_mixture(df: DataFrame, group: str, order: Column) -> DataFrame:
    """As many rows of each group as the smallest one has, the first by order."""
    cap = df.groupBy(group).count().agg(F.min("count")).first()[0] or 0
    return numbered(df, [group], order, "__r", most=cap).drop("__r")
