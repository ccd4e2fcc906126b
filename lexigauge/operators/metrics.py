"""Metrics: classification scores, correlations, pooled vectors, similarities, divergences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import cosine, divergence, dot


def binary_metrics(df: DataFrame, gold: str, pred: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, accuracy, f1, mcc): of labels 0 and 1, from one aggregation of confusion counts. F1 and MCC are 0 where they have no value."""
    g, p = F.col(gold) == 1, F.col(pred) == 1
    n = lambda c: F.sum(c.cast("double"))
    counts = df.groupBy(*(keys or [])).agg(F.count("*").alias("n"), n(g & p).alias("tp"), n(~g & p).alias("fp"), n(g & ~p).alias("fn"), n(~g & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    below = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.select(*(keys or []), "n", ((tp + tn) / F.col("n")).alias("accuracy"), F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("f1"), F.when(below > 0, (tp * tn - fp * fn) / below).otherwise(0.0).alias("mcc"))


def macro_f1(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """One row (macro_f1): the mean F1 over all labels that are right or predicted somewhere. Each row counts once for either label, in one aggregation."""
    sides = df.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col(gold) == F.col(pred)).cast("int").alias("hit")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("s")).select("s.*")
    per = sides.groupBy("label").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum("hit").alias("hit"))
    return per.agg(F.avg(2 * F.col("hit") / (F.col("g") + F.col("p"))).alias("macro_f1"))


def combined(columns: list[str]):
    """The mean of several metrics of a row, as a single score."""
    return sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns)


def categories(df: DataFrame, column: str) -> DataFrame:
    """(column, n): how many rows fell into each category."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def squared_error(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(gold) - F.col(pred)) * (F.col(gold) - F.col(pred))).alias("mse"))


def correlations(df: DataFrame, one: str, others: list[str]) -> DataFrame:
    """(column, n, r) of one column with each other, over rows where both have values. One pass over the data."""
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = df.agg(*[F.struct(F.lit(c).alias("column"), F.count(F.when(value(c).isNotNull() & value(one).isNotNull(), 1)).alias("n"), F.corr(value(one), value(c)).alias("r")).alias(c) for c in others])
    return row.select(F.explode(F.array(*others)).alias("x")).select("x.*")


def mean_vectors(df: DataFrame, keys: list[str], vector: str, dim: int) -> DataFrame:
    """(keys, vector) with the mean of each of dim components; zeros where a group has no vector. One aggregation, no explode."""
    out = df.groupBy(*keys).agg(*[F.coalesce(F.avg(F.get(vector, F.lit(k)).cast("double")), F.lit(0.0)).alias(f"c{k}") for k in range(dim)])
    return out.select(*keys, F.array(*[f"c{k}" for k in range(dim)]).alias(vector))


def lower_triangle(items: DataFrame, key: str, vector: str, measure: str = "cosine") -> DataFrame:
    """(i, j, similarity) of all pairs with i > j of an item set that is small by nature (one row for each class or stimulus)."""
    rows = items.select(F.col(key).alias("k"), F.col(vector).alias("v"))
    a, b = rows.alias("a"), rows.alias("b")
    f = cosine if measure == "cosine" else dot
    return a.join(b, F.col("a.k") > F.col("b.k")).select(F.col("a.k").alias("i"), F.col("b.k").alias("j"), f(F.col("a.v"), F.col("b.v")).alias("similarity"))


def rank_table(df: DataFrame, value: str, parts: int = 64) -> DataFrame:
    """(value, rank) of each distinct value, equals sharing the mean of their ranks.

    Equal values are counted before the shuffle. Values are then dealt into about even ranges
    by quantiles, each ranked on its own, and the sizes of the ranges below are added: one
    small table, so that no task sees all values.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("n")).where(F.col(value).isNotNull())
    cuts = sorted(set(counts.stat.approxQuantile(value, [k / parts for k in range(1, parts)], 0.01)))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(value))) if cuts else F.lit(0)
    counts = counts.withColumn("part", part)
    sizes = counts.groupBy("part").agg(F.sum("n").alias("size"))  # `parts` rows at most
    below = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("__before", before).join(F.broadcast(below), "part").select(value, (F.col("below") + F.col("__before") + (F.col("n") + 1) / 2.0).alias("rank"))


def rank_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, rho): Spearman's correlation with mean ranks."""
    ra, rb = rank_table(df, a).withColumnRenamed("rank", "__ra"), rank_table(df, b).withColumnRenamed("rank", "__rb")
    return df.join(ra, a).join(rb, b).agg(F.count("*").alias("n"), F.corr("__ra", "__rb").alias("rho"))


def aligned_divergence(human: DataFrame, model: DataFrame, key: str, shares: str) -> DataFrame:
    """One row (n, kl): mean divergence of the model's shares from the human ones over trials in both."""
    both = human.select(key, F.col(shares).alias("h")).join(model.select(key, F.col(shares).alias("m")), key)
    return both.agg(F.count("*").alias("n"), F.avg(divergence(F.col("h"), F.col("m"))).alias("kl"))


def forced_choice(df: DataFrame, right: str, others: list[str]) -> DataFrame:
    """One row (n, accuracy): how often the right option is strictly above each other."""
    wins = F.col(right) > F.greatest(*others) if len(others) > 1 else F.col(right) > F.col(others[0])
    return df.agg(F.count("*").alias("n"), F.avg(wins.cast("double")).alias("accuracy"))
