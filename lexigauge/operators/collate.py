"""Collation of results and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Orders of training-language sets in tables. Fixed values.
LANGUAGE_ORDER = (("eng",), ("nld",), ("zho",), ("eng", "nld"), ("eng", "zho"), ("nld", "zho"), ("eng", "nld", "zho"))


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in order, as when later files override. An aggregation, combined before its shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order, *rest))
    return df.groupBy(*keys).agg(best.alias("r")).select(*keys, *[F.col(f"r.{c}") for c in rest]).select(*df.columns)


def merged(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of all parts; for a key in several, those of the last part."""
    tagged = [p.withColumn("__part", F.lit(k)) for k, p in enumerate(parts)]
    every = tagged[0]
    for p in tagged[1:]:
        every = every.unionByName(p)
    return last_wins(every, keys, ["__part"]).drop("__part")


def header_fill(df: DataFrame, order: str, is_header: Column, name: Column, group: list[str] | None = None) -> DataFrame:
    """df with header: the name of the last header row before each, itself included. group: what bounds a table (a file); without it all rows are one table."""
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("header", F.last(F.when(is_header, name), ignorenulls=True).over(w))


def indent(alias: Column) -> Column:
    return F.length(alias) - F.length(F.ltrim(alias))


def metric_name(task: Column) -> Column:
    return F.when(task.startswith("global_piqa"), "acc_norm,none").otherwise("acc,none")


def group_accuracy(df: DataFrame, group: list[str], accuracy: str, size: str) -> DataFrame:
    """(group, accuracy): the mean weighted by size."""
    return df.groupBy(*group).agg((F.sum(F.col(accuracy) * F.col(size)) / F.sum(size)).alias(accuracy))


def leaderboard(scores: DataFrame, model: str, task: str, value: str, tasks: list[str] | None = None, digits: int = 2) -> DataFrame:
    """One row a model: a column for each task, null without a score, and `avg` over those present. tasks: known columns save a pass over the data."""
    wide = scores.groupBy(model).pivot(task, tasks) if tasks else scores.groupBy(model).pivot(task)
    wide = wide.agg(F.first(value))
    names = [c for c in wide.columns if c != model]
    present = F.array_compact(F.array(*[F.col(f"`{c}`") for c in names]))
    mean = F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present)
    return wide.withColumn("avg", F.when(F.size(present) > 0, F.bround(mean, digits)))


def best_marks(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """scores with is_best: whether a row has the greatest value of its keys. The best values are one aggregated table, joined back."""
    best = scores.groupBy(*keys).agg(F.max(value).alias("__best"))
    return scores.join(best, keys).withColumn("is_best", F.col(value) == F.col("__best")).drop("__best")


def markdown(rows: DataFrame, model: str, digits: int = 2) -> str:
    """A leaderboard as a Markdown table, the best of each column bold. Its rows, one a model, come to the driver."""
    columns = [c for c in rows.columns if c != model]
    got = rows.collect()
    best = {c: max((r[c] for r in got if r[c] is not None), default=None) for c in columns}

    def cell(r, c):
        if r[c] is None:
            return ""
        text = f"{r[c]:.{digits}f}"
        return f"**{text}**" if r[c] == best[c] else text

    lines = [f"| {model} | {' | '.join(columns)} |", "|" + "---|" * (len(columns) + 1)]
    return "\n".join([*lines, *(f"| {r[model]} | {' | '.join(cell(r, c) for c in columns)} |" for r in got)])


def language_rank(langs: Column) -> Column:
    """Where a sorted set of languages stands in tables; unknown sets come last."""
    out = F.lit(len(LANGUAGE_ORDER))
    for k, own in enumerate(LANGUAGE_ORDER):
        out = F.when(langs == F.array(*map(F.lit, own)), k).otherwise(out)
    return out
