"""Reading frames: joins of reading times, words and surprisal, spillover neighbours, edge trimming, scaling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe_join(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join in which null equals null. Catalyst plans it as an equi-join on coalesced keys."""
    b = b.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in b.columns])
    condition = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on])
    return a.join(b, condition, how).drop(*[f"__r_{c}" for c in on])


def word_table(tokens: DataFrame, keys: list[str], frequency: DataFrame | None = None) -> DataFrame:
    """(keys, wlen[, freq]): distinct words with their length in characters and a frequency looked up by word."""
    out = tokens.select(*keys).distinct().withColumn("wlen", F.char_length("word"))
    return out.join(frequency, [c for c in keys if c in frequency.columns], "left") if frequency is not None else out


def with_words_and_surprisal(reads: DataFrame, words: DataFrame, surprisal: DataFrame, word_keys: list[str], token_keys: list[str]) -> DataFrame:
    """Left joins; where surprisal has several rows for a token, each reading is paired with each of them."""
    return reads.join(words, word_keys, "left").join(surprisal, token_keys, "left")


def neighbour(frame: DataFrame, k: int, columns: list[str], item: str = "itemid", position: str = "wordnum") -> DataFrame:
    """(item, position, columns with the suffix kp): what stands k positions on, at the position before it. Distinct, from position 1."""
    out = frame.select(item, (F.col(position) - k).alias(position), *[F.col(c).alias(f"{c}{k}p") for c in columns])
    # dealt out as the joins need it, which serves distinct too
    return out.where(F.col(position) >= 1).repartition(item, position).distinct()


def spillover(frame: DataFrame, columns: list[str], item: str = "itemid", position: str = "wordnum", reach: int = 2) -> DataFrame:
    """frame joined with its neighbours 1 to reach positions on; rows that lack one are left out, and rows are distinct.

    All joins are on (item, position), so one shuffle of the frame serves them.
    """
    out = frame
    for k in range(1, reach + 1):
        out = out.join(neighbour(frame, k, columns, item, position), [item, position])
    return out.distinct()


def spillover_unique(frame: DataFrame, columns: list[str], item: str = "itemid", position: str = "wordnum", reach: int = 2) -> DataFrame:
    """spillover for frames with one row for each position of an item and no gaps: a window, no join."""
    w = Window.partitionBy(item).orderBy(position)
    out = frame.select("*", *[F.lead(c, k).over(w).alias(f"{c}{k}p") for k in range(1, reach + 1) for c in columns], F.lead(F.lit(1), reach).over(w).alias("__there"))
    return out.where("__there is not null").drop("__there")


def trim_edges(frame: DataFrame, group: list[str], position: str = "wordnum") -> DataFrame:
    """Rows that are at neither end of their group; null is a group of its own."""
    w = Window.partitionBy(*group)
    out = frame.withColumn("__lo", F.min(position).over(w)).withColumn("__hi", F.max(position).over(w))
    return out.where((F.col(position) != F.col("__lo")) & (F.col(position) != F.col("__hi"))).drop("__lo", "__hi")


def reading_frame(frame: DataFrame, columns: list[str], sentence: str = "sentnum") -> DataFrame:
    """Trimmed rows with the neighbours of the untrimmed frame: rows at a sentence's edge, and those without two words after them, are left out.

    That is the natural, null-equal join of the trimmed frame with spillover(frame), without
    the join: each trimmed row meets the distinct neighbours of its own position.
    """
    out = trim_edges(frame, ["itemid", sentence])
    for k in (1, 2):
        out = out.join(neighbour(frame, k, columns), ["itemid", "wordnum"])
    return out


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by order. An aggregation, combined before its shuffle."""
    rest = [c for c in df.columns if c not in keys and c != order]
    best = F.min_by(F.struct(order, *rest), F.struct(order, *rest)).alias("r")
    return df.groupBy(*keys).agg(best).select(*keys, F.col(f"r.{order}"), *[F.col(f"r.{c}") for c in rest]).select(*df.columns)


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with z_<column>: scaled over all rows before any is left out, by the sample deviation, ignoring nulls.

    The means and deviations are one row, computed by partial aggregation and broadcast; a
    window over all rows would move them to one task.
    """
    stats = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = df.crossJoin(F.broadcast(stats))
    return out.select(*df.columns, *[((F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).alias(f"z_{c}") for c in columns])


def numbered(df: DataFrame, group: list[str], order: str | Column, name: str, size: str | None = None, most: int | None = None, parts: int = 64) -> DataFrame:
    """df with `name`: a row's number in its group from 1, by ascending order; with size, also its group's number of rows; with most, only rows up to that number.

    Values are cut into about even ranges, the same for all groups, at quantiles of a sample of
    32 rows a range, and the rows below a range are added from one count a group and range. So
    a group as large as the table is still numbered by `parts` tasks. The cuts only balance:
    any would give the same numbers. Rows with one value of order stay together and are numbered
    in any order; null comes first, as a value and as a group.
    """
    df = df.select("*", F.struct(*group).alias("__g"), (F.col(order) if isinstance(order, str) else order).alias("__o"))
    drawn = df.select("__o").where("__o is not null").orderBy(F.rand(0)).limit(parts * 32)
    every = drawn.agg(F.sort_array(F.collect_list("__o")).alias("v")).first()["v"]
    cuts = list(dict.fromkeys(every[len(every) * k // parts] for k in range(1, parts))) if every else []
    df = df.withColumn("__part", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("__o"))) if cuts else F.lit(0))
    w = Window.partitionBy("__g")
    before = F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = df.groupBy("__g", "__part").agg(F.count("*").alias("__n"))  # `parts` rows a group at most
    sizes = sizes.select("__g", "__part", F.coalesce(before, F.lit(0)).alias("__below"), F.sum("__n").over(w).alias("__size"))
    if most is not None:
        sizes = sizes.where(F.col("__below") < most)
    here = F.row_number().over(Window.partitionBy("__g", "__part").orderBy("__o"))
    out = df.join(sizes, ["__g", "__part"]).withColumn(name, F.col("__below") + here)
    if most is not None:
        out = out.where(F.col(name) <= most)
    if size is not None:
        out = out.withColumn(size, F.col("__size"))
    return out.drop("__g", "__o", "__part", "__below", "__size")


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without null or NaN in the columns."""
    return df.na.drop(subset=columns)


def head(df: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first n rows in an order, for trial runs; all of them without a limit."""
    return df if n is None else df.orderBy(*order).limit(n)


def keep(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows with one of the values in a column: languages, subjects, domains or conditions."""
    return df.where(F.col(column).isin(*values))
