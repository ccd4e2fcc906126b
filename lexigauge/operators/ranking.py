"""Candidate ranking: from scores to predictions under a tie policy, to accuracies and averages.

Scores are rows (item_id, cand_idx, score, ...). All policies rank NaN and null last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import text_hash
from .frames import numbered

POLICIES = ("first", "seeded", "fractional", "strict")
_LOWEST = float("-inf")


def ranked(score: Column) -> Column:
    """A score to rank by: NaN and null below all others."""
    return F.when(score.isNull() | F.isnan(score), F.lit(_LOWEST)).otherwise(score)


def sum_in_phrase(tokens: DataFrame, normalise: bool = False) -> DataFrame:
    """(item_id, cand_idx, score, n_tokens): summed log-probabilities of the tokens in the phrase, over their number (1 at least) if normalised. One aggregation, combined before its shuffle."""
    inside = F.sum(F.when(F.col("in_phrase"), F.col("logprob")).otherwise(F.lit(0.0)))
    n = F.sum(F.col("in_phrase").cast("int"))
    return tokens.groupBy("item_id", "cand_idx").agg((inside / F.greatest(n, F.lit(1)) if normalise else inside).alias("score"), n.alias("n_tokens"))


def length_normalised(score: Column, length: Column) -> Column:
    return score / F.greatest(length, F.lit(1))


def characters(text: Column) -> Column:
    """The length by which a candidate's score is divided where lengths are of characters: 1 at least."""
    return F.greatest(F.length(text), F.lit(1))


def pick(scores: DataFrame, seed: int = 0, policy: str = "first") -> DataFrame:
    """(item_id, pred, score) of each item's best candidate: the lowest index of equals, or one of them by a seeded hash.

    An aggregation over structs, so items are combined before they are shuffled and no item
    is sorted.
    """
    if policy not in ("first", "seeded"):
        raise ValueError(f"{policy} picks no single candidate")
    tie = -F.col("cand_idx").cast("long") if policy == "first" else text_hash(F.lit(seed), "item_id", "cand_idx")
    best = F.max(F.struct(ranked(F.col("score")).alias("score"), tie.alias("tie"), F.col("cand_idx").alias("pred")))
    return scores.groupBy("item_id").agg(best.alias("b")).select("item_id", "b.pred", "b.score")


def credit(scores: DataFrame, gold: str = "gold", policy: str = "fractional", unknown: str | None = None) -> DataFrame:
    """(item_id, credit) of each item; scores have a boolean column that marks the right candidate.

    fractional: 1 over the number of best candidates if the right one is among them. strict:
    1 only if the right one is better than all others and no candidate has an unknown token.
    first: 1 if the right one is the first of the best. Two aggregations on the item, which
    the first combined before its shuffle; nothing is sorted.
    """
    score = ranked(F.col("score"))
    # how many share the best score: the greatest (score, count) of a histogram by score
    ties = scores.groupBy("item_id", score.alias("s")).agg(F.count("*").alias("n"), F.max(F.col(gold).cast("int")).alias("g"), F.min("cand_idx").alias("first"), F.min(F.when(F.col(gold), F.col("cand_idx"))).alias("at"), (F.max(F.col(unknown).cast("int")) if unknown else F.lit(0)).alias("u"))
    top = ties.groupBy("item_id").agg(F.max(F.struct("s", "n", "g", "first", "at")).alias("t"), F.max("u").alias("u"))
    right = F.col("t.g") == 1
    value = {
        "fractional": F.when(right, 1.0 / F.col("t.n")).otherwise(0.0),
        "strict": F.when(right & (F.col("t.n") == 1) & (F.col("u") == 0), 1.0).otherwise(0.0),
        "first": F.when(right & (F.col("t.at") == F.col("t.first")), 1.0).otherwise(0.0),
    }
    if policy not in value:
        raise ValueError(f"no policy {policy}")
    return top.select("item_id", value[policy].alias("credit"))


def accuracies(df: DataFrame, keys: list[str], correct: Column) -> DataFrame:
    """(keys, total, correct, accuracy in per cent)."""
    out = df.groupBy(*keys).agg(F.count("*").alias("total"), F.sum(correct.cast("double")).alias("correct"))
    return out.withColumn("accuracy", 100 * F.col("correct") / F.col("total"))


def levels(items: DataFrame, correct: Column, meta: str = "meta", temperature: str | None = None) -> DataFrame:
    """(level, [temperature,] key, value, total, correct, accuracy): accuracies by grouping value, by grouping key and overall, all of one aggregation.

    items hold a map of grouping keys and values, as decoders give it; an item counts once for
    each of its keys, and once overall, an item without keys too. level is value, key or all;
    at the higher levels key and value are null, and a null or empty value is a value of its
    own. Grouping sets make the levels of each row before the shuffle, which is the only one.
    """
    keys = [temperature] if temperature else []
    each = items.select(*keys, correct.cast("double").alias("__c"), F.posexplode_outer(meta).alias("__at", "key", "value"))
    once = F.coalesce(F.col("__at"), F.lit(0)) == 0
    sets = [[*keys, "key", "value"], [*keys, "key"], keys]
    grouped = each.groupingSets([[F.col(c) for c in s] for s in sets], *[*keys, "key", "value"])
    out = grouped.agg(F.grouping("key").alias("__k"), F.grouping("value").alias("__v"), F.count("key").alias("__n"), F.sum(F.when(F.col("key").isNotNull(), F.col("__c"))).alias("__s"), F.sum(once.cast("long")).alias("__n1"), F.sum(F.when(once, F.col("__c"))).alias("__s1"))
    every = F.col("__k") == 1
    total, right = F.when(every, F.col("__n1")).otherwise(F.col("__n")), F.when(every, F.col("__s1")).otherwise(F.col("__s"))
    out = out.where(every | (F.col("__n") > 0))  # an item without keys is in no key's group
    level = F.when(every, "all").when(F.col("__v") == 1, "key").otherwise("value")
    return out.select(level.alias("level"), *keys, "key", "value", total.alias("total"), right.alias("correct"), (100 * right / total).alias("accuracy"))


def macro_micro(df: DataFrame, value: str = "accuracy", size: str = "total") -> DataFrame:
    """One row: the number of groups, the mean of their values, and their mean weighted by size."""
    return df.agg(F.count("*").alias("groups"), F.avg(value).alias("macro"), (F.sum(F.col(value) * F.col(size)) / F.sum(size)).alias("micro"))


def nested_macro(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """The mean over the outermost level of means over the next and so on: one row (macro). Levels are from the outermost in."""
    for k in range(len(levels), -1, -1):
        df = df.groupBy(*levels[:k]).agg(F.avg(value).alias(value))
    return df.select(F.col(value).alias("macro"))


def operations_split(uid: Column) -> Column:
    """The split of an operations subtask: regular, ambiref or move_contents, by how its name begins."""
    out = F.lit(None).cast("string")
    for name in ("regular", "ambiref", "move_contents"):
        out = F.when(uid.startswith(name), name).otherwise(out)
    return out


def best_temperature(df: DataFrame, temperature: str = "temperature", value: str = "accuracy") -> DataFrame:
    """One row: the temperature with the best value, the lowest of equals."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(temperature)).alias("t")))
    return df.agg(best.alias("b")).select((-F.col("b.t")).alias(temperature), F.col("b.v").alias(value))


def prediction_ids(df: DataFrame, order: str, uid: str = "uid") -> DataFrame:
    """df with id: the uid and the row's number in it from 0, in reading order."""
    out = numbered(df, [uid], order, "__n")
    return out.withColumn("id", F.concat_ws("_", F.col(uid), (F.col("__n") - 1).cast("string"))).drop("__n")


def best_epoch(df: DataFrame, keys: list[str], epoch: str = "epoch", score: str = "score", patience: int | None = None, least: float = 0.001) -> DataFrame:
    """(keys, epoch, score) of the best epoch, the first of equals; with patience, of those before training stops: that many epochs in a row that don't beat the best before them by `least`."""
    if patience is not None:
        w = Window.partitionBy(*keys).orderBy(epoch)
        before = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
        better = F.coalesce(F.col(score) > before + least, F.lit(True))
        df = df.withColumn("__last", F.last(F.when(better, F.col(epoch)), ignorenulls=True).over(w)).withColumn("__n", F.row_number().over(w))
        at = F.last(F.when(F.col("__last") == F.col(epoch), F.col("__n")), ignorenulls=True).over(w)
        df = df.withColumn("__waited", F.col("__n") - at)
        stop = F.min(F.when(F.col("__waited") >= patience, F.col("__n"))).over(Window.partitionBy(*keys))
        df = df.withColumn("__stop", stop).where(F.col("__stop").isNull() | (F.col("__n") <= F.col("__stop")))
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(epoch)).alias("e")))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.e")).alias(epoch), F.col("b.s").alias(score))
