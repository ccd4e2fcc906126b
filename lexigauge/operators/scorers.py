"""Scorers and row filters by the tags of task files, so that tasks with different rules are scored in one aggregation."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import POLICIES, ranked


@dataclass(frozen=True)
class Metric:
    """name: what it is called; policy: what a tie is worth (see ranking.credit); length: the column by which scores are divided, 1 at least; gold: the right candidate's index, None for the label of the row."""

    name: str
    policy: str = "first"
    length: str | None = None
    gold: int | None = None
    unknown_is_wrong: bool = False


#: Metrics by tag; a folder before the tag goes before the tag alone. Names of tags are fixed values.
SCORERS: dict[str, tuple[Metric, ...]] = {
    "": (Metric("acc"), Metric("acc_norm", length="n_chars")),
    "tie_handling.process_results": (Metric("acc", "fractional", gold=0),),
    "tie_handling.process_results_labeled": (Metric("acc", "fractional"), Metric("acc_norm", "fractional", "n_chars")),
    "hanzi/utils.process_results": (Metric("acc", "strict", gold=0, unknown_is_wrong=True),),
    "global_piqa_parallel/utils.process_results": (Metric("acc_norm", length="n_tokens"),),
    "global_piqa_nonparallel/utils.process_results": (Metric("acc_norm", length="n_tokens"),),
}
#: The column that a filter's name is compared with, by folder. Fixed values.
FILTERED = {"global_mmlu/full": "subject", "global_mmlu/default": "subject_category", "include": "domain"}


def register(tag: str, *metrics: Metric) -> None:
    """Adds or replaces a scorer; tag: module.function, with the task's folder before it where several have one name."""
    for m in metrics:
        if m.policy not in POLICIES or m.policy == "seeded":
            raise ValueError(f"no policy {m.policy} for a scorer")
    SCORERS[tag] = metrics


def _bare(tag: str | None) -> str:
    return re.sub(r"^!function\s+", "", tag or "").strip("'\" ")


def metrics_of(tag: str | None, folder: str | None = None) -> tuple[Metric, ...]:
    """A task's metrics; a tag that isn't registered is an error."""
    name = _bare(tag)
    keys = [f"{part}/{name}" for part in reversed((folder or "").strip("/").split("/"))] if name else []
    for key in [*keys, name]:
        if key in SCORERS:
            return SCORERS[key]
    raise ValueError(f"no scorer {name!r} is registered (task folder {folder!r})")


def rules(registry: DataFrame, listed_only: bool = False) -> DataFrame:
    """(task, metric, policy, length, at, strict): a row for each metric of each task of a registry. listed_only: of tasks without a scorer only the metric that the file lists first."""
    rows = []
    for r in registry.where("parent is null").select("name", "scorer", "folder", "metric").collect():
        for m in metrics_of(r["scorer"], r["folder"]):
            if not (listed_only and not r["scorer"] and r["metric"] and m.name != r["metric"]):
                rows.append((r["name"], m.name, m.policy, m.length, m.gold, m.unknown_is_wrong))
    return registry.sparkSession.createDataFrame(rows, "task string, metric string, policy string, length string, at int, strict boolean")


def item_credits(candidates: DataFrame, rules_: DataFrame) -> DataFrame:
    """(task, metric, item_id, credit) of each item under each metric of its task.

    candidates: (task, item_id, cand_idx, score, n_tokens, n_chars, has_unk, label). NaN and null
    scores rank last; a label that is no candidate makes an item wrong; tasks without rules are
    left out. Rules are broadcast: a few rows a task. Two aggregations on the item, whatever
    the policies, the first combined before the only shuffle of candidates.
    """
    rows = candidates.join(F.broadcast(rules_), "task")
    length = F.when(F.col("length") == "n_chars", F.col("n_chars")).when(F.col("length") == "n_tokens", F.col("n_tokens"))
    value = ranked(F.when(F.col("length").isNull(), F.col("score")).otherwise(F.col("score") / F.greatest(length, F.lit(1))))
    gold = F.coalesce(F.col("cand_idx") == F.coalesce("at", "label"), F.lit(False))
    keys = ["task", "metric", "policy", "item_id"]
    unknown = F.coalesce(F.col("strict") & F.col("has_unk"), F.lit(False)).cast("int")
    ties = rows.groupBy(*keys, value.alias("s")).agg(F.count("*").alias("n"), F.max(gold.cast("int")).alias("g"), F.min("cand_idx").alias("first"), F.min(F.when(gold, F.col("cand_idx"))).alias("at"), F.max(unknown).alias("u"))
    top = ties.groupBy(*keys).agg(F.max(F.struct("s", "n", "g", "first", "at")).alias("t"), F.max("u").alias("u"))
    return top.select("task", "metric", "item_id", _credit().alias("credit"))


def _credit() -> Column:
    right, alone = F.col("t.g") == 1, F.col("t.n") == 1
    by_policy = F.when(F.col("policy") == "fractional", F.when(right, 1.0 / F.col("t.n"))).when(F.col("policy") == "strict", F.when(right & alone, 1.0)).otherwise(F.when(right & (F.col("t.at") == F.col("t.first")), 1.0))
    return F.when(F.col("u") == 0, F.coalesce(by_policy, F.lit(0.0))).otherwise(0.0)


def task_scores(candidates: DataFrame, registry: DataFrame, listed_only: bool = False) -> DataFrame:
    """(task, metric, items, value): the mean credit of each task's items, all tasks at once."""
    return item_credits(candidates, rules(registry, listed_only)).groupBy("task", "metric").agg(F.count("*").alias("items"), F.avg("credit").alias("value"))


def row_filter(tag: str | None, folder: str | None) -> Column | None:
    """The condition that a process_docs tag stands for: a column, by folder, whose value in lower case with _ for blanks is the function's name after process_. None without a tag; an unknown one is an error."""
    name = _bare(tag)
    if not name:
        return None
    column = next((c for part, c in FILTERED.items() if f"/{part}/" in f"/{(folder or '').strip('/')}/"), None)
    m = re.fullmatch(r"utils\.process_(\w+)", name)
    if column is None or not m:
        raise ValueError(f"no row filter {name!r} is known (task folder {folder!r})")
    return F.replace(F.replace(F.lower(F.col(column)), F.lit(" & "), F.lit("_")), F.lit(" "), F.lit("_")) == m[1]
