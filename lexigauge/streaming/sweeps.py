"""Checkpoint sweeps and event counts as streams. The resumable sweep is the batch engine's; windows over event time are an extension."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.sinks import append_step

SCORES = "task string, revision string, item_id long, correct double"


def score_stream(spark: SparkSession, folder: str, schema: str = SCORES, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.json*")
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).json(folder)


def resumable_counts(scores: DataFrame, out: str, checkpoint: str, keys: tuple[str, ...] = ("task", "revision")) -> None:
    """Counts of each key so far, in parquet under out, from all files not yet read; a batch run again replaces its own part, so counts stay right after a failure.

    Each micro-batch writes its partial counts under its number; totals() sums them.
    """

    def add(batch: DataFrame, number: int) -> None:
        part = batch.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("correct").alias("correct"))
        append_step(part.withColumn("batch", F.lit(number)), out, "batch")

    scores.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def totals(spark: SparkSession, out: str, keys: tuple[str, ...] = ("task", "revision")) -> DataFrame:
    return spark.read.parquet(out).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("correct").alias("correct"))


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", length: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events by window and kind, late ones up to `late` behind. Works on streams and tables alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, user: str = "user_id", time: str = "ts", gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


#: Item scores of a sweep over checkpoints: each item once for each step of a model's revision.
STEP_SCORES = "task string, revision string, step long, item_id long, correct double"
SWEEP = "task string, revision string, n long, correct double, finished array<long>, repeated long, late long"


class SweepState(StatefulProcessor):
    """The progress of one (task, revision), kept by key: counts, the items of each open step, the finished steps.

    A step is finished once it has `size` items; its items are then forgotten. A row for an
    item that its step already has is a repeat: the first one counts. A row for a finished
    step is late and doesn't count. Rows without a step or an item don't count at all. So
    what a key keeps is bounded by its open steps.
    """

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "n long, correct double, repeated long, late long")
        self.open = handle.getMapState("open", "step long, item_id long", "correct double")
        self.filled = handle.getMapState("filled", "step long", "n long")
        self.done = handle.getMapState("done", "step long", "n long")

    def _gathered(self, rows: Iterator[pd.DataFrame]) -> tuple[dict[int, pd.DataFrame], dict[int, int]]:
        """(by step: number of rows and best score of each item, in order of items; by step: all rows) of the rows of a batch, whatever Arrow batches they come in.

        Of a step's items that aren't open yet the first `size` are kept at most, as later ones
        can't count: what is held is bounded by the steps that aren't finished.
        """
        items: dict[int, pd.DataFrame] = {}
        every: dict[int, int] = {}
        for frame in rows:
            frame = frame.dropna(subset=["step", "item_id"])
            found = frame.groupby(["step", "item_id"], sort=True).agg(rows=("item_id", "size"), best=("correct", "max")).reset_index()
            for step, own in found.groupby("step", sort=True):
                step = int(step)
                every[step] = every.get(step, 0) + int(own["rows"].sum())
                if self.done.containsKey((step,)):
                    continue
                own = own[["item_id", "rows", "best"]]
                if step in items:
                    own = pd.concat([items[step], own]).groupby("item_id", sort=True).agg(rows=("rows", "sum"), best=("best", "max")).reset_index()
                # a step has under `size` open items, so it is finished within so many
                items[step] = own.head(2 * self.size)
        return items, every

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        n, correct, repeated, late = self.sums.get() if self.sums.exists() else (0, 0.0, 0, 0)
        # rows of a batch go by step, item and score, however they were dealt
        items, every = self._gathered(rows)
        for step, total in sorted(every.items()):
            if step not in items:
                late += total
                continue
            own = items[step]
            count = self.filled.getValue((step,))[0] if self.filled.containsKey((step,)) else 0
            used = 0
            for item, times, score in zip(own["item_id"].tolist(), own["rows"].tolist(), own["best"].fillna(0.0).tolist(), strict=True):
                if count >= self.size:
                    break
                at = (step, int(item))
                new = not self.open.containsKey(at)
                if new:
                    self.open.updateValue(at, (float(score),))
                    count, n, correct = count + 1, n + 1, correct + float(score)
                # the item that finishes a step leaves its own repeats late
                took = 1 if count >= self.size else int(times)
                repeated += took - new
                used += took
            late += total - used
            if count >= self.size:
                self.done.updateValue((step,), (count,))
                if self.filled.containsKey((step,)):
                    self.filled.removeKey((step,))
                for at in [k for k, _ in self.open.iterator() if k[0] == step]:
                    self.open.removeKey(tuple(at))
            else:
                self.filled.updateValue((step,), (count,))
        self.sums.update((n, correct, repeated, late))
        yield pd.DataFrame({"task": [key[0]], "revision": [key[1]], "n": [n], "correct": [correct], "finished": [sorted(int(s[0]) for s in self.done.keys())], "repeated": [repeated], "late": [late]})

    def close(self) -> None:
        pass


def sweep_states(scores: DataFrame, size: int, out: str, checkpoint: str) -> None:
    """Runs a stream of STEP_SCORES to the end of what has come, with state by (task, revision), and appends each changed key's progress (SWEEP) to parquet under out.

    Stopped and started again with the same checkpoint folder it goes on where it was, in any
    store that Spark knows; a micro-batch that runs twice replaces its own rows. progress()
    reads one row a key. The state is kept by RocksDB on the executors, with changes in the
    checkpoint folder, so a lost executor loses nothing.
    """
    spark = scores.sparkSession
    states = scores.groupBy("task", "revision").transformWithStateInPandas(SweepState(size), outputStructType=SWEEP, outputMode="Update", timeMode="None")

    def keep(batch: DataFrame, number: int) -> None:
        append_step(batch.withColumn("batch", F.lit(number)), out, "batch")

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        states.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def progress(spark: SparkSession, out: str) -> DataFrame:
    """(task, revision, n, correct, finished, repeated, late): the newest row of each key."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in ("task", "revision")]
    newest = F.max_by(F.struct(*rest), "batch").alias("r")
    return rows.groupBy("task", "revision").agg(newest).select("task", "revision", *[f"r.{c}" for c in ("n", "correct", "finished", "repeated", "late")])
