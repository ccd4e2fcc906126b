"""Contiguous shards of near equal bytes, from prefix sums over per-partition totals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common


def byte_shards(rows: DataFrame, order: list[str], size: str, shards: int = 16, rows_per_partition: int = 200_000) -> DataFrame:
    """The columns of rows (which should be few and small), with shard and slot.

    rows are sorted by `order` over range partitions and kept once; one total a partition
    comes to the driver, and its prefix sums let each partition place its own rows. A row
    whose middle byte lies in the k-th of `shards` equal parts of all bytes goes to shard k,
    so each cut is off by half a row at most. slot counts the rows of a shard from 0.

    Sizes are non-negative longs; a null size counts as 0. Rows alike in `order` keep any
    order among themselves. An empty table gives no rows; fewer rows than shards leave
    shards empty.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    common.prepare(rows.sparkSession)
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    sized = rows.withColumn("__size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    placed = common.cut(sized.repartitionByRange(n, *order).sortWithinPartitions(*order))
    totals = {r["p"]: (r["s"], r["c"]) for r in placed.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("__size").alias("s"), F.count("*").alias("c")).collect()}
    first: dict[int, tuple[int, int]] = {}
    seen = total = 0
    for p in sorted(totals):
        first[p] = (total, seen)
        total, seen = total + totals[p][0], seen + totals[p][1]
    schema = T.StructType([*placed.drop("__size").schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("row", T.LongType())])
    names = rows.columns

    def place(batches):
        done, row = first.get(TaskContext.get().partitionId(), (0, 0))
        for batch in batches:
            sizes = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
            before = done + np.cumsum(sizes) - sizes
            # shard = 2 * shards * middle // (2 * total), in whole numbers that can't overflow
            shard = [min(shards - 1, (2 * b + s) * shards // (2 * total)) if total else 0 for b, s in zip(before.tolist(), sizes.tolist(), strict=True)]
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shard, pa.int32()), pa.array(row + np.arange(len(sizes)), pa.int64())], names=[*names, "shard", "row"])
            done, row = done + int(sizes.sum()), row + len(sizes)

    out = placed.mapInArrow(place, schema)
    # a shard is a run of rows: its first row is the least, one value a partition and shard before the shuffle
    starts = out.groupBy("shard").agg(F.min("row").alias("__first"))
    return out.join(F.broadcast(starts), "shard").select(*[F.col(f"`{c}`") for c in names], "shard", (F.col("row") - F.col("__first")).alias("slot"))


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of each document, in order of id; texts aren't shuffled.

    A null text counts as empty; null ids come first.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text_size(F.col(text_col)).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return byte_shards(rows, [id_col, "size", "text_crc32"], "size", shards)
