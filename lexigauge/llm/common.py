"""What the operators share: Arrow slices, rolling hashes, checkpoints, samples, components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


#: Bytes of an Arrow batch between Spark and Python. Texts are long, so the default of 10,000 rows or 64 MB holds too much.
BATCH = "4m"


def prepare(spark: SparkSession) -> None:
    """Sets a checkpoint folder where none is set, bounds the session's Arrow batches, and lets local Python workers import this package.

    The folder is that of spark.checkpoint.dir. Without that setting a temporary one is made
    on a local master only: executors elsewhere would not share it.
    """
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    paths = sc.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(":"):
        sc.environment["PYTHONPATH"] = f"{ROOT}:{paths}" if paths else ROOT


_held: dict = {}


def worker_state(key, make=None):
    """What a Python worker keeps between tasks: one operator's value, made when first asked for. Another operator's task drops it, so that caches don't add up."""
    if key not in _held:
        _held.clear()
        _held[key] = make() if make else None
    return _held[key]


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that cut has returned and that nothing reads any more."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of ids that may be broadcast, about 32 MB; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(ids: DataFrame) -> DataFrame:
    """ids, a table of a few numbers a row that is cheap to count, with a hint to broadcast it if it has BROADCAST_ROWS at most."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


#: Rows of one key from which on a join spreads them over SALTS tasks.
HOT_ROWS, SALTS = 1000, 16


def hot_keys(counted: DataFrame, keys: list[str], n: str = "n") -> DataFrame | None:
    """The keys of HOT_ROWS rows or more in a table (keys, n), as spread_join takes them; None if there are none."""
    hot = cut(counted.where(F.col(n) >= HOT_ROWS).select(*keys, F.lit(True).alias("__hot")))
    return broadcast_if_small(hot) if hot.limit(1).count() else None


def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def spread_join(rows: DataFrame, one: DataFrame, keys: list[str], by: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined with `one`, which has a row for each of the keys, where few keys may have very many rows.

    Rows of hot keys (see hot_keys) are dealt out by a hash of the column `by`, and their row
    of `one` is copied to each share.
    """
    if hot is None:
        return rows.join(one, keys, how)
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, keys, "left").withColumn("__salt", salt).drop("__hot")
    right = one.join(hot, keys, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, modulus: int):
    """crc32 of the id as text, modulo modulus: the rule that separates held-out rows. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_sample(df: DataFrame, id_col: str, stratum: str | None, bound: int) -> DataFrame:
    """About bound rows at most of each stratum (or of all rows), chosen by a hash of the id; all rows of a smaller one."""
    draw = F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(1 << 30))
    if stratum is None:
        return df.where(draw < min(1.0, bound / max(df.count(), 1)) * (1 << 30))
    rates = df.groupBy(F.col(stratum).alias("__s")).agg(F.least(F.lit(1.0), bound / F.count("*")).alias("__rate"))
    rows = df.join(broadcast_if_small(cut(rates)), F.col(stratum).eqNullSafe(F.col("__s")))
    return rows.where(draw < F.col("__rate") * (1 << 30)).select(*df.columns)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about most text bytes, so that working memory doesn't follow the batch size."""
    for batch in batches:
        _, offsets = text_buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows with one key, which sorted batches hold next to each other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and k[a] != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = k[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_rng = np.random.default_rng(20240229)
#: A random odd value a byte, and the base of the rolling hash with its inverse modulo 2**64.
BYTE_VALUES = _rng.integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(4)
def _powers(base: int, log_n: int) -> np.ndarray:
    out = np.ones(1 << log_n, np.uint64)
    for k in range(log_n):
        out[1 << k : 2 << k] = out[: 1 << k] * np.uint64(pow(base, 1 << k, 1 << 64))
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    log_n = max(16, int(n).bit_length())
    return _powers(BASE, log_n), _powers(INVERSE, log_n)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i], times the inverse base to the i, the hash of values[i:j]."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


#: Bytes of words: digits, letters, and all of other scripts. Upper case stands for lower case.
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (lower-cased A-Z, digits and bytes from 128 on, or other bytes), and the row of each; data: lower-cased."""
    inside = word_bytes[data].view(np.int8)
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets[(offsets > 0) & (offsets < len(data))]] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    keep = inside[start].astype(bool) if len(data) else np.zeros(0, bool)
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that edges reach, for each id in an edge.

    Each round gives every id the smallest label around it and then that label's own, so
    rounds grow with the logarithm of a component's diameter. Labels are aggregated before
    they are shuffled; ids with very many edges and labels with very many ids are dealt to
    several tasks; nothing but the number of changes comes to the driver.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = cut(both.union(both.select("y", "x")).distinct())
    hubs = hot_keys(counted(both, ["y"]), ["y"])
    label = cut(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("l")))
    while True:
        around = spread_join(both, label.select(F.col("x").alias("y"), "l"), ["y"], "x", hubs)
        near = around.groupBy("x").agg(F.min("l").alias("m"))
        low = label.join(near, "x", "left").select("x", F.col("l").alias("was"), F.least("l", F.coalesce("m", "l")).alias("l"))
        # what a root's members have found is the root's too
        root = low.groupBy(F.col("was").alias("x")).agg(F.min("l").alias("r"))
        low = cut(low.join(root, "x", "left").select("x", "was", F.least("l", F.coalesce("r", "l")).alias("l")))
        jump = low.select(F.col("x").alias("l"), F.col("l").alias("ll")).where("ll < l")
        new = cut(spread_join(low, jump, ["l"], "x", hot_keys(counted(low, ["l"]), ["l"]), "left").select("x", "was", F.least("l", F.coalesce("ll", "l")).alias("l")))
        forget(low)
        if new.where("was <> l").limit(1).count() == 0:
            return new.select(F.col("x").alias("id"), F.col("l").alias("component"))
        label = new.select("x", "l")
