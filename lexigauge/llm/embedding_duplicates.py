"""Embedding near-duplicates by collision-counting projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Vectors that a block of a table should hold, about.
BLOCK = 2048
#: Chance with which a pair at the least cosine may be missed, by tables, by the sweep and by counts each.
MISS = 2e-4
#: One-dimensional projections whose windows are counted, half a window in standard deviations of a pair at the least cosine, and projections after which few pairs are left to count.
PROJECTIONS, HALF_WINDOW, EARLY = 24, 3.75, 10


def together(least: float) -> float:
    """The chance that two vectors at a cosine of `least` lie on one side of a random direction: 1 - angle / pi."""
    return 1 - math.acos(least) / math.pi


def tables_for(rows: int, least: float) -> tuple[int, int]:
    """(bits, tables): halves by which `rows` vectors are split into blocks, and tables so that a pair at `least` shares one but for MISS."""
    bits = max(0, math.ceil(math.log2(max(rows, 1) / BLOCK)))
    return bits, math.ceil(math.log(MISS) / math.log(1 - together(least) ** bits)) if bits else 1


def count_for(least: float, projections: int = PROJECTIONS, half: float = HALF_WINDOW) -> int:
    """The most window collisions that all pairs at `least` but MISS of them have: windows of half standard deviations."""
    p = math.erf(half / math.sqrt(2))
    tail, k = 0.0, 0
    while tail + (now := math.comb(projections, k) * p**k * (1 - p) ** (projections - k)) <= MISS:
        tail, k = tail + now, k + 1
    return k


def _directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((n, dim))


def linked_pairs(x: np.ndarray, least: float, side: np.ndarray | None = None, rows: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at a cosine of `least` or more. x: unit vectors; side: only pairs of which one is on it and one isn't.

    Vectors are taken in the order of the first projection, `rows` at once, each with those
    that its window holds; the other projections' windows are counted for these pairs, and
    what has missed too many to reach the count is given up. What passes is verified.
    """
    p = _directions(x.shape[1], PROJECTIONS, 1) @ x.T
    order = np.argsort(p[0], kind="stable")
    p = np.ascontiguousarray(p[:, order].astype(np.float32))
    # the difference of two projections is normal, with the distance as its standard deviation
    width = np.float32(HALF_WINDOW * math.sqrt(max(2 - 2 * least, 1e-12)))
    stop = np.searchsorted(p[0], p[0] + width, side="right")
    spare = PROJECTIONS - count_for(least)
    for at in range(0, len(x), rows):
        to, end = min(at + rows, len(x)), int(stop[min(at + rows, len(x)) - 1])
        missed = np.zeros((to - at, end - at), np.uint8)
        for k in range(1, EARLY):
            missed += np.abs(p[k, at:to, None] - p[k, None, at:end]) > width
        columns = np.arange(at, end)
        i, j = np.nonzero((missed <= spare) & (columns[None, :] > np.arange(at, to)[:, None]) & (columns[None, :] < stop[at:to, None]))
        missed = missed[i, j]
        i, j = i + at, j + at
        if side is not None:
            ok = side[order[i]] != side[order[j]]
            i, j, missed = i[ok], j[ok], missed[ok]
        for k in range(EARLY, PROJECTIONS):
            missed += np.abs(p[k, i] - p[k, j]) > width
            ok = missed <= spare
            i, j, missed = i[ok], j[ok], missed[ok]
        a, b = order[i], order[j]
        ok = np.einsum("ij,ij->i", x[a], x[b]) >= least
        yield a[ok], b[ok]


def _group(ids: list, x: np.ndarray, copies: np.ndarray, signs: np.ndarray | None, table: int, late: np.ndarray | None, least: float):
    """Links of one block: (links of each vector, a forest of the pairs), of the pairs that have no earlier table in common."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = np.zeros(len(ids), np.int64)
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    forest = []
    for a, b in linked_pairs(x, least, late):
        if table and len(a):
            ok = (signs[a, :table] != signs[b, :table]).all(1)
            a, b = a[ok], b[ok]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if (p := top(i)) != (q := top(j)):
                root[p] = q
                forest.append((ids[i], ids[j], 0))
    return links, forest


def linked_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = 4096) -> DataFrame:
    """(id, n_links, component_id, kept): links are pairs of one label with a cosine of `least` or more, in double precision.

    Equal vectors of a label count once and with their number. The distinct vectors of a
    label are dealt into blocks, by the halves of a few further projections on which they lie,
    in so many tables that a pair at `least` shares a block but for a chance of MISS; more
    vectors take more halves and tables, so blocks don't grow. In a block vectors are sorted
    along the first of many one-dimensional projections; pairs in each other's window there
    are counted on the rest, and those with as many collisions as all pairs at `least` but
    MISS have are verified. A pair counts in its first common table only. A block of more than `tile`
    vectors is dealt out as pairs of tiles. Tasks return counts of links and enough links to
    keep a block's components, not all pairs. A table moves a vector once, as its own bytes.

    Vectors that are null, empty, zero or hold a null or non-finite component link with
    nothing, nor do vectors without a label or of different lengths. Rows with a null id are
    vectors too, each with its own row; ids should be unique otherwise. Repeated vectors link
    with each other. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    common.prepare(spark)
    v = F.col(vector_col)
    good = v.isNotNull() & F.col(label_col).isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    single = vectors.schema[vector_col].dataType.elementType.typeName() == "float"
    kind, number = ("float", np.dtype("<f4")) if single else ("double", np.dtype("<f8"))
    # adding 0 makes -0 and 0 equal
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.when(F.coalesce(good, F.lit(False)), F.transform(v, lambda c: c.cast(kind) + F.lit(0.0).cast(kind))).alias("v"))
    rows = rows.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("v", lambda c: c.cast("string"))), 256)))
    id_kind = rows.schema["id"].dataType.simpleString()
    members = common.cut(rows.select("id", "key"))
    once = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    once = common.cut(once.withColumn("d", F.size("v")))
    sizes = once.groupBy("label", "d").agg(F.count("*").alias("n"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / BLOCK))).cast("int")
    tables = F.when(bits == 0, 1).otherwise(F.ceil(math.log(MISS) / F.log(1 - F.pow(F.lit(together(least)), bits)))).cast("int")
    sizes = common.broadcast_if_small(common.cut(sizes.select("label", "d", bits.alias("bits"), tables.alias("tables"))))

    def deal(batches):
        common.worker_state("embeddings")
        for batch in batches:
            dims, bits, tables = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "bits", "tables"))
            flat, offsets = batch.column("v").flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(dims)])
            cells: list = [None] * batch.num_rows
            for d, b, t in {*zip(dims.tolist(), bits.tolist(), tables.tolist(), strict=True)}:
                own = np.flatnonzero((dims == d) & (bits == b) & (tables == t))
                x = flat[offsets[own][:, None] + np.arange(d)].astype(float)
                signs = (x @ _directions(d, b * t, 2).T > 0).reshape(len(own), t, b)
                cell = signs @ (1 << np.arange(b, dtype=np.int64))
                for i, c in zip(own.tolist(), cell.astype(np.int32).tolist(), strict=True):
                    cells[i] = c
            raw = [flat[a:b].astype(number).tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), batch.column("d"), batch.column("copies"), pa.array(raw, pa.binary()), pa.array(cells, pa.list_(pa.int32()))], names=["id", "label", "d", "copies", "v", "cells"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    label_kind = once.schema["label"].dataType.simpleString()
    dealt = common.cut(once.join(sizes, ["label", "d"]).select("key", "label", "d", "copies", "v", "bits", "tables").mapInArrow(deal, f"id string, label {label_kind}, d int, copies long, v binary, cells array<int>"))
    block = F.xxhash64("label", "d", "table", "cell")
    # blocks by the number alone; vectors follow only once
    big = common.cut(dealt.select("label", "d", F.posexplode("cells").alias("table", "cell")).groupBy(block.alias("block")).agg(F.count("*").alias("n")).where(f"n > {tile}"))
    placed = dealt.select("*", F.posexplode("cells").alias("table", "cell")).withColumn("block", block)
    placed = placed.join(common.broadcast_if_small(big), "block", "left")
    shares = F.ceil(F.coalesce("n", F.lit(1)) / tile).cast("int")
    placed = placed.withColumn("t", F.pmod(F.xxhash64("id"), shares).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), shares - 1)))
    placed = placed.select(F.xxhash64("block", F.least("t", "o"), F.greatest("t", "o")).alias("g"), "d", "table", (F.col("t") > F.col("o")).alias("late"), (F.col("t") == F.col("o")).alias("same"), "id", "v", "copies", "cells")

    def link(batches):
        common.worker_state("embeddings")
        for group in common.runs(batches, "g"):
            if group.num_rows < 2:
                continue
            ids, table = group.column("id").to_pylist(), group.column("table")[0].as_py()
            x = np.frombuffer(b"".join(group.column("v").to_pylist()), number).reshape(len(ids), -1).astype(float)
            cells = np.array(group.column("cells").to_pylist(), np.int32)
            same, late = (np.array(group.column(c).to_pylist(), bool) for c in ("same", "late"))
            links, forest = _group(ids, x, np.array(group.column("copies").to_pylist(), np.int64), cells, table, None if same.all() else late, least)
            own = [(ids[i], None, int(links[i])) for i in np.flatnonzero(links).tolist()]
            if own:
                a, b, c = zip(*forest, *own, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int64())], names=["a", "b", "links"])

    found = common.cut(placed.repartition(n, "g").sortWithinPartitions("g").mapInArrow(link, "a string, b string, links long"))
    # results of distinct vectors first, then of their copies
    number_of = once.select("key", "rep", "copies").join(found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links")), "key", "left")
    pairs = found.where("b is not null").select("a", "b")
    linked = common.cut(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().join(once.select("key", "rep"), "key"))
    # a component's name is its smallest id
    named = pairs.join(linked.select(F.col("key").alias("a"), F.col("rep").alias("x")), "a").join(linked.select(F.col("key").alias("b"), F.col("rep").alias("y")), "b")
    comp = common.components(named, "x", "y").select(F.col("id").alias("rep"), "component")
    result = common.cut(number_of.join(comp, "rep", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    out = common.spread_join(members.where("key is not null"), result, ["key"], "id", common.hot_keys(once.select("key", F.col("copies").alias("n")), ["key"]), "left").select("id", "n_links", "component")
    out = out.unionByName(members.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    return out.select("id", "n_links", F.col("component").cast(id_kind).alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
