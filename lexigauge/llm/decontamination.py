"""Benchmark decontamination: a broadcast set of test n-grams against all training windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Text bytes of a benchmark that are broadcast as a whole. Beyond, hits are looked up by joins.
BROADCAST_BYTES = 16_000_000
#: Hashes of windows that are broadcast beyond that, 8 bytes each; of more windows every window of a document is joined.
BROADCAST_HASHES = 4_000_000


class Words:
    """The words of texts, lower-cased (A-Z), with a hash for each, from which windows' hashes follow."""

    def __init__(self, texts: pa.Array):
        data, self.offsets = common.text_buffers(texts)
        self.low = common.LOWER[data]
        self.start, self.end, self.row = common.words(self.low, self.offsets)
        h = common.span_hash(common.prefix_hash(common.BYTE_VALUES[self.low]), self.start, self.end)
        self.prefix = common.prefix_hash(h)
        self.edges = np.searchsorted(self.row, np.arange(len(self.offsets)))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each window of k words inside one text, and the window's hash."""
        if k > len(self.start):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        i = np.flatnonzero(self.row[: len(self.row) - k + 1] == self.row[k - 1 :])
        return i, common.span_hash(self.prefix, i, i + k)

    def said(self, i: int, k: int) -> bytes:
        """The words of a window, joined by a space."""
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.start[i : i + k].tolist(), self.end[i : i + k].tolist(), strict=True))

    def item_windows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, number of words, hash) of the windows of items: n words, or all of an item that has fewer."""
        count = np.diff(self.edges)
        i, h = self.windows(n)
        out = [(i, np.full(len(i), n), h)]
        for r in np.flatnonzero((count > 0) & (count < n)).tolist():
            i = self.edges[r : r + 1]
            out.append((i, count[r : r + 1], common.span_hash(self.prefix, i, i + count[r])))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Matcher:
    """Windows of items sorted by hash, for each length; a hash hit counts once its words are found equal."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.ids = [i for i, _ in items]
        self.words = Words(pa.array([t for _, t in items], pa.string()))
        first, size, h = self.words.item_windows(n)
        self.by_length = []
        for k in np.unique(size).tolist():
            own = np.flatnonzero(size == k)
            own = own[np.argsort(h[own], kind="stable")]
            self.by_length.append((k, h[own], first[own]))

    def hits(self, words: Words) -> tuple[np.ndarray, list[set[str]]]:
        """Whether each word is hit, and the items found in each text."""
        hit = np.zeros(len(words.start), bool)
        items: list[set[str]] = [set() for _ in range(len(words.offsets) - 1)]
        for k, keys, first in self.by_length:
            i, h = words.windows(k)
            lo = np.searchsorted(keys, h, side="left")
            found = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == h)
            for j, at, key in zip(i[found].tolist(), lo[found].tolist(), h[found], strict=True):
                said = words.said(j, k)
                while at < len(keys) and keys[at] == key:
                    if self.words.said(int(first[at]), k) == said:
                        hit[j : j + k] = True
                        items[int(words.row[j])].add(self.ids[int(self.words.row[first[at]])])
                    at += 1
        return hit, items


def _joined_hits(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """(key, key2, hits array<struct<i,k>>, items array<string>) of documents with a window of an item, found by joins.

    docs: (key, key2, text); benchmark: (item, text). Documents' windows whose hash is among
    the items' (a broadcast set, if it is small enough; else all windows) are joined with the
    items' by their words, dealt out so that a common window meets in several tasks.
    """
    spark = docs.sparkSession

    def list_windows(batches):
        common.worker_state("decontamination")
        for batch in common.slices(batches, "text"):
            w, ids = Words(batch.column("text")), batch.column("item").to_pylist()
            i, k, h = w.item_windows(n)
            yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r in w.row[i].tolist()], pa.string()), pa.array(k, pa.int32()), pa.array(h.view(np.int64)), pa.array([w.said(a, b) for a, b in zip(i.tolist(), k.tolist(), strict=True)], pa.binary())], names=["item", "k", "h", "said"])

    windows = common.cut(benchmark.mapInArrow(list_windows, "item string, k int, h long, said binary").distinct())
    lengths = [r["k"] for r in windows.select("k").distinct().collect()]  # n at most
    hashes = windows.select("h").distinct()
    few = hashes.count() <= BROADCAST_HASHES
    shared = spark.sparkContext.broadcast(np.sort(np.array(hashes.toPandas()["h"], np.int64).view(np.uint64))) if few else None

    def scan(batches):
        common.worker_state("decontamination")
        for batch in common.slices(batches, "text"):
            w = Words(batch.column("text"))
            for k in lengths:
                i, h = w.windows(k)
                if shared is not None:
                    keys = shared.value
                    i, h = (x[keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h] for x in (i, h)) if len(keys) else (i[:0], h[:0])
                for at in range(0, len(i), 10_000):
                    j, row = i[at : at + 10_000], pa.array(w.row[i[at : at + 10_000]])
                    within = j - w.edges[w.row[j]]
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(row), batch.column("key2").take(row), pa.array(within, pa.int32()), pa.array(np.full(len(j), k), pa.int32()), pa.array(h[at : at + 10_000].view(np.int64)), pa.array([w.said(x, k) for x in j.tolist()], pa.binary())], names=["key", "key2", "i", "k", "h", "said"])

    # a text's windows once, however many documents have it
    asked = docs.mapInArrow(scan, "key long, key2 int, i int, k int, h long, said binary").distinct()
    asked = asked.withColumn("salt", F.pmod("key", F.lit(common.SALTS)).cast("int"))
    dealt = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(common.SALTS - 1))))
    found = asked.join(dealt, ["h", "k", "said", "salt"])
    return found.groupBy("key", "key2").agg(F.collect_set(F.struct("i", "k")).alias("hits"), F.collect_set("item").alias("found"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_words, n_hit, items array<string>, spans array<struct<start,end>>, kept_text, and the columns in carry) of each document.

    A window is n consecutive words of an item, or all words of a shorter item; a word of a
    document inside any occurrence of a window is hit. Words are compared lower-cased (A-Z).
    spans: byte ranges of runs of hit words, which kept_text leaves out. Null texts have no
    words and a null kept_text; items without words have no window; items with one id count
    as one. Documents with one id stay apart. An empty benchmark hits nothing. A benchmark
    of BROADCAST_BYTES of text at most is broadcast, its windows sorted once a worker; of a
    larger one only hashes are, and hits are joined with the items' windows. Both ways give
    the same rows. An empty table gives no rows; repeated rows are looked at each.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 16)).first()[0] or 0
    small = size <= BROADCAST_BYTES
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))
    if small:
        shared = spark.sparkContext.broadcast(sorted((r["item"], r["text"]) for r in items.where("text is not null").collect()))
    else:
        # equal texts have equal hits
        keys = F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.hash(F.coalesce("text", F.lit(""))).alias("key2")
        hits = common.cut(_joined_hits(rows.select(*keys, "text"), items, n))
        rows = rows.select("*", *keys, F.xxhash64("id").alias("by"))
        rows = common.spread_join(rows, hits, ["key", "key2"], "by", common.hot_keys(common.counted(rows, ["key", "key2"]), ["key", "key2"]), "left").drop("key", "key2", "by")
    carried_ = bool(carry)

    def run(batches):
        matcher = common.worker_state(("decontamination", n, getattr(shared, "_path", None) or id(shared.value)), lambda: Matcher(shared.value, n)) if small else common.worker_state("decontamination")
        for batch in common.slices(batches, "text"):
            data, offsets = common.text_buffers(batch.column("text"))
            count = batch.num_rows
            words = Words(batch.column("text"))
            start, end, row = words.start, words.end, words.row
            if small:
                hit, items = matcher.hits(words)
            else:
                hit, items = np.zeros(len(start), bool), [set(x or ()) for x in batch.column("found").to_pylist()]
                for r, own in enumerate(batch.column("hits").to_pylist()):
                    for x in own or ():
                        hit[words.edges[r] + x["i"] : words.edges[r] + x["i"] + x["k"]] = True
            n_words = np.bincount(row, minlength=count)
            n_hit = np.bincount(row[hit], minlength=count)
            spans: list[list[dict]] = [[] for _ in range(count)]
            texts = batch.column("text")
            if hit.any():
                runs = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                cut = np.zeros(len(hit) + 1, bool)  # a run ends with its row
                cut[1:-1] = row[1:] != row[:-1]
                begin = np.flatnonzero((runs[:-1] == 1) | (hit & cut[:-1]))
                stop = np.flatnonzero((runs[1:] == -1) | (hit & cut[1:]))
                kept = texts.to_pylist()
                for s, e in zip(begin.tolist(), stop.tolist(), strict=True):
                    r = int(row[s])
                    spans[r].append({"start": int(start[s] - offsets[r]), "end": int(end[e] - offsets[r])})
                for r in {int(x) for x in row[begin]}:
                    raw, out, at = data[offsets[r] : offsets[r + 1]].tobytes(), [], 0
                    for x in spans[r]:
                        out.append(raw[at : x["start"]])
                        at = x["end"]
                    kept[r] = b"".join([*out, raw[at:]]).decode()
                texts = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), texts, *([batch.column("carried")] if carried_ else [])],
                names=["id", "n_words", "n_hit", "items", "spans", "kept_text", *["carried"] * carried_],
            )

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    carried = f", carried {rows.schema['carried'].dataType.simpleString()}" if carry else ""
    out = rows.mapInArrow(run, f"id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, kept_text string" + carried)
    return out.select("id", "n_words", "n_hit", "items", "spans", "kept_text", *[F.col("carried")[c].alias(c) for c in carry])
