"""MinHash near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded and verified."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .arrays import Slots

#: Distinct words whose counts may be broadcast, in about 1.4 bytes each; beyond it each text gets its words' counts by joins.
WORDS = 32_000_000
#: Words of one minimal perfect hash.
BUCKET = 1 << 17
#: Words whose counts a task holds before it passes them on.
HELD = 1 << 20
#: Bytes of texts whose shingles a task holds while it compares what a bucket has left.
MEMORY = 32 << 20
#: Rows of the tables of random parameters; a shingle takes a row of each by other bits of its hash.
TABLE_BITS = 13


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, lower-cased, and its row."""
    low = common.LOWER[data]
    start, end, row = common.words(low, offsets)
    return common.span_hash(common.prefix_hash(common.BYTE_VALUES[low]), start, end), row


class Weights:
    """Inverse document frequencies by words' hashes: 1 + ln((1 + documents) / (1 + documents with the word)).

    parts: of each bucket of hashes a minimal perfect hash and the counts by slot. Only words that
    were counted are looked up, so the hash needs no keys. Without parts, counts come with the texts.
    """

    def __init__(self, documents: int, parts: list[tuple] | None):
        self.documents, self.parts = documents, parts

    def __call__(self, h: np.ndarray, row: np.ndarray, own: list[bytes | None] | None = None) -> np.ndarray:
        n = np.zeros(len(h), np.int64)
        if self.parts is None:
            ends = np.searchsorted(row, np.arange(len(own) + 1))
            for r, packed in enumerate(own):
                if packed:
                    known = np.frombuffer(packed, np.uint64).reshape(2, -1)
                    n[ends[r] : ends[r + 1]] = known[1, np.searchsorted(known[0], h[ends[r] : ends[r + 1]])]
        elif len(h):
            word, own_words = pd.factorize(h)  # each word is looked up once
            bucket = buckets(own_words, len(self.parts))
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(len(self.parts) + 1))
            of = np.zeros(len(own_words), np.int64)
            for k, (slots, counts, many, much) in enumerate(self.parts):
                at = order[ends[k] : ends[k + 1]]
                found = counts[slots.slot(own_words[at])].astype(np.int64)
                big = found == 255
                found[big] = much[np.searchsorted(many, own_words[at][big])]
                of[at] = found
            n = of[word]
        return 1 + np.log((1 + self.documents) / (1 + n))


def buckets(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, n): in how many of docs (text) each word is, counted by itself, and the number of documents at a null h, in one pass; counts are summed in each task first."""
    most = HELD

    def run(batches):
        common.worker_state("near_duplicates")
        held, counts, n = np.empty(0, np.uint64), np.empty(0, np.int64), 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(counts)], names=["h", "n"])

        for batch in common.slices(batches, "text"):
            data, offsets = common.text_buffers(batch.column("text"))
            h, row = _word_hashes(data, offsets)
            n += batch.num_rows
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            held, at = np.unique(np.concatenate([held, h[new]]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, np.ones(int(new.sum()), np.int64)]), minlength=len(held)).astype(np.int64)
            if len(held) > most:
                yield rows()
                held, counts = held[:0], counts[:0]
        yield rows()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n], pa.int64())], names=["h", "n"])

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def with_weights(docs: DataFrame) -> tuple[DataFrame, Weights]:
    """(docs (id, text) with own, the weights of all their words by exact counts).

    Counts of WORDS words at most are broadcast: tasks build a minimal perfect hash for each
    bucket of about BUCKET words, with a byte a word by slot (words in 255 documents or more
    are listed), and only those bytes come together. Of more words nothing is broadcast: own
    holds the counts of a text's words, joined by word and collected by text, where words and
    texts that are in very many rows are dealt to several tasks.
    """
    counted = common.cut(word_counts(docs.select("text")))
    documents = counted.where("h is null").agg(F.sum("n")).first()[0] or 0
    counts = counted.where("h is not null")
    n = counts.count()
    if n > WORDS:
        return _with_own(docs, common.cut(counts)), Weights(documents, None)
    size = max(1, -(-n // BUCKET))

    def build(key, table):
        h, own = table.column("h").to_numpy().view(np.uint64), table.column("n").to_numpy()
        slots = Slots(h)
        by_slot = np.empty(len(h), np.uint8)
        by_slot[slots.slot(h)] = np.minimum(own, 255)
        big = np.flatnonzero(own >= 255)
        big = big[np.argsort(h[big])]
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "sizes": pa.array([slots.sizes], pa.list_(pa.int64())), "bits": pa.array([slots.bits.tobytes()], pa.binary()), "counts": pa.array([by_slot.tobytes()], pa.binary()), "many": pa.array([h[big].tobytes()], pa.binary()), "much": pa.array([own[big].astype(np.int64).tobytes()], pa.binary())})

    # the bucket of a hash, as in buckets()
    bucket = F.shiftright(F.shiftrightunsigned("h", 32) * size, 32)
    built = counts.groupBy(bucket.alias("bucket")).applyInArrow(build, "bucket long, sizes array<long>, bits binary, counts binary, many binary, much binary").collect()
    parts = [(Slots(np.empty(0, np.uint64)), np.zeros(1, np.uint8), np.empty(0, np.uint64), np.empty(0, np.int64))] * size
    for r in built:
        parts[r["bucket"]] = (Slots.of(np.frombuffer(r["bits"], np.uint64), r["sizes"]), np.frombuffer(r["counts"], np.uint8), np.frombuffer(r["many"], np.uint64), np.frombuffer(r["much"], np.int64))
    common.forget(counted)
    return docs.withColumn("own", F.lit(None).cast("binary")), Weights(documents, parts)


def _with_own(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """docs with own: a text's distinct words' hashes in order, then their counts."""

    def words(batches):
        common.worker_state("near_duplicates")
        for batch in common.slices(batches, "text"):
            data, offsets = common.text_buffers(batch.column("text"))
            h, row = _word_hashes(data, offsets)
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("text_key").take(pa.array(row[new])), pa.array(h[new].view(np.int64))], names=["text_key", "h"])

    def pack(key, table):
        h, n = table.column("h").to_numpy().view(np.uint64), table.column("n").to_numpy().view(np.uint64)
        order = np.argsort(h)
        return pa.table({"text_key": pa.array([key[0].as_py()], pa.binary()), "own": pa.array([np.concatenate([h[order], n[order]]).tobytes()], pa.binary())})

    docs = docs.withColumn("text_key", F.unhex(F.sha2("text", 256)))
    copies = common.counted(docs.where("text is not null"), ["text_key"])
    asked = docs.where("text is not null").dropDuplicates(["text_key"]).select("text_key", "text").mapInArrow(words, "text_key binary, h long")
    found = common.spread_join(asked, counts, ["h"], "text_key", common.hot_keys(counts, ["h"]))
    own = found.groupBy("text_key").applyInArrow(pack, "text_key binary, own binary")
    out = common.spread_join(docs, own, ["text_key"], "id", common.hot_keys(copies, ["text_key"]), "left").select("id", "text", "own")
    return common.cut(out)


def shingles(data: np.ndarray, offsets: np.ndarray, weights: Weights, k: int, own: list[bytes | None] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row its distinct shingles' hashes, sorted, and their weights.

    A weight is the count in the row times the mean inverse document frequency of the
    shingle's words. A row of fewer than k words, but not none, has them all as one shingle.
    """
    h, row = _word_hashes(data, offsets)
    total = np.concatenate([[0.0], np.cumsum(weights(h, row, own))])
    prefix = common.prefix_hash(h)
    ends = np.searchsorted(row, np.arange(len(offsets)), side="left")
    for r in range(len(offsets) - 1):
        a, b = int(ends[r]), int(ends[r + 1])
        n = min(k, b - a)
        if not n:
            yield np.empty(0, np.uint64), np.empty(0)
            continue
        i = np.arange(a, b - n + 1)
        hashes, first, tf = np.unique(common.span_hash(prefix, i, i + n), return_index=True, return_counts=True)
        yield hashes, tf * (total[i[first] + n] - total[i[first]]) / n


@lru_cache(1)
def _parameters(samples: int) -> tuple[np.ndarray, ...]:
    """r and c from Gamma(2, 1) and beta from U(0, 1) for each table row and sample."""
    rng = np.random.default_rng(7)
    shape = (1 << TABLE_BITS, samples)
    r = rng.gamma(2, 1, shape).astype(np.float32)
    return r, 1 / r, np.log(rng.gamma(2, 1, shape)).astype(np.float32), rng.random(shape, np.float32)


def weighted_samples(hashes: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """Consistent weighted samples: each (shingle, level) drawn with a chance in proportion to its weight, as one hash.

    Two sets agree in a sample with the chance of their weighted Jaccard similarity.
    """
    r, inverse, ln_c, beta = _parameters(samples)
    best = np.full(samples, np.inf, np.float32)
    out = np.zeros(samples, np.uint64)
    mask = np.uint64((1 << TABLE_BITS) - 1)
    for at in range(0, len(hashes), 4096):
        h, w = hashes[at : at + 4096], np.log(weights[at : at + 4096]).astype(np.float32)[:, None]
        i, j, k = (((h >> np.uint64(s)) & mask).astype(np.int64) for s in (0, 20, 40))
        b = beta[k]
        t = np.floor(w * inverse[i] + b)
        ln_a = ln_c[j] - r[i] * (t - b + 1)
        low = ln_a.argmin(axis=0)
        every = np.arange(samples)
        value = ln_a[low, every]
        better = value < best
        best[better] = value[better]
        out[better] = common.mix(h[low] ^ (t[low, every].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))[better]
    return out


def signatures(docs: DataFrame, weights, k: int, bands: int, per_band: int) -> DataFrame:
    """(id, text_key, samples binary, bands array<long>): the key of the exact text, null for a null text; no bands without words."""

    def run(batches):
        common.worker_state("near_duplicates")
        w = weights.value
        scale = common.mix(np.arange(1, per_band + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in common.slices(batches, "text"):
            data, offsets = common.text_buffers(batch.column("text"))
            out, raw = [], []
            for hashes, weight in shingles(data, offsets, w, k, batch.column("own").to_pylist()):
                s = weighted_samples(hashes, weight, bands * per_band) if len(hashes) else np.empty(0, np.uint64)
                raw.append(s.astype(np.uint32).tobytes())
                out.append(common.mix((s.reshape(-1, per_band) * scale).sum(axis=1, dtype=np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(raw, pa.binary()), pa.array(out, pa.list_(pa.int64()))], names=["id", "text_key", "samples", "bands"])

    rows = docs.select("id", "text", "own", F.unhex(F.sha2("text", 256)).alias("text_key"))
    return rows.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, text_key binary, samples binary, bands array<long>")


def similar(a: tuple, b: tuple, least: float) -> bool:
    """Whether the weighted Jaccard similarity of two shingle sets is `least` or more."""
    all_, small = float(a[1].sum()) + float(b[1].sum()), min(float(a[1].sum()), float(b[1].sum()))
    if small < least * (all_ - small) - 1e-9:
        return False
    _, p, q = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][p], b[1][q]).sum())
    return both >= least * (all_ - both) - 1e-9


def least_agreement(samples: int, least: float, miss: float = 2e-4) -> int:
    """The most samples in which all pairs at `least`, but `miss` of them, agree."""
    tail, k = 0.0, 0
    while tail + (now := math.comb(samples, k) * least**k * (1 - least) ** (samples - k)) <= miss:
        tail, k = tail + now, k + 1
    return k


def _verify(pairs: DataFrame, docs: DataFrame, weights, k: int, least: float, share: int) -> DataFrame:
    """(a, b): the pairs (x, y) whose weighted Jaccard similarity is `least` or more.

    Partners x of one y are dealt out, `share` together. A task reads y's text first and then
    one x after another, so it holds two texts' shingles, however many or long they are.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["id"].dataType.simpleString()
    partners = common.cut(common.counted(pairs, ["y"]))
    dealt = common.spread_join(pairs, partners, ["y"], "x", common.hot_keys(partners, ["y"])).withColumn("part", F.pmod(F.xxhash64("x"), F.ceil(F.col("n") / share)).cast("int"))
    asked = common.cut(dealt.select("y", "part", F.col("x").alias("id"), F.lit(1).alias("role")).union(dealt.select("y", "part", F.col("y").alias("id"), F.lit(0)).distinct()))
    rows = docs.select("id", "text", "own").join(common.broadcast_if_small(asked), "id")
    rows = rows.repartition(n, "y", "part").sortWithinPartitions("y", "part", "role")

    def run(batches):
        common.worker_state("near_duplicates")
        w, now, held = weights.value, None, None
        for batch in common.slices(batches, "text"):
            data, offsets = common.text_buffers(batch.column("text"))
            y, part, role, x = (batch.column(c).to_pylist() for c in ("y", "part", "role", "id"))
            found = []
            for i, mine in enumerate(shingles(data, offsets, w, k, batch.column("own").to_pylist())):
                if role[i] == 0:
                    now, held = (y[i], part[i]), mine
                elif (y[i], part[i]) == now and similar(held, mine, least):
                    found.append(i)
            t = batch.column("id").type
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in found], t), pa.array([y[i] for i in found], t)], names=["a", "b"])

    return rows.mapInArrow(run, f"a {kind}, b {kind}")


def _candidates(comp: np.ndarray, same: np.ndarray, late: np.ndarray, samples: np.ndarray, keys: np.ndarray, band: int, enough: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, samples in which they agree) of pairs in different components that agree in `enough`, and share no band before this."""
    left = np.flatnonzero(same | ~late)
    right = left if same.all() else np.flatnonzero(late)
    for at in range(0, len(left), 64):
        i = left[at : at + 64]
        alike = np.zeros((len(i), len(right)), np.uint8 if samples.shape[1] < 256 else np.uint16)
        for c in range(samples.shape[1]):
            alike += samples[i, c][:, None] == samples[right, c][None, :]
        ok = (alike >= enough) & (comp[i][:, None] != comp[right][None, :])
        if right is left:
            ok &= np.arange(len(right))[None, :] > np.arange(at, at + len(i))[:, None]
        p, q = np.nonzero(ok)
        first = (keys[i[p]] == keys[right[q]]).argmax(1) == band if len(p) else np.zeros(0, bool)
        p, q = p[first], q[first]
        yield i[p], right[q], alike[p, q]


def _join_apart(rows: DataFrame, docs: DataFrame, weights, k: int, least: float, enough: int, tile: int) -> DataFrame:
    """(a, b): links between texts of one bucket that are in different components, enough of them to join those.

    rows: (band, key, id, n, component, samples, bands). A bucket of more than `tile` texts is
    dealt out as pairs of tiles. A first pass over samples finds which texts of a task agree
    with another in `enough`; the texts of these alone follow, in a second pass that verifies
    the pairs, those that agree most first, unless links found before join them. A pair counts
    in the first band that it shares. Pairs stay inside the task, which keeps texts packed and
    holds the shingles of MEMORY bytes of them.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = F.ceil(F.col("n") / tile).cast("int")
    rows = rows.withColumn("t", F.pmod(F.xxhash64("id"), tiles).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), tiles - 1)))
    rows = rows.select(F.xxhash64("band", "key", F.least("t", "o"), F.greatest("t", "o")).alias("g"), "band", (F.col("t") > F.col("o")).alias("late"), (F.col("t") == F.col("o")).alias("same"), "id", "component", "samples", "bands")
    kind = rows.schema["id"].dataType.simpleString()

    memory = MEMORY

    def table(group):
        comp = np.array(group.column("component").to_pylist())
        same, late = (np.array(group.column(c).to_pylist(), bool) for c in ("same", "late"))
        s = np.frombuffer(b"".join(group.column("samples").to_pylist()), np.uint32).reshape(len(comp), -1)
        return comp, same, late, s, np.array(group.column("bands").to_pylist(), np.int64), group.column("band")[0].as_py(), enough

    def pick(batches):
        common.worker_state("near_duplicates")
        for group in common.runs(batches, "g"):
            args = table(group)
            used = np.zeros(group.num_rows, bool)
            if not (args[0] == args[0][0]).all():
                for i, j, _ in _candidates(*args):
                    used[i] = used[j] = True
            yield from group.filter(pa.array(used)).to_batches()

    picked = common.cut(rows.repartition(n, "g").sortWithinPartitions("g").mapInArrow(pick, rows.schema))
    if not picked.limit(1).count():
        return docs.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")

    def run(batches):
        common.worker_state("near_duplicates")
        w = weights.value
        for group in common.runs(batches, "g"):
            comp, *rest = table(group)
            found = [np.concatenate(x) for x in zip(*_candidates(comp, *rest), strict=True)]
            order = np.argsort(-found[2].astype(int), kind="stable")
            texts, owns, sets, size = group.column("text"), group.column("own"), {}, 0

            def of(i, texts=texts, owns=owns, sets=sets):
                nonlocal size
                if i not in sets:
                    data, offsets = common.text_buffers(texts.slice(i, 1))
                    size += len(data)
                    if size > memory:
                        sets.clear()
                        size = len(data)
                    sets[i] = next(iter(shingles(data, offsets, w, k, [owns[i].as_py()])))
                return sets[i]

            root: dict = {}

            def top(c, root=root):
                while (up := root.get(c, c)) != c:
                    c = up
                return c

            links = []
            for i, j in zip(found[0][order].tolist(), found[1][order].tolist(), strict=True):
                p, q = top(comp[i]), top(comp[j])
                if p != q:
                    x, y = of(i), of(j)
                    if similar(x, y, least):
                        root[p] = q
                        links.append((i, j))
            if links:
                ids, t = group.column("id").to_pylist(), group.column("id").type
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in links], t), pa.array([ids[j] for _, j in links], t)], names=["a", "b"])

    ids = common.cut(picked.select("id").distinct())
    texts = docs.select("id", "text", "own").join(common.broadcast_if_small(ids), "id", "left_semi")
    return picked.join(texts, "id").repartition(n, "g").sortWithinPartitions("g").mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, k: int = 5, least: float = 0.8, bands: int = 16, per_band: int = 4, id_col: str = "doc_id", text_col: str = "text", tile: int = 512, share: int = 128) -> DataFrame:
    """(id, class_id, kept) of each document: class_id is the smallest id of its class, whose row is kept.

    A class is a component of links: equal texts, and pairs that share a band and whose
    weighted Jaccard similarity over k-word shingles is `least` or more. A pair at 0.8 shares
    a band with a chance of 0.9998 at 16 bands of 4.

    Equal texts count once from the start. In each bucket of a band, every text is compared
    with the bucket's hub, the text that shares most buckets (in a group of edited copies, the
    one closest to all). Texts of a bucket that are in different components even then are
    compared by their samples, in pairs of tiles, and by their shingles where the samples
    agree as often as those of 0.9998 of pairs at `least`; no bucket is too large for that.

    A null text is in no class but its own; texts without words are linked only if equal.
    Ids are whole numbers and should be unique: rows with one id are one document's, of all
    its texts. A row with a null id is in the class of an equal text with an id; without one
    its class is null, it links nothing and is kept. An empty table gives no rows.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    docs, weights = with_weights(docs)
    weights = spark.sparkContext.broadcast(weights)
    signed = common.cut(signatures(docs, weights, k, bands, per_band))
    texts = common.cut(signed.where("text_key is not null").groupBy("text_key").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    # only copies need a join to learn what stands for them
    member = common.spread_join(signed.select("id", "text_key"), texts.where("n > 1").select("text_key", "rep"), ["text_key"], "id", common.hot_keys(texts, ["text_key"]), "left").select("id", F.coalesce("rep", "id").alias("rep"))
    once = signed.join(texts.select(F.col("rep").alias("id"), "text_key"), ["id", "text_key"], "left_semi").dropDuplicates(["id", "text_key"])
    rows = common.cut(once.select("id", F.posexplode("bands").alias("band", "key")))
    sizes = common.cut(rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"))
    hot = common.hot_keys(sizes, ["band", "key"])
    rows = common.cut(common.spread_join(rows, sizes, ["band", "key"], "id", hot).select("band", "key", "id", "n"))
    central = rows.groupBy("id").agg(F.sum("n").alias("c"))
    hubs = common.cut(rows.join(central, "id").groupBy("band", "key").agg(F.max(F.struct("c", "id")).alias("h")).select("band", "key", F.col("h.id").alias("hub")))
    rows = common.cut(common.spread_join(rows, hubs, ["band", "key"], "id", hot))
    pairs = common.cut(rows.where("id <> hub").select(F.col("id").alias("x"), F.col("hub").alias("y")).distinct())
    links = common.cut(_verify(pairs, docs, weights, k, least, share))
    comp = common.components(links)

    placed = rows.where("n > 2").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band", "key", F.lit(True).alias("mixed"))
    placed = common.spread_join(placed, common.cut(mixed), ["band", "key"], "id", hot).drop("mixed").join(once.select("id", "samples", "bands"), "id")
    more = common.cut(_join_apart(placed, docs, weights, k, least, least_agreement(bands * per_band, least), tile))
    if more.limit(1).count():
        comp = common.components(links.unionByName(more))
    comp = comp.select(F.col("id").alias("rep"), "component")
    out = common.spread_join(member, comp, ["rep"], "id", common.hot_keys(texts.select("rep", "n"), ["rep"]), "left")
    return out.select("id", F.coalesce("component", "rep").alias("class_id")).select("id", "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))
