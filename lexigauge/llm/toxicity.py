"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .arrays import summed

#: A word's embedding is the sum of its features' rows: the whole word and its first 3 to 9 bytes.
PREFIXES = (3, 4, 5, 6, 7, 8, 9)
#: Rows of the embedding table for each feature.
BUCKETS = 1 << 15
DIM, FILTERS, WIDTHS = 4, 8, (1, 2, 3)
#: Rows of the embedding table; the last is one of zeros.
SIZE = (1 + len(PREFIXES)) * BUCKETS + 1
#: Words in a stretch, over which filters are max-pooled.
STRETCH = 64
#: Labelled texts that one task learns from, unless there are as many tasks as the session's shuffles have; texts up to which they are gone over several times, and how often at most.
TASK_ROWS, SEVERAL, EPOCHS = 2500, 40_000, 8
#: What a labelled text is for: halves that take each other's associations while the model learns, and what only sets thresholds. Scores that thresholds tell apart.
HALVES, ASIDE, STEPS = 2, 2, 4096
#: Sums of real numbers are kept in units of 1 / UNIT, so that they don't depend on their order.
UNIT = 1 << 20


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a slice the bucket of each of its features, and the word's row of text. Lower case; BUCKETS stands for a short word's longer prefixes."""
    low = common.LOWER[data]
    start, end, row = common.words(low, offsets)
    prefix = common.prefix_hash(common.BYTE_VALUES[low])
    out = np.empty((len(start), 1 + len(PREFIXES)), np.uint16)
    for k, n in enumerate((None, *PREFIXES)):
        stop = end if n is None else np.minimum(start + n, end)
        out[:, k] = common.span_hash(prefix, start, stop) % np.uint64(BUCKETS)
        if n is not None:
            out[start + n > end, k] = BUCKETS
    return out, row


@dataclass
class Layout:
    """Words of texts with the padding that keeps filters inside a text, and the stretches of each."""

    words: np.ndarray  # (positions, features)
    first: np.ndarray  # position where each stretch begins
    text: np.ndarray  # text of each stretch
    texts: int
    real: np.ndarray  # whether a position holds a word


def layout(features: np.ndarray, row: np.ndarray, texts: int) -> Layout:
    pad = max(WIDTHS) - 1
    n = np.bincount(row, minlength=texts)
    begin = np.cumsum(n + pad) - (n + pad)
    nothing = SIZE - 1  # a row of zeros
    words = np.full((int((n + pad).sum()), features.shape[1]), nothing, np.int32)
    place = np.arange(len(row)) + row * pad
    real = np.zeros(len(words), bool)
    real[place] = True
    words[place] = np.where(features == BUCKETS, nothing, features + np.arange(features.shape[1], dtype=np.int32) * BUCKETS)
    count = np.maximum(1, -(-n // STRETCH))
    text = np.repeat(np.arange(texts), count)
    within = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return Layout(words, begin[text] + within * STRETCH, text, texts, real)


class Model:
    """Embeddings E, filters W and b of each width, and the last layer over pooled filters.

    Filters pass a rectifier, are max-pooled over each stretch of words, and the mean and the
    most over a text's stretches go to a logistic layer.
    """

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.e = np.zeros((SIZE, DIM), np.float32)
        self.w = [(0.1 * rng.standard_normal((w * DIM, FILTERS))).astype(np.float32) for w in WIDTHS]
        self.b = [np.linspace(0, -2.5, FILTERS).astype(np.float32) for _ in WIDTHS]
        for w in self.w:
            w[0::DIM] += 1.0  # the first dimension begins as a word's association with the label
        n = 2 * FILTERS * len(WIDTHS)
        self.head, self.bias = np.zeros(n), 0.0
        self.mean, self.scale = np.zeros(n), np.ones(n)
        self.constant: float | None = None

    def embed(self, words: np.ndarray) -> np.ndarray:
        out = self.e[words[:, 0]]
        for k in range(1, words.shape[1]):
            out = out + self.e[words[:, k]]
        return out

    def pooled(self, x: Layout, arg: bool = False):
        """Max of each filter over each stretch; with arg also the position of each."""
        emb = self.embed(x.words)
        most, at = [], []
        padded = np.concatenate([emb, np.zeros((max(WIDTHS), DIM), np.float32)])
        for w, kernel, bias in zip(WIDTHS, self.w, self.b, strict=True):
            r = np.zeros((len(emb), FILTERS), emb.dtype)
            for j in range(w):
                r += padded[j : j + len(emb)] @ kernel[j * DIM : (j + 1) * DIM]
            r[~x.real] = 0  # what begins in the padding would reach the next text
            m = np.maximum.reduceat(r, x.first, axis=0)
            if arg:
                stretch = np.cumsum(np.bincount(x.first, minlength=len(emb))) - 1
                where = np.zeros((len(x.first), FILTERS), np.int64)
                p, f = np.nonzero(r == m[stretch])
                where[stretch[p], f] = p
                at.append(where)
            most.append(m + bias)
        return np.concatenate(most, 1), (np.concatenate(at, 1) if arg else None)

    def summary(self, most: np.ndarray, x: Layout) -> np.ndarray:
        relu = np.maximum(most, 0)
        starts = np.searchsorted(x.text, np.arange(x.texts))
        n = np.diff([*starts, len(x.text)])[:, None]
        return np.concatenate([np.add.reduceat(relu, starts, axis=0) / n, np.maximum.reduceat(relu, starts, axis=0)], 1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        texts = len(offsets) - 1
        if self.constant is not None:
            return np.full(texts, self.constant)
        x = layout(*word_features(data, offsets), texts)
        z = (self.summary(self.pooled(x)[0], x) - self.mean) / self.scale @ self.head + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def association(have: np.ndarray, both: np.ndarray, n: int, positives: int) -> np.ndarray:
    """The correlation of a feature's presence in a text with the label; have: texts with it, both: those of label 1 among them, of n texts. 0 if the texts have one label only."""
    p = positives / max(n, 1)
    return (both - have * p) / np.sqrt(np.maximum(have, 1) * p * (1 - p) * n) if 0 < p < 1 else np.zeros(len(have))


def presence(features: np.ndarray, text: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """In how many texts of each group every feature is, by row of the embedding table; group: that of each text, negative for none."""
    out = np.zeros((groups, SIZE), np.int64)
    keep = group[text] >= 0
    features, text = features[keep], text[keep].astype(np.int64)
    for k, column in enumerate(features.T):  # one kind of feature at a time, which bounds memory
        seen = np.sort(text * (BUCKETS + 1) + column)
        seen = seen[np.flatnonzero(np.diff(seen, prepend=-1))]
        bucket, of = seen % (BUCKETS + 1), group[seen // (BUCKETS + 1)]
        out[:, k * BUCKETS : (k + 1) * BUCKETS] = np.bincount(of * (BUCKETS + 1) + bucket, minlength=groups * (BUCKETS + 1)).reshape(groups, -1)[:, :BUCKETS]
    return out


def _slices(texts: list, most: int = 1 << 20):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for part in common.slices(iter([batch]), "text", most):
        yield common.text_buffers(part.column("text"))


def gradients(model: Model, x: Layout, y: np.ndarray, head: np.ndarray, bias: float, decay: float = 1e-3) -> tuple[dict, np.ndarray]:
    """Of the mean logistic loss (and decay / 2 times the square of head): gradients by head, bias and each width's w and b, and by the embedding of each position."""
    most, where = model.pooled(x, arg=True)
    s = model.summary(most, x)
    z = (s - model.mean) / model.scale
    p = 1 / (1 + np.exp(-np.clip(z @ head + bias, -30, 30)))
    d = (p - y) / len(y)
    grads = {"head": z.T @ d + decay * head, "bias": np.array([d.sum()])}
    ds = d[:, None] * (head / model.scale)[None, :]
    half = FILTERS * len(WIDTHS)
    count = np.bincount(x.text, minlength=x.texts)
    top = np.maximum(most, 0) == s[x.text, half:]
    top = top / np.add.reduceat(top, np.searchsorted(x.text, np.arange(x.texts)), axis=0, dtype=float)[x.text]  # equals share
    dm = ((ds[:, :half] / count[:, None])[x.text] + ds[:, half:][x.text] * top) * (most > 0)
    emb = np.concatenate([model.embed(x.words), np.zeros((max(WIDTHS), DIM), np.float32)])
    de = np.zeros((len(emb), DIM))
    for i, w in enumerate(WIDTHS):
        g, pos = dm[:, i * FILTERS : (i + 1) * FILTERS], where[:, i * FILTERS : (i + 1) * FILTERS]
        gw = np.zeros_like(model.w[i], float)
        grads[f"b{i}"] = g.sum(0)
        g = g * x.real[pos]
        for j in range(w):
            gw[j * DIM : (j + 1) * DIM] = np.einsum("sf,sfd->df", g, emb[pos + j])
            kernel = model.w[i][j * DIM : (j + 1) * DIM]
            np.add.at(de, (pos + j).ravel(), (g[:, :, None] * kernel.T[None, :, :]).reshape(-1, DIM))
        grads[f"w{i}"] = gw
    return grads, de


class Learner:
    """One task's training: a model with the embeddings that each half of the texts begins with, and what training adds to both.

    Filters, embeddings and last layer are trained by Adam on the logistic loss, with the
    gradient passing to where each maximum is.
    """

    def __init__(self, model: Model, starts: list[np.ndarray], size: int):
        self.model, self.size, self.steps, self.texts = model, size, 0, 0
        self.tables = [table(s) for s in starts]
        self.learnt, self.moves = np.zeros_like(model.e), np.zeros(SIZE, np.int64)
        self.params = {"head": model.head.copy(), "bias": np.array([model.bias])} | {f"w{i}": w.copy() for i, w in enumerate(model.w)} | {f"b{i}": b.copy() for i, b in enumerate(model.b)}
        self.moment = {k: (np.zeros_like(v, float), np.zeros_like(v, float)) for k, v in self.params.items()}
        model.w, model.b = [self.params[f"w{i}"] for i in range(len(WIDTHS))], [self.params[f"b{i}"] for i in range(len(WIDTHS))]

    def learn(self, features: np.ndarray, rows: np.ndarray, y: np.ndarray, part: np.ndarray, epoch: int) -> None:
        """Steps over the texts of both halves, in batches of about `size` texts of one half."""
        edges = np.searchsorted(rows, np.arange(len(y) + 1))
        for k in range(HALVES):
            own = np.flatnonzero(part == k)
            for batch in np.array_split(own, max(1, round(len(own) / self.size))):
                if len(batch):
                    take = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in batch])
                    x = layout(features[take], np.repeat(np.arange(len(batch)), edges[batch + 1] - edges[batch]), len(batch))
                    self._step(x, y[batch], self.tables[k], 0.85**epoch)

    def _step(self, x: Layout, y: np.ndarray, begin: np.ndarray, fall: float) -> None:
        used, where = np.unique(x.words, return_inverse=True)
        local = Model.__new__(Model)
        local.__dict__ |= self.model.__dict__
        # rows in use only, so that a step doesn't touch the whole table
        local.e = begin[used] + self.learnt[used]
        x.words = where.reshape(x.words.shape)
        grads, de = gradients(local, x, y, self.params["head"], self.params["bias"][0])
        self.steps, self.texts = self.steps + 1, self.texts + len(y)
        for name, g in grads.items():
            m, v = self.moment[name]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            rate = 0.05 if name in ("head", "bias") else 0.005
            self.params[name] -= (rate * fall * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)).astype(self.params[name].dtype)
        moved = np.flatnonzero(de[: len(x.words)].any(1))
        if len(moved):
            change = (-0.02 * de[moved]).astype(np.float32)
            for f in range(x.words.shape[1]):
                np.add.at(self.learnt, used[x.words[moved, f]], change)
            self.learnt[-1] = 0
            self.moves[used[np.unique(x.words[moved])]] += 1

    def cells(self) -> np.ndarray:
        """What the task has learned, as sums to be added up over tasks: embeddings by how often each moved, the rest by texts."""
        rest = np.concatenate([v.ravel() for v in self.params.values()])
        return np.concatenate([np.rint(self.learnt * self.moves[:, None].astype(float) * UNIT).astype(np.int64).ravel(), self.moves, np.rint(rest * float(self.texts) * UNIT).astype(np.int64), [self.texts]])


def table(start: np.ndarray) -> np.ndarray:
    """Embeddings that begin as associations with the label."""
    return np.concatenate([4 * start[:, None], np.zeros((SIZE, DIM - 1))], 1).astype(np.float32)


def with_cells(model: Model, cells: np.ndarray, start: np.ndarray) -> Model:
    """The model with the averages of what tasks have learned, from the sums of their cells, and with associations from all texts that it learned from."""
    learnt, moves, rest, texts = np.split(cells, [SIZE * DIM, SIZE * (DIM + 1), len(cells) - 1])
    model.e = table(start) + (learnt.reshape(SIZE, DIM) / UNIT / np.maximum(moves, 1)[:, None]).astype(np.float32)
    rest, at = rest / UNIT / max(1, int(texts[0])), 0
    arrays = {"head": model.head, "bias": np.zeros(1)} | {f"w{i}": w for i, w in enumerate(model.w)} | {f"b{i}": b for i, b in enumerate(model.b)}
    for name, v in arrays.items():
        arrays[name] = rest[at : at + v.size].reshape(v.shape).astype(v.dtype)
        at += v.size
    model.head, model.bias = arrays["head"], float(arrays["bias"][0])
    model.w, model.b = [arrays[f"w{i}"] for i in range(len(WIDTHS))], [arrays[f"b{i}"] for i in range(len(WIDTHS))]
    return model


def labelled_slices(docs: DataFrame, labels: DataFrame, label_col: str, where, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Slices of all labelled rows' texts.

    Rows are dealt to tasks and ordered by a hash of their id, so that what is learned doesn't
    depend on how the table lies. Texts of a slice are compressed together.
    """
    rows = labels.where(where & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y"))
    n = rows.count()
    tasks = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS)))
    texts = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), F.col(lang_col).cast("string").alias("l"))
    if n <= common.BROADCAST_ROWS:
        got = texts.join(F.broadcast(rows), "k").repartition(tasks, "k")
    else:
        got = texts.repartition(tasks, "k").join(rows.repartition(tasks, "k"), "k")
    got = got.withColumn("h", F.xxhash64(F.lit(29), "k")).sortWithinPartitions("h", "k", "t", "y", "l")
    part = F.when(F.pmod("h", F.lit(5)) == 4, ASIDE).otherwise(F.pmod(F.shiftright("h", 20), F.lit(HALVES)))

    def pack(batches):
        for batch in common.slices(batches, "t", 1 << 19):
            data, offsets = common.text_buffers(batch.column("t"))
            numbers = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int8).tobytes() for c in ("y", "part")]
            yield pa.RecordBatch.from_pylist([{"n": len(data), "text": pa.compress(data.tobytes(), codec="zstd", asbytes=True), "offsets": offsets.astype("<i8").tobytes(), "y": numbers[0], "part": numbers[1], "langs": batch.column("l").to_pylist()}], schema=pa.schema([("n", pa.int64()), *[(c, pa.binary()) for c in ("text", "offsets", "y", "part")], ("langs", pa.list_(pa.string()))]))

    return common.cut(got.select("t", "l", "y", part.cast("int").alias("part")).mapInArrow(pack, "n long, text binary, offsets binary, y binary, part binary, langs array<string>"))


def unpacked(batches, parts: tuple[int, ...]):
    """(text bytes, offsets, labels, parts, languages) of the texts of some parts, slice by slice."""
    for batch in batches:
        for row in batch.to_pylist():
            data, offsets = np.frombuffer(pa.decompress(row["text"], row["n"], codec="zstd", asbytes=True), np.uint8), np.frombuffer(row["offsets"], "<i8")
            y, part = np.frombuffer(row["y"], np.int8), np.frombuffer(row["part"], np.int8)
            keep = np.isin(part, parts)
            if keep.any():
                size = np.diff(offsets)
                yield data[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])]), y[keep].astype(float), part[keep], [x for x, k in zip(row["langs"], keep.tolist(), strict=True) if k]


def fitted(sliced: DataFrame) -> Model:
    """A model that has learned from all texts of both halves; of one class only, it scores the rate of label 1 smoothed by one half.

    The embeddings' first dimension begins as the correlations of words with the label, counted
    over all these texts. For training, each half of the texts takes those of the other half,
    as a text's own words would seem to tell more than they do. Each task trains on its own
    texts, and what tasks learn is averaged.
    """
    spark = sliced.sparkSession
    model = Model()

    def count(batches):
        common.worker_state("toxicity")
        out = np.zeros(2 * HALVES * (SIZE + 1), np.int64)
        for data, offsets, y, part, _ in unpacked(batches, (0, 1)):
            group = part * 2 + y.astype(np.int64)
            out[: 2 * HALVES * SIZE] += presence(*word_features(data, offsets), group, 2 * HALVES).ravel()
            out[2 * HALVES * SIZE :] += np.bincount(group, minlength=2 * HALVES)
        return out

    counts = summed(sliced, count, 2 * HALVES * (SIZE + 1))
    have, texts = counts[: 2 * HALVES * SIZE].reshape(HALVES, 2, SIZE), counts[2 * HALVES * SIZE :].reshape(HALVES, 2)
    total, positives = int(texts.sum()), int(texts[:, 1].sum())
    if positives in (0, total):
        model.constant = (positives + 0.5) / (total + 1)
        return model
    start = lambda h, t: association(h.sum(0), h[1], int(t.sum()), int(t[1]))
    model.bias = float(np.log(positives / (total - positives)))
    starts = spark.sparkContext.broadcast([start(have[1 - k], texts[1 - k]).astype(np.float32) for k in range(HALVES)])
    width = len(model.head)

    def moments(batches):
        common.worker_state("toxicity")
        own, tables = Model(), [table(s) for s in starts.value]
        out = np.zeros(2 * width, np.int64)
        for data, offsets, _, part, _ in unpacked(batches, (0, 1)):
            features, rows = word_features(data, offsets)
            for k in range(HALVES):
                number, keep = np.cumsum(part == k) - 1, part[rows] == k
                if (part == k).any():
                    own.e = tables[k]
                    x = layout(features[keep], number[rows[keep]], int((part == k).sum()))
                    s = own.summary(own.pooled(x)[0], x)
                    out += np.rint(np.concatenate([s.sum(0, dtype=float), (s.astype(float) ** 2).sum(0)]) * UNIT).astype(np.int64)
        return out

    sums = summed(sliced, moments, 2 * width) / UNIT / total
    model.mean, model.scale = sums[:width], np.sqrt(np.maximum(sums[width:] - sums[:width] ** 2, 0)) + 1e-3
    begin = spark.sparkContext.broadcast((model.mean, model.scale, model.bias))
    epochs, size = max(1, min(EPOCHS, SEVERAL // total)), 32 if total < 2000 else 64

    def learn(batches):
        common.worker_state("toxicity")
        own = Model()
        own.mean, own.scale, own.bias = begin.value
        learner = Learner(own, starts.value, size)
        held = list(batches) if epochs > 1 else batches  # few texts, compressed
        for epoch in range(epochs):
            for data, offsets, y, part, _ in unpacked(held, (0, 1)):
                learner.learn(*word_features(data, offsets), y, part, epoch)
        return learner.cells()

    params = width + 1 + sum(w.size for w in model.w) + sum(b.size for b in model.b)
    return with_cells(model, summed(sliced, learn, SIZE * (DIM + 1) + params + 1), start(have.sum(0), texts.sum(0)))


def best_step(counts: np.ndarray) -> float | None:
    """The score from which on the F1 of label 1 is best, from counts of texts by label and step of the score; None with under 5 of either label."""
    if counts.sum(1).min() < 5:
        return None
    hit, taken = (np.cumsum(x[::-1])[::-1] for x in (counts[1], counts.sum(0)))
    f1 = 2 * hit / (taken + counts[1].sum())
    best = np.flatnonzero(f1 == f1.max())  # empty steps below a score change nothing: the middle of them
    run = best[-1] - np.arange(len(best))
    own = best[::-1][best[::-1] == run]
    return float((own[0] + own[-1]) / 2 / STEPS)


def limits_by_language(sliced: DataFrame, model, default: float) -> dict:
    """For each language the score from which on the F1 of label 1 is best over all texts set aside; the default where a language has under 5 of either label."""

    def steps(batches):
        common.worker_state("toxicity")
        for data, offsets, y, _, langs in unpacked(batches, (ASIDE,)):
            step = np.minimum(model.value.score(data, offsets) * STEPS, STEPS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(step), pa.array(y.astype(np.int32))], names=["lang", "step", "y"])

    def best(key, rows):
        counts = np.zeros((2, STEPS), np.int64)
        np.add.at(counts, (rows.column("y").to_numpy(), rows.column("step").to_numpy()), rows.column("n").to_numpy())
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "cut": pa.array([best_step(counts)], pa.float64())})

    found = sliced.mapInArrow(steps, "lang string, step int, y int").where("lang is not null").groupBy("lang", "step", "y").agg(F.count("*").alias("n"))
    return {r["lang"]: r["cut"] for r in found.groupBy("lang").applyInArrow(best, "lang string, cut double").where("cut is not null").collect()} | {None: default}


def thresholds(scores: np.ndarray, labels: np.ndarray, langs: list, default: float) -> dict:
    """For each language the score from which on the F1 of label 1 is best; the default where a language has under 5 of either label."""
    out = {}
    for lang in {x for x in langs if x is not None}:
        own = np.array([x == lang for x in langs])
        s, y = scores[own], labels[own]
        if min(y.sum(), (1 - y).sum()) < 5:
            continue
        order = np.argsort(-s, kind="stable")
        hit = np.cumsum(y[order])
        f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
        k = int(np.argmax(f1))
        below = s[order[k + 1]] if k + 1 < len(s) else 0.0
        out[lang] = float((s[order[k]] + below) / 2)
    return out | {None: default}


def within(ids: list, order: list, sizes: list, bound: int) -> list:
    """The ids, by the order given, whose sizes still fit in what those before them leave of bound."""
    out = []
    for k in np.argsort(order, kind="stable").tolist():
        if sizes[k] <= bound:
            bound -= sizes[k]
            out.append(ids[k])
    return out


def train(docs: DataFrame, labels: DataFrame, label_col: str, where, bound: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None, most_bytes: int = 32 << 20):
    """(texts, labels, languages) of at most about `bound` labelled rows and `most_bytes` of text, chosen by a hash of the id.

    The sample's ids, whose number is bounded, are broadcast; texts aren't shuffled. Its
    texts' sizes come to the driver first. All rows of an id count as one, and a text that
    doesn't fit in the bytes is left out whole.
    """
    rows = labels.where(where & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("__y"))
    sample = common.bounded_sample(rows, id_col, None, bound)
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    got = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), lang.alias("l")).join(F.broadcast(sample), id_col).select(id_col, "t", "__y", "l")
    got = common.cut(got)
    size = got.groupBy(id_col).agg(F.xxhash64(id_col).alias("order"), F.sum(F.octet_length("t")).alias("n")).toPandas()
    small = size["n"].sum() <= most_bytes
    chosen = got if small else got.where(F.col(id_col).isin(within(size[id_col].tolist(), size["order"].tolist(), size["n"].tolist(), most_bytes)))
    rows = chosen.toPandas().sort_values([id_col, "t"], kind="stable")
    common.forget(got)
    return rows["t"].tolist(), rows["__y"].tolist(), [x if isinstance(x, str) else None for x in rows["l"].tolist()]


def score_toxicity(docs: DataFrame, labels: DataFrame, train_where, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> DataFrame:
    """(id, score, predicted, flagged) of each document, over its whole text.

    All labels (id, label) in rows that train_where keeps count: four fifths of the ids train
    the model, the others calibrate a threshold for each language. score is the model's chance of label 1 and depends on the text alone;
    predicted is score >= cut; flagged compares the score with the threshold of the row's
    language (`cut` for a null or rare one).

    A null text is scored as empty. Null labels and labels other than 0 and 1 are left out.
    Without labels of both kinds every score is the smoothed rate of label 1. Repeated rows
    are scored each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    sliced = labelled_slices(docs, labels, label_col, train_where, id_col, text_col, lang_col)
    model = spark.sparkContext.broadcast(fitted(sliced))
    limits = spark.sparkContext.broadcast(limits_by_language(sliced, model, cut))
    common.forget(sliced)

    def run(batches):
        common.worker_state("toxicity")
        for batch in common.slices(batches, "text", 1 << 19):
            s = model.value.score(*common.text_buffers(batch.column("text")))
            limit = np.array([limits.value.get(x, cut) for x in batch.column("lang").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32)), pa.array(s >= limit)], names=["id", "score", "predicted", "flagged"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return rows.mapInArrow(run, f"id {kind}, score double, predicted int, flagged boolean")
