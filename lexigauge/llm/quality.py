"""Quality: a classifier learnt from trusted positives and unlabelled text by non-negative unbiased risk."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Classes of bytes whose shares are features.
CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "beyond": range(128, 256), "space": b" ", "line": b"\n", "stop": b".?;:", "comma": b",", "bang": b"!", "bar": b"|", "mark": b"#$%&*@^~=+<>{}[]\\_/", "quote": b"\"'()-"}
NAMES = [*CLASSES, "bytes", "words", "word_length", "length_spread", "long_words", "distinct_words", "distinct_runs", "twins", "lines", "distinct_lines", "line_spread", "capitals", "empty"]
_CLASS = np.full(256, len(CLASSES), np.uint8)
for _k, _v in enumerate(CLASSES.values()):
    _CLASS[list(_v)] = _k
RUN = 3  # words in a run


def _distinct(row: np.ndarray, h: np.ndarray, texts: int) -> np.ndarray:
    """The share of distinct values in each row; 1 in an empty one."""
    order = np.lexsort((h, row))
    r, v = row[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    n = np.bincount(row, minlength=texts)
    return np.where(n, np.bincount(r[new], minlength=texts) / np.maximum(n, 1), 1.0)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text, over all its bytes, words and lines."""
    texts = len(offsets) - 1
    size = np.diff(offsets)
    row_of = np.repeat(np.arange(texts), size)
    shares = np.bincount(row_of * (len(CLASSES) + 1) + _CLASS[data], minlength=texts * (len(CLASSES) + 1)).reshape(texts, -1)[:, :-1]
    low = common.LOWER[data]
    start, end, row = common.words(low, offsets)
    prefix = common.prefix_hash(common.BYTE_VALUES[low])
    h = common.span_hash(prefix, start, end)
    n = np.bincount(row, minlength=texts)
    per = np.maximum(n, 1)
    length = (end - start).astype(float)
    mean = np.bincount(row, weights=length, minlength=texts) / per
    spread = np.sqrt(np.maximum(np.bincount(row, weights=length**2, minlength=texts) / per - mean**2, 0))
    long_ = np.bincount(row, weights=length > 20, minlength=texts) / per
    twins = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=texts) / per if len(h) else np.zeros(texts)
    capital = np.bincount(row, weights=(data[start] >= 65) & (data[start] <= 90), minlength=texts) / per
    if len(h) >= RUN:
        p = common.prefix_hash(h)
        at = np.flatnonzero(row[: len(row) - RUN + 1] == row[RUN - 1 :])
        runs = _distinct(row[at], common.span_hash(p, at, at + RUN), texts)
    else:
        runs = np.ones(texts)
    edge = np.zeros(len(data) + 1, bool)
    edge[1:] = data == 10
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    a, b = cuts[:-1], cuts[1:]
    keep = b - a > 1
    a, b = a[keep], b[keep]
    line_row = np.searchsorted(offsets, a, side="right") - 1
    body = b - (data[b - 1] == 10) if len(b) else b  # without the line's end
    line_h = common.span_hash(prefix, a, body)
    lines = np.bincount(line_row, minlength=texts)
    line_length = np.log1p((b - a).astype(float))
    line_mean = np.bincount(line_row, weights=line_length, minlength=texts) / np.maximum(lines, 1)
    line_spread = np.sqrt(np.maximum(np.bincount(line_row, weights=line_length**2, minlength=texts) / np.maximum(lines, 1) - line_mean**2, 0))
    own = [np.log1p(size), np.log1p(n), mean, spread, long_, _distinct(row, h, texts), runs, twins, np.log1p(lines), _distinct(line_row, line_h, texts), line_spread, capital, n == 0]
    return np.concatenate([np.sqrt(shares / np.maximum(size, 1)[:, None]), np.stack(own, 1).astype(float)], 1)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled, from scores of held-out rows of both.

    At any threshold the unlabelled hold at least the positives' share of their own, so the
    least ratio of the two shares bounds the prior; the threshold is the one at which the
    ratio with its confidence bound is least (best bin estimation).
    """
    p, u = np.sort(positive)[::-1], np.sort(unlabelled)[::-1]
    share = np.arange(1, len(p) + 1) / len(p)
    of_u = np.searchsorted(-u, -p, side="right") / len(u)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(u)) + np.sqrt(np.log(4 / delta) / 2 / len(p))
    k = int(np.argmin((of_u + slack) / share))
    return float(np.clip(of_u[k] / share[k], 0.01, 0.99))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: list
    prior: float
    constant: float | None = None

    def logit(self, x: np.ndarray) -> np.ndarray:
        (w, b), (v, c) = self.layers
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w + b) @ v + c

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def risk_gradients(layers: list, p: np.ndarray, u: np.ndarray, prior: float | None, decay: float = 1e-4) -> list:
    """Gradients of the risk by each layer, plus decay times the weights.

    With a prior: the non-negative unbiased risk; where its part of the negatives is below 0,
    the step goes back up that part alone. Without: the loss of positives against unlabelled.
    """
    x, n, m = np.concatenate([p, u]), len(p), len(u)
    w, c, v, e = layers
    h = np.tanh(x @ w + c)
    z = np.clip(h @ v + e[0], -30, 30)
    s = 1 / (1 + np.exp(-z))
    g = np.empty(len(z))
    if prior is None:
        g[:n], g[n:] = (s[:n] - 1) / n, s[n:] / m
    else:
        soft = np.logaddexp(0, z)  # the loss of calling z negative
        negative = soft[n:].mean() - prior * soft[:n].mean()
        if negative >= 0:
            g[:n], g[n:] = (prior * (s[:n] - 1) - prior * s[:n]) / n, s[n:] / m
        else:  # the risk of negatives can't be below 0: step back from where it is
            g[:n], g[n:] = prior * s[:n] / n, -s[n:] / m
    dh = g[:, None] * v[None, :] * (1 - h * h)
    return [x.T @ dh + decay * w, dh.sum(0), h.T @ g + decay * v, np.array([g.sum()])]


def _descend(p: np.ndarray, u: np.ndarray, prior: float | None, epochs: int, seed: int, hidden: int = 24):
    """Layers of a small network. With a prior: non-negative unbiased risk; without: positives against unlabelled."""
    rng = np.random.default_rng(seed)
    d = p.shape[1]
    layers = [rng.standard_normal((d, hidden)) / np.sqrt(d), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in layers]
    size, step = 512, 0
    for epoch in range(epochs):
        order_p, order_u = rng.permutation(len(p)), rng.permutation(len(u))
        batches = max(1, -(-max(len(p), len(u)) // size))
        for k in range(batches):
            a, b = p[order_p[k * len(p) // batches : max((k + 1) * len(p) // batches, k * len(p) // batches + 1)]], u[order_u[k * len(u) // batches : max((k + 1) * len(u) // batches, k * len(u) // batches + 1)]]
            grads = risk_gradients(layers, a, b, prior)
            step += 1
            for q, grad, (m1, m2) in zip(layers, grads, moments, strict=True):
                m1 += 0.1 * (grad - m1)
                m2 += 0.01 * (grad * grad - m2)
                q -= 0.01 * 0.97**epoch * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return [(layers[0], layers[1]), (layers[2], layers[3])]


def fit(positive: np.ndarray, unlabelled: np.ndarray, epochs: int = 60, seed: int = 3) -> Model:
    """A model from features of trusted positives and of unlabelled texts; without either it scores 1.

    A first network tells positives from unlabelled on half of each; the prior is estimated
    on the other half. The model then minimises the non-negative unbiased risk at that prior.
    """
    both = np.concatenate([positive, unlabelled])
    mean, scale = (both.mean(0), both.std(0) + 1e-3) if len(both) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    if len(positive) < 2 or len(unlabelled) < 2:
        return Model(mean, scale, [], 1.0, 1.0)
    norm = lambda x: np.clip((x - mean) / scale, -8, 8)
    p, u = norm(positive), norm(unlabelled)
    rng = np.random.default_rng(seed)
    p, u = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
    first = Model(np.zeros_like(mean), np.ones_like(scale), _descend(p[::2], u[::2], None, max(10, epochs // 2), seed), 0)
    prior = class_prior(first.logit(p[1::2]), first.logit(u[1::2]))
    return Model(mean, scale, _descend(p, u, prior, epochs, seed), prior)


def _featured(rows: DataFrame) -> DataFrame:
    """(kind, x) of rows (kind, text)."""

    def run(batches):
        common.worker_state("quality")
        for batch in common.slices(batches, "text"):
            x = features(*common.text_buffers(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(list(x), pa.list_(pa.float64()))], names=["kind", "x"])

    return rows.select("kind", "text").mapInArrow(run, "kind int, x array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, train_where, positives: int = 6000, unlabelled: int = 10000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of label 1.

    Texts of docs with label 1 are trusted positives, at most about `positives` of those that
    train_where keeps (a condition on the id column); label 0 is never used. As many as
    `unlabelled` texts of docs that train_where keeps stand for web text. Samples go by a
    hash of the id; only their features come to the driver.
    """
    common.prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    trusted = labels.where(train_where & (F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(id_col)
    trusted = common.bounded_sample(trusted, id_col, None, positives).select(id_col).distinct()
    web = common.bounded_sample(docs.where(train_where & F.col(id_col).isNotNull()).select(id_col), id_col, None, unlabelled).select(id_col).distinct()
    ids = F.broadcast(trusted.select(id_col, F.lit(1).alias("kind")).unionByName(web.select(id_col, F.lit(0).alias("kind"))))
    got = _featured(docs.select(id_col, text).join(ids, id_col)).toPandas()
    x, kind = np.array(got["x"].tolist()).reshape(-1, len(NAMES)), got["kind"].to_numpy()
    order = np.lexsort((*x.T, kind))  # the same model however rows were dealt out
    x, kind = x[order], kind[order]
    return fit(x[kind == 1], x[kind == 0])


def score_quality(docs: DataFrame, model: Model, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of each document, over its whole text.

    score is the model's chance of label 1; predicted is score >= cut. A null text is scored
    as empty. A model without positives scores 1, so that nothing is rejected unseen.
    Repeated rows are scored each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        common.worker_state("quality")
        for batch in common.slices(batches, "text"):
            s = shared.value.score(features(*common.text_buffers(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32))], names=["id", "score", "predicted"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int")


def keep_quality(docs: DataFrame, model: Model, cut: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is cut or more; nothing is shuffled."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        common.worker_state("quality")
        for batch in common.slices(batches, text_col):
            s = shared.value.score(features(*common.text_buffers(batch.column(text_col))))
            yield batch.filter(pa.array(s >= cut))

    return docs.mapInArrow(run, docs.schema)
