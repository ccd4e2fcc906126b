"""Language identification by unigram pieces, with all segmentations of a text summed."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words whose scores a worker keeps, and the bytes from which on a word isn't kept and is summed by itself, position by position.
CACHE, ALONE = 1_000_000, 256
#: Bytes that words are made of: letters, and all of other scripts.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def vocabulary(path: str) -> list[bytes]:
    """The byte strings of a public vocabulary file: .tiktoken ranks, or .json or .model pieces, lower-cased, and all single bytes; spaces before a word's first piece are left out, as are pieces with other bytes than those of words, which no word can hold."""
    import base64
    import json

    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            raw = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    elif path.endswith(".json"):
        from .token_counts import byte_symbols

        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        with open(path, encoding="utf-8") as f:
            raw = [bytes(byte_of[c] for c in t) for t in json.load(f)["model"]["vocab"] if all(c in byte_of for c in t)]
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        raw = [model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = {common.LOWER[np.frombuffer(x, np.uint8)].tobytes() for r in raw if (x := r.lstrip(b" ")) and _LETTER[np.frombuffer(x, np.uint8)].all()}
    return sorted(pieces | {bytes([b]) for b in range(256)}, key=lambda x: (len(x), x))


class Pieces:
    """Looks up pieces by hash, in a table for each length."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.tables = pieces, {}
        for n in sorted({len(p) for p in pieces}):
            own = [i for i, p in enumerate(pieces) if len(p) == n]
            data = np.frombuffer(b"".join(pieces[i] for i in own), np.uint8)
            at = np.arange(0, len(data), n)
            h = common.span_hash(common.prefix_hash(common.BYTE_VALUES[data]), at, at + n)
            order = np.argsort(h)
            self.tables[n] = h[order], np.array(own)[order]

    def find(self, n: int, h: np.ndarray) -> np.ndarray:
        """The piece of each hash among those of n bytes; -1 if there is none."""
        keys, which = self.tables[n]
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        return np.where(keys[at] == h, which[at], -1)


def lattice(words: list[bytes], pieces: Pieces) -> tuple[np.ndarray, list[list[tuple[int, np.ndarray, np.ndarray]]]]:
    """Lengths of words, and for each end position the pieces that end there: (length, words, pieces)."""
    size = np.array([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    begin = np.cumsum(size) - size
    prefix = common.prefix_hash(common.BYTE_VALUES[data])
    out: list[list] = [[] for _ in range(int(size.max(initial=0)) + 1)]
    for end in range(1, len(out)):
        for n in pieces.tables:
            if n > end:
                break
            own = np.flatnonzero(size >= end)
            start = begin[own] + end - n
            found = pieces.find(n, common.span_hash(prefix, start, start + n))
            hit = found >= 0
            if hit.any():
                out[end].append((n, own[hit], found[hit]))
    return size, out


def forward(size: np.ndarray, steps: list, p: np.ndarray) -> list[np.ndarray]:
    """Log chances of each word's first bytes, by position, all segmentations summed. p: log chances (pieces, languages)."""
    alpha = [np.zeros((len(size), p.shape[1]))] + [np.full((len(size), p.shape[1]), -np.inf) for _ in steps[1:]]
    for end, step in enumerate(steps):
        for n, own, piece in step:
            alpha[end][own] = np.logaddexp(alpha[end][own], alpha[end - n][own] + p[piece])
    return alpha


def edges(word: bytes, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of all pieces in one word, in order of their ends."""
    prefix = common.prefix_hash(common.BYTE_VALUES[np.frombuffer(word, np.uint8)])
    found = []
    for n in pieces.tables:
        if n > len(word):
            break
        start = np.arange(len(word) - n + 1)
        piece = pieces.find(n, common.span_hash(prefix, start, start + n))
        hit = np.flatnonzero(piece >= 0)
        found.append((hit, hit + n, piece[hit]))
    start, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(end, kind="stable")
    return start[order], end[order], piece[order]


def along(start: np.ndarray, end: np.ndarray, p: np.ndarray) -> np.ndarray:
    """As forward, for one word from its edges, in order of their ends, with their log chances p (edges, languages): (positions, languages)."""
    size = int(end[-1])
    out = np.full((size + 1, p.shape[1]), -np.inf)
    out[0] = 0
    cuts = np.searchsorted(end, np.arange(1, size + 2)).tolist()
    for at, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), 1):
        out[at] = np.logaddexp.reduce(out[start[a:b]] + p[a:b], axis=0)
    return out


@dataclass
class Model:
    langs: list[str]
    pieces: list[bytes]
    p: np.ndarray  # (pieces, languages)
    prior: np.ndarray
    known: dict = field(default_factory=dict)

    def __post_init__(self):
        self.table = Pieces(self.pieces)
        self.log = np.log(np.maximum(self.p, 1e-300))

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """Log chance of each word in each language."""
        out = np.zeros((len(words), len(self.langs)))
        short = [k for k, w in enumerate(words) if len(w) < ALONE]
        # words of like length together, so that few wait for the longest
        for own in (k for k in (np.array([i for i in short if lo <= len(words[i]) < hi], int) for lo, hi in ((0, 16), (16, 64), (64, ALONE))) if len(k)):
            size, steps = lattice([words[i] for i in own], self.table)
            alpha = forward(size, steps, self.log)
            out[own] = np.stack(alpha)[size, np.arange(len(size))]
        for k, w in enumerate(words):
            if len(w) >= ALONE:
                start, end, piece = edges(w, self.table)
                out[k] = along(start, end, self.log[piece])[-1]
        return out

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        """The chance of each language for texts given as words."""
        new = list({w for t in texts for w in t}.difference(self.known))
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list({w for t in texts for w in t})
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.known.update(zip(part, self.word_scores(part).astype(np.float32), strict=True))
        out = np.tile(np.log(self.prior), (len(texts), 1))
        for k, t in enumerate(texts):
            if t:
                out[k] += np.array(list(map(self.known.__getitem__, t))).sum(0, dtype=float)
        for w in (w for w in new if len(w) >= ALONE):
            del self.known[w]
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)


def fit(counts: dict[str, dict[bytes, int]], pieces: list[bytes], rounds: int = 4, smooth: float = 0.1) -> Model:
    """Chances of pieces in each language from its words' counts, by expectation-maximisation.

    Chances begin equal; in each round the expected uses of each piece over all segmentations
    of all words, plus `smooth`, give the next. A language's prior is its share of words
    smoothed by one.
    """
    table = Pieces(pieces)
    p = []
    for c in counts.values():
        now = np.full(len(pieces), 1 / len(pieces))
        grids = []
        for lo, hi in ((0, 16), (16, 64), (64, ALONE)):
            own = [w for w in c if lo <= len(w) < hi]
            grids += [(*lattice(part, table), np.array([c[w] for w in part], float)) for part in (own[i : i + 20_000] for i in range(0, len(own), 20_000))]
        long_ = [w for w in c if len(w) >= ALONE]
        for _ in range(rounds):
            log, uses = np.log(now), np.full(len(pieces), smooth)
            for size, steps, n in grids:
                alpha = [a[:, 0] for a in forward(size, steps, log[:, None])]
                total = np.stack(alpha)[size, np.arange(len(size))]
                beta = [np.full(len(size), -np.inf) for _ in alpha]
                for end in range(len(alpha) - 1, -1, -1):
                    beta[end][size == end] = 0
                    for k, own, piece in steps[end]:
                        beta[end - k][own] = np.logaddexp(beta[end - k][own], beta[end][own] + log[piece])
                for end, step in enumerate(steps):
                    for k, own, piece in step:
                        uses += np.bincount(piece, weights=n[own] * np.exp(alpha[end - k][own] + log[piece] + beta[end][own] - total[own]), minlength=len(pieces))
            for w in long_:
                start, end, piece = edges(w, table)
                ahead = along(start, end, log[piece][:, None])[:, 0]
                # the same backwards: edges in the order of their starts, from the word's end
                back = np.argsort(len(w) - start, kind="stable")
                behind = along(len(w) - end[back], len(w) - start[back], log[piece[back]][:, None])[::-1, 0]
                uses += np.bincount(piece, weights=c[w] * np.exp(ahead[start] + log[piece] + behind[end] - ahead[-1]), minlength=len(pieces))
            now = uses / uses.sum()
        p.append(now)
    n = np.array([sum(c.values()) + 1.0 for c in counts.values()])
    return Model(list(counts), pieces, np.stack(p, 1) if p else np.empty((len(pieces), 0)), n / n.sum() if len(n) else n)


def text_words(data: np.ndarray, offsets: np.ndarray) -> list[list[bytes]]:
    """The words of each row: runs of letters and bytes from 128 on."""
    clean = np.where(_LETTER[data], common.LOWER[data], 32).astype(np.uint8).tobytes()
    return [clean[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def identify(docs: DataFrame, train_where, path: str, bound: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang_pred, score) of each document, over its whole text.

    Rows that train_where keeps, with a text and a language, train the model: about `bound`
    of each language at most, chosen by a hash of the id; only their words' counts come to the
    driver. Words are whole runs of letters and other scripts' bytes, of any length. score is the chance of lang_pred
    given the text, by pieces of the vocabulary at path, summed over all segmentations of its
    words. Texts that are null or have no letter are `und` with score 0, as are all if there
    is no language to learn. Ties go to the language first in order. Repeated rows are scored
    each. An empty table gives no rows.
    """
    import unicodedata

    spark = docs.sparkSession
    common.prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    usable = rows.where(train_where & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("id").isNotNull())
    sample = common.bounded_sample(usable.select("id", "lang"), "id", "lang", bound)
    chosen = usable.join(F.broadcast(sample.select("id").distinct()), "id").select("lang", "text")

    def count(batches):
        common.worker_state("language")
        for batch in common.slices(batches, "text"):
            own: dict[tuple[str, bytes], int] = {}
            for lang, words in zip(batch.column("lang").to_pylist(), text_words(*common.text_buffers(batch.column("text"))), strict=True):
                for w in words:
                    own[lang, w] = own.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.string()), pa.array([w for _, w in own], pa.binary()), pa.array(list(own.values()), pa.int64())], names=["lang", "word", "n"])

    got = chosen.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    got = got.assign(word=got["word"].map(bytes)).sort_values(["lang", "word"])
    counts = {lang: dict(zip(own["word"], own["n"].astype(int), strict=True)) for lang, own in got.groupby("lang")}
    fitted = fit(counts, vocabulary(path)) if counts else None
    shared = spark.sparkContext.broadcast((fitted.langs, fitted.pieces, fitted.p.astype(np.float32), fitted.prior) if fitted else None)

    def run(batches):
        model = _model(shared)
        for batch in common.slices(batches, "text", 2 << 20):
            data, offsets = common.text_buffers(batch.column("text"))
            words = text_words(data, offsets)
            # bytes from 128 on may be no letters, where a text has none of ASCII
            for k in [k for k, t in enumerate(words) if t]:
                if all(w[0] >= 128 for w in words[k]):
                    text = batch.column("text")[k].as_py()
                    if not any(unicodedata.category(c)[0] == "L" for c in text):
                        words[k] = []
            if model is None:
                pred, score = ["und"] * len(words), np.zeros(len(words))
            else:
                chance = model.score(words)
                best = chance.argmax(1)
                pred = [model.langs[b] if t else "und" for b, t in zip(best.tolist(), words, strict=True)]
                score = np.where([bool(t) for t in words], chance.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    return rows.select("id", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def _model(shared) -> Model | None:
    """The model of a broadcast, with its cache of words, once a worker."""
    if shared.value is None:
        return None

    def make():
        langs, pieces, p, prior = shared.value
        return Model(langs, pieces, p.astype(float), prior)

    return common.worker_state(("language", shared._path if hasattr(shared, "_path") else id(shared.value)), make)
