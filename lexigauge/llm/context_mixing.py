"""Language-model scores: hashed-context bit predictors mixed by gated weights, over the words of all training texts."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from .arrays import CHUNK, PART, Texts, array_rows, byte_set, cells_of, distinct_words, packed, same_bytes, summed, tree_sum

WORD = byte_set(32, *range(9, 14))
#: How a text's end and a word's end are spelled; neither lies in a word.
END, STOP = b"\n", 32
#: Text bytes whose distinct words travel together.
SLICE = 32 << 20
#: The logarithm of the number of hashed contexts' bit counters, and how far each counts; beyond, both of its parts shrink.
SLOTS, MOST = 22, (1 << 16) - 1
#: Frequent words that tell what kind of text this is, and the kinds that they are grouped to at most; 0: none seen yet.
ANCHORS, KINDS = 256, 8
#: A word in under one of RARE texts of a batch isn't counted there at first; words that may be anchors all the same, at most.
RARE, MAYBE = 64, 1024
#: Symbols of a word's beginning whose counts are hashed; from there on words with one beginning meet in a task and are counted exactly, for as many symbols as REACH.
HEAD, REACH = 4, 64
#: Symbols whose bits are handled at once, and words of one task's chunk.
BLOCK, CHUNK_WORDS = 1 << 16, 1 << 16
#: Predictors: the last 1, 2 and 3 symbols and the kind, the last 4, the word so far, the word so far and the kind.
INPUTS, GATES, BINS = 6, 6 * 6 * 3, 33
#: Log odds that the refinement tells apart, and its rows: kinds by depth in the code.
RANGE, APM = 12, KINDS * 16
DELTA = np.float32(0.4)
#: How much of the past a block of learning keeps, and what holds weights back, by occurrence.
FADE, RIDGE = 0.9, 1e-3


class Code:
    """Byte values as symbols, the most frequent first, and a prefix code of them: each symbol's path through a binary tree, as nodes and bits. Codes rise with symbols."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(n) + 1, s, (s,)) for s, n in enumerate(counts)]
        length = np.zeros(256, np.int64)
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            length[[*a[2], *b[2]]] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        order = np.lexsort((np.arange(256), length))
        rank = np.empty(256, np.uint8)
        rank[order] = np.arange(256)
        self.rank, length = rank.tobytes(), length[order]
        paths, code, before, nodes = [], 0, 0, {}
        for n in length.tolist():  # canonical: codes rise with the symbol
            code, before = code << n - before, n
            paths.append(format(code, f"0{n}b"))
            code += 1
        self.length = length
        self.start = np.concatenate([[0], np.cumsum(length)])
        self.bit = np.array([int(x) for p in paths for x in p], np.int8)
        self.node = np.array([nodes.setdefault(p[:d], len(nodes)) for p in paths for d in range(len(p))], np.int64)
        self.depth = np.array([d for p in paths for d in range(len(p))], np.int64)
        common_ = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        self.shared = np.array([[common_(a, b) for b in paths] for a in paths], np.int64)

    def spell(self, word: bytes) -> bytes:
        """A word's symbols with its stop, or the end's; no spelling begins another one."""
        return (word if word == END else word + bytes([STOP])).translate(self.rank)


class Events:
    """Distinct (spelling, kind) in order, with their training counts."""

    def __init__(self, symbol: np.ndarray, start: np.ndarray, kinds: np.ndarray, counts: np.ndarray, code: Code):
        self.symbol, self.start, self.kind, self.count = symbol, start, kinds, counts
        self.size = np.diff(start)
        self.event = np.repeat(np.arange(len(self.size)), self.size)
        self.place = np.arange(len(self.symbol)) - self.start[self.event]
        self.bits = np.concatenate([[0], np.cumsum(code.length[self.symbol])])
        self.all = self.own = None

    def with_deep(self, code: Code) -> Events:
        self._deep(code)
        return self

    def _deep(self, code: Code) -> None:
        """self.all and self.own: for each bit after HEAD symbols, up to REACH, how many training words (of the kind) agree with an event on the bits before it; one more entry an event."""
        n = len(self.size)
        head, reach = (self.bits[self.start[:-1] + np.minimum(self.size, k)] for k in (HEAD, REACH))
        span = reach - head
        self.deep = np.concatenate([[0], np.cumsum(span + 1)])
        # bits that neighbours in the order share; all of them if they are one word
        shared, live, p = np.zeros(n, np.int64), np.arange(1, n), 0
        while len(live):
            whole = (self.size[live] == p) & (self.size[live - 1] == p)
            shared[live[whole]] = 1 << 60
            live = live[~whole]
            a, b = self.symbol[self.start[live - 1] + p], self.symbol[self.start[live] + p]
            same = a == b
            x = live[~same]
            shared[x] = self.bits[self.start[x] + p] - self.bits[self.start[x]] + code.shared[a[~same], b[~same]]
            live, p = live[same], p + 1
        upto = np.concatenate([[0], np.cumsum(self.count)])
        by_kind = np.zeros((KINDS, n + 1), np.int64)
        for k in range(KINDS):
            by_kind[k, 1:] = np.cumsum(np.where(self.kind == k, self.count, 0))
        edge = shared < 1 << 60
        edge[:1] = True
        word = np.cumsum(edge) - 1
        self.word_count = np.bincount(word, weights=self.count, minlength=1).astype(np.int64)[word]
        self.all = np.repeat(self.word_count, span + 1)
        self.own = np.repeat(self.count, span + 1)
        offset = head - self.bits[self.start[:-1]]
        live, r = np.flatnonzero(span > 0), 0
        while len(live):
            first = np.ones(len(live), bool)
            first[1:] = (live[1:] != live[:-1] + 1) | (shared[live[1:]] - offset[live[1:]] < r)
            lo = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            begin, end = live[lo], live[np.append(lo[1:], len(live)) - 1] + 1
            several = (word[end - 1] != word[begin])[group]  # a word alone keeps its own counts
            live, begin, end = live[several], begin[group[several]], end[group[several]]
            at, k = self.deep[live] + r, self.kind[live]
            self.all[at] = upto[end] - upto[begin]
            self.own[at] = by_kind[k, end] - by_kind[k, begin]
            r += 1
            live = live[span[live] >= r]

    def blocks(self, code: Code):
        """Bits of BLOCK symbols at a time: (event, node, bit, depth, hashes of contexts by input, deep place or -1, beyond reach)."""
        for a in range(0, len(self.symbol), BLOCK):
            i = np.arange(a, min(a + BLOCK, len(self.symbol)))
            s, event, place = self.symbol[i], self.event[i], self.place[i]
            back = [np.where(place >= k, self.symbol[np.maximum(i - k, 0)], 0).astype(np.uint64) for k in range(1, 5)]
            kind = self.kind[event].astype(np.uint64) << np.uint64(40)
            last = [back[0]]
            for k in (1, 2, 3):
                last.append(last[-1] | back[k] << np.uint64(8 * k))
            whole = last[3] | place.astype(np.uint64) << np.uint64(48)
            contexts = [last[0] | kind, last[1] | kind, last[2] | kind, last[3], whole, whole | kind]
            hashes = [common.mix(x + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) for j, x in enumerate(contexts)]
            size = code.length[s]
            of = np.repeat(np.arange(len(i)), size)
            at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + code.start[s][of]
            if self.all is not None:
                deep = (self.deep[event] + self.bits[i] - self.bits[self.start[event] + np.minimum(self.size[event], HEAD)])[of] + code.depth[at]
            else:
                deep = np.zeros(len(of), np.int64)
            place = place[of]
            yield event[of], code.node[at], code.bit[at], code.depth[at], hashes, of, np.where((place >= HEAD) & (place < REACH), deep, -1), place >= REACH


def slots(hashes: np.ndarray, node: np.ndarray) -> np.ndarray:
    return ((hashes + node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(64 - SLOTS)).astype(np.int64)


def _steps(n: np.ndarray) -> np.ndarray:
    return (n >= 1).astype(np.int64) + (n >= 2) + (n >= 4) + (n >= 16) + (n >= 256)


class Mixer:
    """Mixes the predictors' log odds for each bit with weights by gate, then refines the result by what such results came to."""

    def __init__(self, code: Code, table: np.ndarray, state: dict | None = None):
        self.code, self.table = code, table
        self.weight = np.full((GATES, INPUTS), 0.3)
        self.seen = np.zeros((APM * BINS, 2))
        self.refined, self.turns = None, 0
        if state:
            self.weight, self.seen = state["weight"], state["seen"]
            centre = np.tile(np.linspace(-RANGE, RANGE, BINS), APM)
            prior = 1 / (1 + np.exp(-centre))
            self.refined = (self.seen[:, 1] + 8 * prior) / (self.seen.sum(1) + 8)
        self.mass, self.curve = np.zeros(GATES), np.tile(np.eye(INPUTS) * 1e-3, (GATES, 1, 1))

    def _inputs(self, events: Events, block, less: int):
        """(log odds of the bits that came, by input; gates). less: 1 leaves the occurrence itself out of all counts."""
        _, node, bit, _, hashes, of, deep, beyond = block
        odds, totals = np.empty((INPUTS, len(node)), np.float32), []
        known, far = np.flatnonzero(deep >= 0), np.flatnonzero(beyond)
        less = np.float32(less)
        for j in range(INPUTS):
            cell = self.table[slots(hashes[j][of], node)]
            n, came = (cell >> np.uint32(16)).astype(np.float32), (cell & np.uint32(MOST)).astype(np.float32)
            np.subtract(n, came, out=came, where=bit == 0)
            if j >= 4:
                exact = events.all if j == 4 else events.own
                n[known], came[known] = exact[deep[known]], exact[deep[known] + 1]
                n[far] = came[far] = 0
            came = np.maximum(came - less, 0)
            n = np.maximum(n - less, came)
            odds[j] = np.log((came + DELTA) / (n - came + DELTA))
            if j >= 3:
                totals.append(n)
        gate = (_steps(totals[2]) * 6 + _steps(totals[1])) * 3 + (totals[0] >= 1) + (totals[0] >= 32)
        return odds, gate

    def _mixed(self, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        total = np.zeros(len(gate))
        for j in range(INPUTS):
            total += odds[j] * self.weight[:, j].take(gate)
        return np.clip(total, -20, 20)

    def _cells(self, events: Events, block, mixed: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Where the refinement looks, by kind, depth in the code and the log odds of a 1: the cells on both sides, and their shares."""
        event, _, bit, depth = block[:4]
        at = np.clip((np.where(bit == 1, mixed, -mixed) + RANGE) / (2 * RANGE) * (BINS - 1), 0, BINS - 1)
        low = np.minimum(at.astype(np.int64), BINS - 2)
        cell = (events.kind[event] * 16 + np.minimum(depth, 15)) * BINS + low
        return [(cell, 1 - (at - low)), (cell + 1, at - low)]

    def learn(self, events: Events) -> None:
        """One pass over events in training texts: each bit is predicted from all other occurrences, then weights move."""
        for block in events.blocks(self.code):
            count = events.count[block[0]]
            if not count.any():
                continue
            odds, gate = self._inputs(events, block, 1)
            self.mass += (mass := np.bincount(gate, weights=count, minlength=GATES))
            for turn in range(1 if self.turns else 6):
                mixed = self._mixed(odds, gate)
                p = 1 / (1 + np.exp(-mixed))
                push = count * (1 - p)
                slope = np.stack([np.bincount(gate, weights=push * odds[j], minlength=GATES) for j in range(INPUTS)], 1)
                if self.turns < 16 or self.turns % 8 == 0:
                    bend, curve = push * p, np.empty((GATES, INPUTS, INPUTS))
                    for j in range(INPUTS):
                        for k in range(j + 1):
                            curve[:, j, k] = curve[:, k, j] = np.bincount(gate, weights=bend * odds[j] * odds[k], minlength=GATES)
                    self.new = curve
                ridge = np.eye(INPUTS) * RIDGE * (mass + 1)[:, None, None]
                step = np.linalg.solve(FADE * self.curve + self.new + ridge, slope[:, :, None])[:, :, 0]
                self.weight += np.clip(step, -0.5, 0.5)
            self.curve = FADE * self.curve + self.new
            self.turns += 1
            for cell, part in self._cells(events, block, mixed):
                for b in (0, 1):
                    self.seen[:, b] += np.bincount(cell, weights=count * part * (block[2] == b), minlength=APM * BINS)

    def score(self, events: Events) -> np.ndarray:
        """log10 of each event's probability, in the events' order."""
        out = np.zeros(len(events.count))
        for block in events.blocks(self.code):
            odds, gate = self._inputs(events, block, 0)
            mixed = self._mixed(odds, gate)
            p = 1 / (1 + np.exp(-mixed))
            if self.refined is not None:
                r = sum(self.refined[cell] * part for cell, part in self._cells(events, block, mixed))
                p = (p + np.where(block[2] == 1, r, 1 - r)) / 2
            out += np.bincount(block[0], weights=np.log10(p), minlength=len(out))
        return out


class Slice:
    """Documents read so far: their tokens as numbers of distinct words, times KINDS, plus the kind before each."""

    def __init__(self):
        self.words: dict[bytes, int] = {END: 0}
        self.ids, self.held, self.sizes, self.pairs, self.bytes = [], [], [], [], 0

    def add(self, batch: pa.RecordBatch, anchors: dict[bytes, int]) -> None:
        texts = Texts(batch.column("text"), WORD)
        first, number = distinct_words(texts)
        own = [texts.word(i) for i in first.tolist()]
        numbers = np.array([self.words.setdefault(w, len(self.words)) for w in own], np.int64)
        # each document's end is a token after its words
        n = np.bincount(texts.row, minlength=batch.num_rows) + 1
        ends = np.cumsum(n)
        inner = np.ones(int(ends[-1]) if len(ends) else 0, bool)
        inner[ends - 1] = False
        token, kind = np.zeros(len(inner), np.int64), np.zeros(len(inner), np.int64)
        token[inner] = numbers[number]
        kind[inner] = np.array([anchors.get(w, 0) for w in own], np.int64)[number]
        # the last anchor before each token, within its document
        last = np.maximum.accumulate(np.where(kind > 0, np.arange(len(token)), -1)) if len(token) else token
        before = np.concatenate([[-1], last[:-1]])[: len(token)]
        kinds = np.where(before >= np.repeat(ends - n, n), kind[np.maximum(before, 0)], 0)
        self.ids += batch.column("id").to_pylist()
        self.held.append(batch.column("held").to_numpy(zero_copy_only=False))
        self.sizes.append(n)
        self.pairs.append((token * KINDS + kinds).astype(np.int32 if len(self.words) < 1 << 27 else np.int64))
        self.bytes += len(texts.low)


def read_slices(docs: DataFrame, anchors: dict[bytes, int], code) -> DataFrame:
    """Slices of (id, held, text): their documents' tokens by local number, and each local event (spelled word, kind of the words before) with its training count.

    The kind is that of the last anchor before the token in its document.
    """
    kind = docs.schema["id"].dataType

    def gather(batches):
        common.worker_state("context mixing")
        held, k = None, 0
        for batch in common.slices(batches, "text", 4 << 20):
            held = held or Slice()
            held.add(batch, anchors)
            if held.bytes >= SLICE:
                yield one(held, k)
                held, k = None, k + 1
        if held:
            yield one(held, k)

    def one(own, k):
        words = list(own.words)
        pair, held, n = (np.concatenate(x) for x in (own.pairs, own.held, own.sizes))
        event = np.flatnonzero(np.bincount(pair, minlength=len(words) * KINDS))
        place = np.zeros(len(words) * KINDS, np.int64)
        place[event] = np.arange(len(event))
        local = place[pair]
        count = np.bincount(local, weights=np.repeat(~held, n), minlength=len(event)).astype(np.int64)
        # what a sum over a document needs: its distinct events and how often it has each
        used, times = np.unique(np.repeat(np.arange(len(n)) * len(event), n) + local, return_counts=True)
        tokens = planes(np.diff(used, prepend=0).astype("<u4")) + planes(times.astype("<u4"))
        spelled = [code.value.spell(w) for w in words]
        spelled = [spelled[e] for e in (event // KINDS).tolist()]
        parts = [np.array([len(x) for x in spelled], "<i8").tobytes(), (event % KINDS).astype("<i4").tobytes(), count.astype("<i8").tobytes(), b"".join(spelled)]
        return pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId() << 32 | k]), pa.array([own.ids], pa.list_(to_arrow_type(kind))), pa.array([held.tolist()], pa.list_(pa.bool_())), pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([zlib.compress(tokens, 1)], pa.binary()), pa.array([len(event)]), pa.array([zlib.compress(b"".join(parts), 1)], pa.binary())],
            names=["slice", "ids", "held", "sizes", "tokens", "n", "events"],
        )

    return docs.mapInArrow(gather, f"slice long, ids array<{kind.simpleString()}>, held array<boolean>, sizes array<long>, tokens binary, n long, events binary")


def planes(x: np.ndarray) -> bytes:
    """Numbers with their lowest bytes first, then their next ones and so on, which compresses small ones well."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplaned(data: bytes, kind: str, at: int, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind)[:, 0]


def packed_scores(rows: DataFrame) -> DataFrame:
    """(slice, n, data) of (slice, local, c, lp): a row for what one batch has of a slice."""

    def pack(batches):
        for batch in batches:
            k, local, c, lp = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("slice", "local", "c", "lp"))
            order = np.argsort(k, kind="stable")
            edges = np.flatnonzero(np.diff(k[order], prepend=-1, append=-1)).tolist() if len(k) else []
            parts = [order[a:b] for a, b in zip(edges, edges[1:], strict=False)]
            data = [planes(local[i].astype("<u4")) + planes(c[i].astype("<i8")) + lp[i].astype("<f8").tobytes() for i in parts]
            yield pa.RecordBatch.from_arrays([pa.array([int(k[i[0]]) for i in parts], pa.int64()), pa.array([len(i) for i in parts], pa.int32()), pa.array(data, pa.binary())], names=["slice", "n", "data"])

    return rows.select("slice", "local", "c", "lp").mapInArrow(pack, "slice long, n int, data binary")


def local_events(sliced: DataFrame) -> DataFrame:
    """(slice, local, word, kind, n) of each slice's events."""

    def unpack(batches):
        common.worker_state("context mixing")
        for batch in batches:
            for row in batch.to_pylist():
                n, data = row["n"], zlib.decompress(row["events"])
                offsets = np.concatenate([[0], np.cumsum(np.frombuffer(data, "<i8", n))]) + 20 * n
                kinds, counts = np.frombuffer(data, "<i4", n, 8 * n), np.frombuffer(data, "<i8", n, 12 * n)
                for a in range(0, n, 50_000):
                    b = min(n, a + 50_000)
                    words = [data[x:y] for x, y in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, row["slice"])), pa.array(np.arange(a, b, dtype=np.int32)), pa.array(words, pa.binary()), pa.array(kinds[a:b]), pa.array(counts[a:b])], names=["slice", "local", "word", "kind", "n"])

    return sliced.select("slice", "n", "events").mapInArrow(unpack, "slice long, local int, word binary, kind int, n long")


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _chunks(batches):
    """Sorted events (word, kind, n) in chunks that end where the first HEAD symbols change, as no count reaches over that."""
    held: list = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < CHUNK_WORDS:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        words = whole.column("word").to_pylist()
        at = len(words) - 1
        while at and words[at - 1][:HEAD] == words[-1][:HEAD]:
            at -= 1
        if at:
            yield whole.slice(0, at)
        held, size = [whole.slice(at)], whole.num_rows - at
        if size >= CHUNK_WORDS:
            size = 0  # a beginning with very many words: look again after as many more
    if held:
        yield _joined(held)


def _events(batch: pa.RecordBatch, code: Code) -> Events:
    words = batch.column("word").cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    symbol = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return Events(symbol, offsets - offsets[0], batch.column("kind").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("n").to_numpy(zero_copy_only=False), code)


def text_kinds(docs: DataFrame) -> tuple[dict[bytes, int], np.ndarray]:
    """(the kind, from 1 on, of each anchor; how often each byte value occurs in words), from all training texts.

    Anchors are the words in most of the texts; those that tend to share texts are one kind.
    """
    rows = docs.where(~F.col("held") & F.col("text").isNotNull()).select("text")
    words, letters, n = may_be_anchors(rows, RARE)
    together = shared_texts(rows, words)
    own = np.diag(together)
    top = sorted(range(len(words)), key=lambda i: (-own[i], words[i]))[:ANCHORS]
    return {words[top[i]]: k + 1 for k, g in enumerate(kinds_of(together[np.ix_(top, top)].astype(float), n)) for i in g}, letters


def may_be_anchors(rows: DataFrame, rare: int | None) -> tuple[list[bytes], np.ndarray, int]:
    """(words among which are the ANCHORS words that most texts have, byte values' counts in words, number of texts with words).

    Of each batch the words in at least one of `rare` texts are counted, which leaves bounds
    for every word; those whose upper bound reaches the ANCHORS-th lower one may be anchors.
    Where the bounds don't tell (words that aren't counted might be, or more than MAYBE may
    be), all words are counted.
    """

    def count(batches):
        common.worker_state("context mixing")
        totals = np.zeros(258, np.int64)  # byte values, texts with words, what a word may have without being counted
        for batch in common.slices(batches, "text", 4 << 20):
            texts = Texts(batch.column("text"), WORD)
            first, number = distinct_words(texts)
            own = np.bincount(texts.low[: texts.offsets[-1]], minlength=256)
            own[~WORD] = 0
            own[STOP] += len(number)
            totals[:256] += own
            pair = np.sort(number * np.int64(batch.num_rows) + texts.row)
            df = np.bincount(pair[np.flatnonzero(np.diff(pair, prepend=-1))] // batch.num_rows, minlength=len(first))
            some = int((np.diff(texts.row, prepend=-1) > 0).sum())
            missed = max(0, -(-some // rare) - 1) if rare else 0
            totals[256:] += some, missed
            at = np.flatnonzero(df > missed)
            yield pa.RecordBatch.from_arrays([pa.array([texts.word(i) for i in first[at].tolist()], pa.binary()), pa.nulls(len(at), pa.int32()), pa.array(df[at]), pa.array(np.full(len(at), missed))], names=["word", "value", "n", "missed"])
        yield pa.RecordBatch.from_arrays([pa.nulls(258, pa.binary()), pa.array(np.arange(258, dtype=np.int32)), pa.array(totals), pa.array(np.zeros(258, np.int64))], names=["word", "value", "n", "missed"])

    sums = common.cut(rows.mapInArrow(count, "word binary, value int, n long, missed long").groupBy("word", "value").agg(F.sum("n").alias("n"), F.sum("missed").alias("missed")))
    totals = np.zeros(258, np.int64)
    for r in sums.where("value is not null").collect():
        totals[r["value"]] = r["n"]
    letters, missed = totals[:256], int(totals[257])
    letters[[STOP, END[0]]] += 1
    known = sums.where("word is not null").orderBy(F.col("n").desc(), "word")
    found = [(bytes(r["word"]), r["n"]) for r in known.limit(ANCHORS).collect()]
    if missed:
        least = found[-1][1] if len(found) == ANCHORS else 0
        found = [(bytes(r["word"]), r["n"]) for r in known.where(F.col("n") + missed - F.col("missed") >= least).limit(MAYBE + 1).collect()]
        if least <= missed or len(found) > MAYBE:
            common.forget(sums)
            return may_be_anchors(rows, None)
    common.forget(sums)
    return [w for w, _ in found], letters, int(totals[256])


def shared_texts(rows: DataFrame, words: list[bytes]) -> np.ndarray:
    """In how many texts two of the words are, and in the diagonal one."""
    m = len(words)
    if not m:
        return np.zeros((0, 0), np.int64)
    table = rows.sparkSession.sparkContext.broadcast(words)

    def count(batches):
        common.worker_state("context mixing")
        words = table.value
        number = {w: i for i, w in enumerate(words)}
        low, offsets = packed(words)
        hashes = common.span_hash(common.prefix_hash(common.BYTE_VALUES[low]), offsets[:-1], offsets[1:])
        order = np.argsort(hashes, kind="stable")
        hashes, out = hashes[order], np.zeros((m, m), np.int64)
        for batch in common.slices(batches, "text", 4 << 20):
            texts = Texts(batch.column("text"), WORD)
            at = np.minimum(np.searchsorted(hashes, texts.hash), m - 1)
            token = np.flatnonzero(hashes[at] == texts.hash)
            word = order[at[token]]
            same = same_bytes(texts.low, texts.start[token], texts.end[token], low, offsets[word], offsets[word + 1])
            for i in np.flatnonzero(~same).tolist():  # another word with this hash
                word[i] = number.get(texts.word(int(token[i])), -1)
            token, word = token[word >= 0], word[word >= 0]
            has = np.zeros((batch.num_rows, m), np.float32)
            has[texts.row[token], word] = 1
            out += np.rint(has.T @ has).astype(np.int64)
        return out.ravel()

    return summed(rows, count, m * m).reshape(m, m)


def kinds_of(together: np.ndarray, n: int) -> list[list[int]]:
    """Groups of anchors whose presence correlates: the most alike on average join until there are few and none are alike. together: in how many of n texts two are."""
    own = np.diag(together)
    spread = np.sqrt(np.maximum(own * (n - own), 1))
    alike = (n * together - np.outer(own, own)) / np.outer(spread, spread)
    groups = [[i] for i in range(len(together))]
    while len(groups) > 1:
        size = np.array([len(g) for g in groups])
        mean = alike / np.outer(size, size)
        np.fill_diagonal(mean, -np.inf)
        i, j = sorted(divmod(int(np.argmax(mean)), len(groups)))
        if len(groups) < KINDS and mean[i, j] < 0.2:
            break
        alike[i] += alike[j]
        alike[:, i] += alike[:, j]
        alike = np.delete(np.delete(alike, j, 0), j, 1)
        groups[i] += groups.pop(j)
    return groups


def _table(words: DataFrame, code) -> np.ndarray:
    """Counters of all hashed contexts: occurrences of a node in the upper half of each value, ones in the lower."""

    def count(batches):
        common.worker_state("context mixing")
        counts = None
        for batch in _chunks(batches):
            events = _events(batch, code.value)
            if counts is None:
                counts = np.zeros(2 << SLOTS, np.int64)
            for event, node, bit, _, hashes, of, deep, beyond in events.blocks(code.value):
                n = events.count[event]
                for j in range(INPUTS):
                    live = n > 0 if j < 4 else (n > 0) & (deep < 0) & ~beyond
                    at, own = slots(hashes[j][of[live]], node[live]), n[live]
                    np.add.at(counts, at, own)
                    one = bit[live] == 1
                    np.add.at(counts, at[one] + (1 << SLOTS), own[one])
        if counts is not None:
            yield from array_rows(counts)

    sums = tree_sum(words.mapInArrow(count, PART), words.rdd.getNumPartitions())
    n, ones = np.zeros(1 << SLOTS, np.int64), np.zeros(1 << SLOTS, np.int64)
    per = (1 << SLOTS) // CHUNK
    for row in sums.select("chunk", "at", "n").toLocalIterator():
        at, own = cells_of(row.asDict())
        (n if row["chunk"] < per else ones)[row["chunk"] % per * CHUNK + at] = own
    return packed_counts(n, ones)


def packed_counts(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Counters as one value each, n above and ones below."""
    big = n > MOST
    ones = np.where(big, np.rint(ones * (MOST / np.maximum(n, 1))), ones)
    return np.minimum(n, MOST).astype(np.uint32) << np.uint32(16) | ones.astype(np.uint32)


def _trained(words: DataFrame, code, table) -> dict:
    """Weights that each task learned online over its words, averaged by how much each gate saw, and the sums of what the refinement saw."""

    def learn(batches):
        common.worker_state("context mixing")
        mixer = Mixer(code.value, table.value)
        for batch in _chunks(batches):
            mixer.learn(_events(batch, code.value).with_deep(code.value))
        cells = np.concatenate([(mixer.weight * mixer.mass[:, None]).ravel(), mixer.mass, mixer.seen.ravel()])
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(cells[at])], names=["cell", "v"])

    cells = np.zeros(GATES * INPUTS + GATES + APM * BINS * 2)
    for r in words.mapInArrow(learn, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        cells[r["cell"]] = r["v"]
    a, b = GATES * INPUTS, GATES * INPUTS + GATES
    mass = cells[a:b]
    weight = np.where(mass[:, None] > 0, cells[:a].reshape(GATES, INPUTS) / np.maximum(mass, 1e-9)[:, None], 0.3)
    return {"weight": weight, "seen": cells[b:].reshape(-1, 2)}


def score_texts(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document.

    learn: a condition for the rows to learn from. Tokens are runs of bytes other than white
    space, A-Z lower-cased, then one end. base_score: log10 of add-one unigram probabilities
    from all training tokens. score: log10 of the mixed model's probability of the same tokens,
    spelled out with a stop after each word; it sums to 1 over all token sequences.

    The model predicts the bits of each spelled symbol (in a prefix code) from counters of
    hashed contexts, gathered from all training texts: the last 1 to 4 symbols, the word so
    far, and what kind of text the words before tell it is. Logistic weights, chosen by how
    much the word so far has been seen, are learned online with each occurrence left out of
    the counts that predict it, by all tasks over their own words, and averaged; a last table
    corrects each probability by what such ones came to. Which words tell kinds, and the
    prefix code, are from all training texts too. A word's score depends on the word and
    the kind alone, so each distinct pair is scored once and joined back.

    A null text is empty: one token. Without rows to learn from no token is known and the
    model knows nothing but its code. Repeated rows each get a row; an empty table none.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    kind = docs.select(id_col).schema[0].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(~learn, F.lit(True)).alias("held"), F.col(text_col).cast("string").alias("text"))
    anchors, letters = text_kinds(rows)
    code = spark.sparkContext.broadcast(Code(letters))
    sliced = common.cut(read_slices(rows, anchors, code))
    local = local_events(sliced)
    words = local.groupBy("word", "kind").agg(F.sum("n").alias("n"))
    # a word's kinds, and all words with one beginning, meet in a task
    words = common.cut(words.repartition(F.substring("word", 1, HEAD)).sortWithinPartitions("word", "kind"))
    by_word = words.where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))
    total, distinct = by_word.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    table = spark.sparkContext.broadcast(_table(words, code))
    state = spark.sparkContext.broadcast(_trained(words, code, table))

    def score(batches):
        common.worker_state("context mixing")
        mixer = Mixer(code.value, table.value, state.value)
        for batch in _chunks(batches):
            events = _events(batch, code.value).with_deep(code.value)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("kind"), pa.array(events.word_count), pa.array(mixer.score(events))], names=["word", "kind", "c", "lp"])

    scored = words.mapInArrow(score, "word binary, kind int, c long, lp double")
    back = packed_scores(local.drop("n").join(scored.hint("shuffle_hash"), ["word", "kind"]))

    def summed(key, own, found):
        row = own.slice(0, 1).to_pylist()[0]
        n, size = row["n"], np.array(row["sizes"], np.int64)
        c, lp = np.empty(n, np.int64), np.empty(n)
        for part in found.select(["n", "data"]).to_pylist():
            k, data = part["n"], part["data"]
            at = unplaned(data, "<u4", 0, k)
            c[at], lp[at] = unplaned(data, "<i8", 4 * k, k), np.frombuffer(data, "<f8", k, 12 * k)
        base = np.log10((c + 1) / (total + 1 * (distinct + 1)))
        data = zlib.decompress(row["tokens"])
        used = np.cumsum(unplaned(data, "<u4", 0, len(data) // 8).astype(np.int64))
        times = unplaned(data, "<u4", len(data) // 2, len(data) // 8)
        of, event = np.divmod(used, n)
        add = lambda v: np.bincount(of, weights=v[event] * times, minlength=len(size))
        return pa.table({"id": pa.array(row["ids"], to_arrow_type(kind)), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(size), "n_known": pa.array(add(c > 0).astype(np.int64)), "train_tokens": pa.array(np.full(len(size), total, np.int64)), "base_score": pa.array(add(base)), "score": pa.array(add(lp))})

    own = sliced.select(F.col("slice").alias("of"), "ids", "held", "sizes", "tokens", "n")
    return own.groupBy("of").cogroup(back.groupBy("slice")).applyInArrow(summed, f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
