"""Removal of repeated substrings: a distributed merge sort of suffixes that knows their common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes by whose hash suffixes are chosen for the sort.
ANCHOR = 40
#: Bytes of a long text that are searched for anchors at once.
STRETCH = 1 << 21
#: Suffixes in a sorted run, and in a bucket, about.
RUN, BUCKET = 100_000, 50_000
#: Where more suffixes than this begin with the same ANCHOR bytes, all windows around them are sorted instead.
HOT = 50_000
PAD = 0xFF  # no byte of UTF-8


def sliding(op: np.ufunc, a: np.ndarray, w: int, neutral) -> np.ndarray:
    """op over each window a[i : i + w], in two passes."""
    n = len(a) - w + 1
    blocks = np.full(-(-len(a) // w) * w, neutral, a.dtype)
    blocks[: len(a)] = a
    blocks = blocks.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose ANCHOR bytes have the least hash in some window of a row, and those hashes.

    The choice depends on a window's bytes alone: equal windows have the same anchors.
    """
    none = np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(data) < window:
        return none
    if len(data) > 2 * STRETCH:  # a long text by stretches that hold all its windows
        found = []
        for a in range(0, len(data), STRETCH):
            part = data[a : a + STRETCH + window - 1]
            at, h = anchors(part, np.unique(np.clip(offsets - a, 0, len(part))), window)
            found.append((at + a, h))
        at, first = np.unique(np.concatenate([x for x, _ in found]), return_index=True)
        return at, np.concatenate([h for _, h in found])[first]
    start = np.arange(len(data) - ANCHOR + 1)
    h = common.span_hash(common.prefix_hash(common.BYTE_VALUES[data]), start, start + ANCHOR)
    # bytes left in the row from each position
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    h[left[: len(h)] < ANCHOR] = np.uint64(2**64 - 1)
    w = window - ANCHOR + 1
    least = sliding(np.minimum, h, w, np.uint64(2**64 - 1))
    least[left[: len(least)] < window] = 0
    most = sliding(np.maximum, np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(len(h) - len(least), np.uint64)]), w, np.uint64(0))
    at = np.flatnonzero((most == h) & (left[: len(h)] >= ANCHOR))
    return at, h[at]


def lcp(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix of two strings of one length that are alike in their first `known` bytes."""
    x = int.from_bytes(a[known:]) ^ int.from_bytes(b[known:])
    return len(a) - (x.bit_length() + 7) // 8


class Run:
    """A sorted run of strings, front-coded: of each string the bytes after those it shares with the one before."""

    def __init__(self, shared: np.ndarray, tails: bytes, width: int):
        self.shared, self.tails, self.width = shared.tolist(), tails, width
        self.i, self.at, self.now = -1, 0, b""

    def advance(self) -> bool:
        self.i += 1
        if self.i >= len(self.shared):
            return False
        s = self.shared[self.i]
        end = self.at + self.width - s
        self.now = self.now[:s] + self.tails[self.at : end]
        self.at = end
        return True


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int, bytes]]:
    """(run, index, prefix shared with the string before, string) in order, by a loser tree.

    Each string in the tree carries the length of the prefix it shares with the last string
    put out. Of two, the one that shares more is the lesser; only where they share equally
    many bytes are they compared, from there on. What a loser shares with its winner is then
    known, so no byte is looked at twice.
    """
    k = 1
    while k < len(runs):
        k *= 2
    live = [r.advance() for r in runs] + [False] * (k - len(runs))
    shared = [0] * k
    tree = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        if not live[a]:
            return b, a
        if not live[b]:
            return a, b
        sa, sb = shared[a], shared[b]
        if sa != sb:
            return (a, b) if sa > sb else (b, a)
        x, y = runs[a].now, runs[b].now
        h = lcp(x, y, sa)
        if h == len(x) or x[h] < y[h]:
            shared[b] = h
            return a, b
        shared[a] = h
        return b, a

    level = list(range(k))
    node = k // 2
    while len(level) > 1:
        up = []
        for j in range(0, len(level), 2):
            w, tree[node + j // 2] = play(level[j], level[j + 1])
            up.append(w)
        level, node = up, node // 2
    top = level[0]
    while live[top]:
        run = runs[top]
        yield top, run.i, shared[top], run.now
        live[top] = run.advance()
        if live[top]:
            shared[top] = run.shared[run.i]
        node, w = (top + k) // 2, top
        while node:
            w, tree[node] = play(w, tree[node])
            node //= 2
        top = w


def _pack(*arrays) -> bytes:
    """Arrays and bytes as one compressed value."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(p) for p in parts], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _unpack(blob: bytes, kinds: list) -> list:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(kinds)).tolist()
    out, at = [], 8 * len(kinds)
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(raw[at : at + n] if kind is bytes else np.frombuffer(raw[at : at + n], kind))
        at += n
    return out


RUN_KINDS = [np.uint16, np.uint8, np.int64, np.int32, np.int32, bytes]


class Contexts:
    """Strings of one width around anchors: the suffix from the anchor, then what stands before it, backwards, each padded."""

    def __init__(self, window: int):
        self.window, self.before = window, window - ANCHOR
        self.width = self.window + self.before

    def rows(self, data: np.ndarray, lo: int, hi: int, at: np.ndarray, alone: bool) -> np.ndarray:
        """The contexts of positions in the row data[lo:hi]; alone: without what stands before."""
        out = np.full((len(at), self.width), PAD, np.uint8)
        padded = np.concatenate([np.full(self.before, PAD, np.uint8), data[lo:hi], np.full(self.window, PAD, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, self.window)
        out[:, : self.window] = view[at - lo + self.before]
        if not alone:
            view = np.lib.stride_tricks.sliding_window_view(padded, self.before)
            out[:, self.window :] = view[at - lo][:, ::-1]
        return out

    def windows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and most bytes before the anchor of whole windows that a context holds."""
        real = x != PAD
        suffix, before = real[:, : self.window].sum(1), real[:, self.window :].sum(1)
        return self.window - suffix, np.minimum(before, self.before)


SPAN = np.dtype([("key", np.int64), ("key2", np.int32), ("lo", np.int32), ("hi", np.int32)])


def _joined(spans: np.ndarray) -> np.ndarray:
    """Spans of window starts with those of one text that touch made one."""
    if len(spans) < 2:
        return spans
    spans = spans[np.lexsort((spans["lo"], spans["key2"], spans["key"]))]
    text = np.zeros(len(spans), np.int64)
    text[1:] = np.cumsum((spans["key"][1:] != spans["key"][:-1]) | (spans["key2"][1:] != spans["key2"][:-1]))
    reach = np.maximum.accumulate(spans["hi"] + (text << 33)) - (text << 33)
    new = np.ones(len(spans), bool)
    new[1:] = (text[1:] != text[:-1]) | (spans["lo"][1:] > reach[:-1] + 1)
    first = np.flatnonzero(new)
    out = spans[first]
    out["hi"] = reach[np.append(first[1:] - 1, len(spans) - 1)]
    return out


def _bucket(x: np.ndarray, length: int, buckets: int) -> np.ndarray:
    """The bucket of each context, by its first bytes."""
    up, _ = common.powers(length)
    out = np.empty(len(x), np.int64)
    for k in range(0, len(x), 8192):
        h = common.mix((common.BYTE_VALUES[x[k : k + 8192, :length]] * up[:length]).sum(1, dtype=np.uint64))
        out[k : k + 8192] = (h % np.uint64(buckets)).astype(np.int64)
    return out


def _emit(x: np.ndarray, ref: np.ndarray, place: np.ndarray, buckets: int, shape: Contexts, salt: int):
    """Rows (bucket, kind, blob) of one sorted run: its share of each bucket, and the spans that it shows to be repeated itself.

    Equal contexts go on as one, which counts twice and needs no reference: the run knows
    all their windows to be repeated.
    """
    order = np.lexsort((x.view(f"S{shape.width}").ravel(), place))
    x, ref, place = x[order], ref[order], place[order]
    new = np.ones(len(x), bool)
    differ = x[1:] != x[:-1]
    new[1:] = differ.any(1) | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    count = np.diff([*first, len(x)])
    if (count > 1).any():
        many = np.repeat(count > 1, count)
        least, most = shape.windows(x[many])
        ok = least <= most
        r = ref[many][ok]
        if len(r):
            own = np.empty(len(r), SPAN)
            own["key"], own["key2"], own["lo"], own["hi"] = r["key"], r["key2"], r["at"] - most[ok], r["at"] - least[ok]
            yield salt % buckets, 1, _joined(own).tobytes()
    x, ref, place, count = x[first], ref[first], place[first], np.minimum(count, 2).astype(np.uint8)
    shared = np.zeros(len(x), np.uint16)
    if len(x) > 1:
        differ = x[1:] != x[:-1]
        shared[1:] = differ.argmax(1)
    cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    shared[cuts] = 0
    columns = np.arange(shape.width)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(x)], strict=True):
        one = count[a:b] == 1
        tails = x[a:b][columns[None, :] >= shared[a:b, None]].tobytes()
        r = ref[a:b][one]
        yield int(place[a]), 0, _pack(shared[a:b], count[a:b], r["key"], r["key2"], r["at"], tails)


REF = np.dtype([("key", np.int64), ("key2", np.int32), ("at", np.int32)])


def _judge(merged: np.ndarray, shared: np.ndarray, count: np.ndarray, shape: Contexts) -> np.ndarray:
    """For distinct contexts in order, which windows around their anchors are repeated: [bytes before the anchor, context].

    Two contexts hold one window with a bytes before the anchor if they share a bytes
    backwards and the rest onwards. For each a, both orders' common prefixes cut contexts
    into classes, and those in one class of both share the window.
    """
    n, window, before = len(merged), shape.window, shape.before
    least, most = shape.windows(merged)
    every = np.arange(before + 1)[:, None]
    inside = (every >= least[None, :]) & (every <= most[None, :])
    found = inside & (count >= 2)[None, :]
    # only contexts that share ANCHOR bytes with another one can share a window with it
    near = shared >= ANCHOR
    near[0] = False
    some = near.copy()
    some[:-1] |= near[1:]
    at = np.flatnonzero(some)
    if len(at):
        suffix = np.minimum(shared[at], window).astype(np.int32)
        suffix[~near[at]] = 0
        back = np.ascontiguousarray(merged[at, window:])
        order = np.argsort(back.view(f"S{before}").ravel(), kind="stable")
        differ = back[order[1:]] != back[order[:-1]]
        alike = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), before)])
        weight = count[at] >= 2
        for a in range(before + 1):
            ok = inside[a, at]
            if not ok.any():
                continue
            onwards = np.cumsum(suffix < window - a)
            backwards = np.empty(len(at), np.int64)
            backwards[order] = np.cumsum(alike < a)
            key = (onwards * (len(at) + 1) + backwards)[ok]
            by = np.argsort(key, kind="stable")
            s = key[by]
            same = s[1:] == s[:-1]
            twice = np.zeros(len(s), bool)
            twice[1:] |= same
            twice[:-1] |= same
            hit = np.empty(len(s), bool)
            hit[by] = twice
            found[a, at[ok]] |= hit | weight[ok]
    return found


def _merge_bucket(blobs: list[bytes], shape: Contexts) -> np.ndarray:
    """The spans of window starts (key, key2, first, last) that a bucket shows to be repeated."""
    runs, counts, refs = [], [], []
    for blob in blobs:
        shared, count, key, key2, at, tails = _unpack(blob, RUN_KINDS)
        runs.append(Run(shared, tails, shape.width))
        counts.append(count.tolist())
        ref = np.full(len(count), -1, np.int64)
        ref[count == 1] = np.arange(int((count == 1).sum()))
        r = np.empty(len(key), REF)
        r["key"], r["key2"], r["at"] = key, key2, at
        refs.append((ref.tolist(), r))
    strings, shared, total, members = [], [], [], []
    for run, i, s, now in merge(runs):
        if s == shape.width and strings:
            total[-1] += counts[run][i]
        else:
            strings.append(now)
            shared.append(s)
            total.append(counts[run][i])
        if (r := refs[run][0][i]) >= 0:
            members.append((len(strings) - 1, run, r))
    merged = np.frombuffer(b"".join(strings), np.uint8).reshape(len(strings), shape.width)
    found = _judge(merged, np.array(shared), np.array(total), shape)
    edge = np.zeros((1, found.shape[1]), np.int8)
    step = np.diff(np.concatenate([edge, found.astype(np.int8), edge]), axis=0)
    of, lo = np.nonzero(step.T == 1)
    _, hi = np.nonzero(step.T == -1)  # in the same order: a context's stretches are disjoint
    first = np.searchsorted(of, np.arange(len(strings) + 1))
    out = []
    for context, run, r in members:
        ref = refs[run][1][r]
        for j in range(first[context], first[context + 1]):
            out.append((ref["key"], ref["key2"], ref["at"] - (hi[j] - 1), ref["at"] - lo[j]))
    return np.array(out, SPAN)


def repeated_windows(docs: DataFrame, window: int, hot: int = HOT) -> DataFrame:
    """(key, key2, spans): spans of starts of repeated windows. docs: (id, text, key, key2)."""
    spark = docs.sparkSession
    shape = Contexts(window)

    def choose(batches):
        common.worker_state("suffix_dedup")
        for batch in common.slices(batches, "text"):
            data, offsets = common.text_buffers(batch.column("text"))
            at, h = anchors(data, offsets, window)
            edges = np.searchsorted(at, offsets).astype(np.int32)
            at -= offsets[np.searchsorted(offsets, at, side="right") - 1]
            full = np.flatnonzero(np.diff(edges))
            # rows without anchors have no elements, so the edges of the others are those of all
            edges = np.append(edges[full], edges[-1]) if len(full) else np.zeros(1, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(full)), batch.column("key2").take(pa.array(full)), pa.ListArray.from_arrays(pa.array(edges), pa.array(h.view(np.int64))), pa.ListArray.from_arrays(pa.array(edges), pa.array(at.astype(np.int32)))],
                names=["key", "key2", "h", "at"],
            )

    chosen = common.cut(docs.select("text", "key", "key2").mapInArrow(choose, "key long, key2 int, h array<long>, at array<int>"))
    rows = chosen.select("key", "key2", F.explode(F.arrays_zip("h", "at")).alias("x")).select("key", "key2", "x.h", "x.at")
    repeated = common.cut(chosen.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    total = repeated.agg(F.sum("n")).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, -(-int(total) // BUCKET))
    # places of a common passage share one hash
    placed = common.spread_join(rows, repeated, ["h"], "key", common.hot_keys(repeated, ["h"]))
    hits = placed.groupBy("key", "key2").agg(F.collect_list(F.when(F.col("n") < hot, F.col("at"))).alias("few"), F.collect_list(F.when(F.col("n") >= hot, F.col("at"))).alias("many"))

    def contexts(batches):
        common.worker_state("suffix_dedup")
        held, refs, places, n, salt = [], [], [], 0, 0

        def flush():
            x = np.concatenate(held)
            yield from _emit(x, np.concatenate(refs), np.concatenate(places), buckets, shape, salt)

        for batch in common.slices(batches, "text"):
            data, offsets = common.text_buffers(batch.column("text"))
            keys, keys2 = batch.column("key").to_pylist(), batch.column("key2").to_pylist()
            few, many = batch.column("few").to_pylist(), batch.column("many").to_pylist()
            for r in range(batch.num_rows):
                lo, hi = int(offsets[r]), int(offsets[r + 1])
                own = [(np.unique(np.array(few[r], np.int64)), False)] if few[r] else []
                if many[r]:
                    starts = np.unique((np.array(many[r], np.int64)[:, None] - np.arange(shape.before + 1)[None, :]).ravel())
                    own.append((starts[(starts >= 0) & (starts <= hi - lo - window)], True))
                for every, alone in own:
                    for k in range(0, len(every), RUN):
                        at = every[k : k + RUN] + lo
                        held.append(shape.rows(data, lo, hi, at, alone))
                        ref = np.empty(len(at), REF)
                        ref["key"], ref["key2"], ref["at"] = keys[r], keys2[r], at - lo
                        refs.append(ref)
                        # windows alone have buckets of their own: one of them and a context may stand at one place
                        places.append(_bucket(held[-1], window, buckets) + buckets if alone else _bucket(held[-1], ANCHOR, buckets))
                        n += len(at)
                        if n >= RUN:
                            salt = keys[r]
                            yield from _batches(flush())
                            held, refs, places, n = [], [], [], 0
        if n:
            salt = int(refs[0]["key"][0])
            yield from _batches(flush())

    def spans(batches):
        for group in common.runs(batches, "bucket"):
            kinds, blobs = group.column("kind").to_pylist(), group.column("blob").to_pylist()
            found = [np.frombuffer(b, SPAN) for k, b in zip(kinds, blobs, strict=True) if k == 1]
            if own := [b for k, b in zip(kinds, blobs, strict=True) if k == 0]:
                found.append(_merge_bucket(own, shape))
            every = _joined(np.concatenate(found))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(every[c])) for c in SPAN.names], names=list(SPAN.names))

    # with all columns of docs, so that this join and that of the spans read one shuffle of the texts
    runs = docs.join(hits, ["key", "key2"]).select(*docs.columns, "few", "many").mapInArrow(contexts, "bucket int, kind int, blob binary")
    found = runs.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(spans, "key long, key2 int, lo int, hi int")
    return found.groupBy("key", "key2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _batches(rows):
    for bucket, kind, blob in rows:
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "kind", "blob"])


def remove_repeats(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """(id, n_bytes, removed array<struct<start,end>>, n_removed, n_spans, kept binary, and the columns in carry) of each document.

    Each byte covered by a string of `window` bytes that also starts anywhere else, in this
    or another document, is removed; all copies go. Texts are UTF-8 bytes, so a cut may lie
    inside a character; with as_text, kept is a string without the parts of such characters,
    and null where the text is.

    Suffixes are sorted from anchors only: positions chosen by the bytes around them so that
    each window holds one, and only where the ANCHOR bytes there occur twice at least. Tasks
    sort the contexts of theirs into runs, exchange them front-coded by a hash of those bytes
    and merge the runs of a bucket with a loser tree; common prefixes from the merge then
    tell which windows occur twice. Equal contexts leave a task as one. Where more than `hot`
    anchors have the same bytes, the windows around them are sorted one by one and spread by
    their own hash, so that no bucket grows with a passage's copies.

    A null text counts as empty. Repeated rows are repeats of each other. An empty table
    gives no rows; a text shorter than `window` stays as it is.
    """
    if window <= ANCHOR:
        raise ValueError(f"window must be over {ANCHOR}")
    common.prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), text).alias("key"), F.hash(text).alias("key2"), *([F.struct(*carry).alias("carried")] if carry else []))
    spans = repeated_windows(docs, window, hot)

    def remove(batches):
        common.worker_state("suffix_dedup")
        for batch in common.slices(batches, "text"):
            data, offsets = common.text_buffers(batch.column("text"))
            removed, n_removed, kept = [], [], []
            for r, own in enumerate(batch.column("spans").to_pylist()):
                raw = data[offsets[r] : offsets[r + 1]]
                if not own:
                    removed.append([])
                    n_removed.append(0)
                    kept.append(raw.tobytes())
                    continue
                step = np.zeros(len(raw) + 1, np.int32)
                np.add.at(step, [s["lo"] for s in own], 1)
                np.add.at(step, [s["hi"] + window for s in own], -1)
                gone = np.cumsum(step[:-1]) > 0
                edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                removed.append([{"start": a, "end": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)])
                n_removed.append(int(gone.sum()))
                kept.append(raw[~gone].tobytes())
            if as_text:
                there = batch.column("text").is_valid().to_pylist()
                kept = [x.decode("utf-8", "ignore") if ok else None for x, ok in zip(kept, there, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(n_removed, pa.int64()), pa.array([len(x) for x in removed], pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary()), *([batch.column("carried")] if carry else [])],
                names=["id", "n_bytes", "removed", "n_removed", "n_spans", "kept", *["carried"] * bool(carry)],
            )

    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.join(spans, ["key", "key2"], "left").select("id", "text", "spans", *["carried"] * bool(carry))
    carried = f", carried {docs.schema['carried'].dataType.simpleString()}" if carry else ""
    out = rows.mapInArrow(remove, f"id {kind}, n_bytes long, removed array<struct<start:long,end:long>>, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}" + carried)
    return out.select("id", "n_bytes", "removed", "n_removed", "n_spans", "kept", *[F.col("carried")[c].alias(c) for c in carry])

