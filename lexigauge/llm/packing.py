"""Sum-of-squares online packing of token sequences into windows of equal length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_counts import PATTERN, merge_ranks, plain


#: White space in a row from which on the library cuts a text.
BLANK = 1 << 16


class SumOfSquares:
    """Places pieces online: each goes to the level of fill after which the squared counts of partly filled windows sum least.

    counts[h] is the number of open windows filled to h. A piece of s tokens turns a window
    at level h into one at h + s, or a new window into one at s; a full window is closed.
    The level array also bounds what is open, as levels with many windows draw pieces.
    """

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]
        self.open: dict[int, list[tuple]] = {}
        self.next = 0

    def place(self, piece: tuple, size: int) -> list[tuple] | None:
        """piece goes to a window; the window's pieces if it is full now."""
        w, c = self.window, self.counts
        if size == w:
            self.next += 1
            return [piece]
        # by how much the sum of squares grows, for levels 0 (a new window) to w - size
        to = c[size : w + 1]
        grows = 2 * (to - c[: w + 1 - size]) + 2
        grows[0] = 2 * c[size] + 1
        grows[-1] = 1 - 2 * c[w - size]
        open_at = c[: w + 1 - size] > 0
        open_at[0] = True
        grows[~open_at] = np.iinfo(np.int64).max
        h = len(grows) - 1 - int(np.argmin(grows[::-1]))  # the fullest of equals
        if h:
            k = self.at[h].pop()
            c[h] -= 1
        else:
            k, self.next = self.next, self.next + 1
            self.open[k] = []
        self.open[k].append(piece)
        if h + size == w:
            return self.open.pop(k)
        self.at[h + size].append(k)
        c[h + size] += 1
        return None

    def rest(self) -> list[list[tuple]]:
        """The windows still open, fullest first."""
        keys = [k for h in range(self.window - 1, 0, -1) for k in self.at[h]]
        return [self.open[k] for k in keys]


def encoder(path: str, end_id: int):
    """A function from texts to the bytes of their ids (little-endian, 32 bits), with end_id after each.

    Ids are those of the tokenizers library. Where the vocabulary's ids follow its merges, as
    they do in published ones, ranks give the same ids in a third of the time and without a
    cache; texts with special strings or scripts that Unicode versions cut differently, and
    other vocabularies, go to the library itself, as do runs of BLANK spaces, in which the
    pattern would backtrack without end.
    """
    import os
    import re

    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    blank = re.compile(rf"\s{{{BLANK}}}")
    end = np.array([end_id], "<u4").tobytes()
    ranks = merge_ranks(path)
    by_rank = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def encode(texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if by_rank is None or any(s in t for s in special) or not plain(t) or len(t) >= BLANK and blank.search(t):
                ids = tokenizer.encode(t, add_special_tokens=False).ids
            else:
                ids = by_rank.encode_ordinary(t)
            out.append(np.array(ids, "<u4").tobytes() + end)
        return out

    return encode


def _close(windows: list[list[tuple]], window: int) -> tuple[list[list[tuple]], int]:
    """Windows closed at the end of a partition, and how many tokens were moved for it.

    windows: partly filled, fullest first. Pieces stay where the rule has put them; the gaps of
    the fullest windows are filled from the emptiest, whose pieces are cut to fit, until one
    window is left, which is cut into powers of two.
    """
    out, moved = [], 0
    left, right = 0, len(windows) - 1
    while left < right:
        own = windows[left]
        gap = window - sum(p[2] for p in own)
        while gap and left < right:
            doc, start, length, ids, tokens = windows[right].pop()
            take = min(gap, length)
            own.append((doc, start, take, ids[: 4 * take], tokens))
            if take < length:
                windows[right].append((doc, start + take, length - take, ids[4 * take :], tokens))
            gap, moved = gap - take, moved + take
            if not windows[right]:
                right -= 1
        if not gap:
            out.append(own)
            left += 1
    if left == right:
        rest = windows[left]
        total = sum(p[2] for p in rest)
        if total == window:
            return [*out, rest], moved
        for size in (1 << k for k in range(window.bit_length(), -1, -1) if total >> k & 1):
            now = []
            while size:
                doc, start, length, ids, tokens = rest.pop()
                take = min(size, length)
                now.append((doc, start, take, ids[: 4 * take], tokens))
                if take < length:
                    rest.append((doc, start + take, length - take, ids[4 * take :], tokens))
                size -= take
            out.append(now)
        moved += total
    return out, moved


def pack_documents(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """A row for each piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids array<int>]).

    Each input partition is packed online, on its own, in one pass over its rows. A document
    longer than a window first fills whole windows; what remains goes where SumOfSquares
    puts it. Of the windows that a partition leaves open, the emptiest fill the others' gaps,
    cut to fit; the last one is cut into powers of two, so no sequence needs padding if those
    need none.
    sequence_id holds the partition in its upper bits; offset counts within a sequence.

    A null text counts as empty: its only token is end_id. An empty table gives no rows.
    Repeated rows are packed each. Memory: the open windows, whose number the rule keeps low.
    """
    common.prepare(docs.sparkSession)

    def run(batches):
        encode = common.worker_state(("pack", path, end_id), lambda: encoder(path, end_id))
        packer = SumOfSquares(window)
        base = TaskContext.get().partitionId() << 40
        sequence = 0
        held: list[tuple] = []

        def flush():
            doc, start, length, ids, tokens, seq, offset = zip(*held, strict=True)
            columns = [pa.array(doc, kind), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(tokens, pa.int64()), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())]
            if keep_ids:
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        def close(pieces):
            nonlocal sequence
            at = 0
            for doc, start, length, ids, tokens in pieces:
                held.append((doc, start, length, ids, tokens, base + sequence, at))
                at += length
            sequence += 1

        kind = None
        for batch in common.slices(batches, "text", 2 << 20):
            kind = batch.column("id").type
            docs_ = batch.column("id").to_pylist()
            for doc, ids in zip(docs_, encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                tokens = len(ids) // 4
                for start in range(0, tokens, window):
                    size = min(window, tokens - start)
                    if full := packer.place((doc, start, size, ids[4 * start : 4 * (start + size)], tokens), size):
                        close(full)
            if held:
                yield flush()
        for pieces in _close(packer.rest(), window)[0]:
            close(pieces)
            if len(held) >= 10_000:
                yield flush()
        if held:
            yield flush()

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids]
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
