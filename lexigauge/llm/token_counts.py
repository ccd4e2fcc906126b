"""Token counts of byte-level BPE: merges from a heap over a linked list, with no identifiers."""

from __future__ import annotations

import json
import re
import unicodedata
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from . import common

#: Beyond these, letters and digits differ between Unicode versions; the library then cuts a text into its pieces. Fixed value.
COMMON = re.compile("[^\\x00-\\u024f]")
_LATIN = [chr(c) for c in range(0x250)]
_LETTERS, _DIGITS = ("".join(c for c in _LATIN if unicodedata.category(c)[0] == k) for k in "LN")
_LATIN_SPACE = r"\t-\r \x85\xa0"
#: Pieces that merges don't cross, by the published pattern of this vocabulary, in texts without such characters; letters come first, as nothing else can begin with one.
LATIN_PIECES = re.compile(rf" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_DIGITS}]+| ?[^{_LATIN_SPACE}{_LETTERS}{_DIGITS}]+|[{_LATIN_SPACE}]+(?![^{_LATIN_SPACE}])|[{_LATIN_SPACE}]+")
#: The published pattern itself. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters from which on a text's pieces aren't listed but taken one by one.
LONG = 1 << 20
#: Words whose counts a worker keeps at once.
CACHE = 1_000_000


def plain(text: str) -> bool:
    """Whether LATIN_PIECES cuts the text as the library does."""
    return text.isascii() or not COMMON.search(text)


def byte_symbols() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte: itself if it prints, else the next from 256 on."""
    out, more = [], 256
    for b in range(256):
        prints = b < 127 and b > 32 or b > 160 and b != 173
        out.append(chr(b) if prints else chr(more))
        more += not prints
    return out


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """The id of each token's bytes, if ids follow the order of merges; else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    byte_of = {c: b for b, c in enumerate(byte_symbols())}
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}


class PairMerger:
    """Counts the tokens of a piece: its symbols less the merges made, lowest rank first, leftmost first among equals."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {m: i for i, m in enumerate(pairs)}
        self.symbols = byte_symbols()
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        symbols: list[str | None] = [self.symbols[b] for b in piece.encode()]
        n, rank = len(symbols), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, n_) for i in range(n - 1) if (r := rank(n_ := (symbols[i], symbols[i + 1]))) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            if symbols[i] != pair[0] or j >= n or symbols[j] != pair[1]:
                continue  # one of the two has been merged since
            merges += 1
            whole = symbols[i] = pair[0] + pair[1]
            symbols[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                p = (whole, symbols[k])
                if (r := rank(p)) is not None:
                    heappush(heap, (r, i, p))
            if (h := before[i]) >= 0:
                p = (symbols[h], whole)
                if (r := rank(p)) is not None:
                    heappush(heap, (r, h, p))
        return n - merges


class _Known(dict):
    """Counts by piece, counted when first asked for."""

    def __init__(self, merger: PairMerger):
        super().__init__()
        self.merger = merger

    def __missing__(self, piece: str) -> int:
        out = self.merger.count(piece)
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = out
        return out


def counter(path: str):
    """A function from a text to its number of tokens; a special string in a text is one token."""
    merger = PairMerger(path)
    known, cut = _Known(merger), ByteLevel(add_prefix_space=False)
    special = re.compile("|".join(map(re.escape, sorted(merger.special, key=len, reverse=True)))) if merger.special else None

    def count(text: str | None) -> int:
        if not text:
            return 0
        parts = special.split(text) if special else [text]
        cuts = ((m[0] for m in LATIN_PIECES.finditer(p)) if len(p) > LONG and plain(p) else LATIN_PIECES.findall(p) if plain(p) else [p[a:b] for _, (a, b) in cut.pre_tokenize_str(p)] for p in parts)
        return len(parts) - 1 + sum(sum(map(known.__getitem__, c)) for c in cuts)

    return count



def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each document, over its whole text; nothing is shuffled.

    path: a vocabulary file in the tokenizers library's format, byte-level BPE. A null text
    counts as empty, with no tokens. Repeated rows each get a row.
    """
    common.prepare(docs.sparkSession)

    def run(batches):
        count = common.worker_state(("count", path), lambda: counter(path))
        for batch in common.slices(batches, "text", 8 << 20):
            n = [count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
