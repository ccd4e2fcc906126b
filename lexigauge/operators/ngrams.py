"""Contexts before words: mining, counting, frequencies, the top ones of each word, vocabulary filters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences, words
from ..functions.tokens import prefix_hashes


def prefix_contexts(docs: DataFrame, text: str = "text", most: int | None = None, context: int | None = None, by_sentence: bool = False) -> DataFrame:
    """(context, next_word): each prefix of a text of two words or more with the word after it.

    most: words of a text that are read; context: words that a context keeps, from its end;
    by_sentence: each sentence counts as a text.
    """
    if by_sentence:
        docs = docs.select(F.explode(sentences(F.col(text))).alias(text))
    tokens = words(F.col(text))
    if most is not None:
        tokens = F.slice(tokens, 1, most)
    rows = docs.select(tokens.alias("t")).where(F.size("t") > 1)
    rows = rows.select("t", F.explode(F.sequence(F.lit(1), F.size("t") - 1)).alias("i"))
    start = F.lit(1) if context is None else F.greatest(F.lit(1), F.col("i") - context + 1)
    return rows.select(F.array_join(F.slice("t", start, F.col("i") - start + 1), " ").alias("context"), F.get("t", F.col("i")).alias("next_word"))


def hashed_contexts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, size, next_word, at): the context before each word of each sentence but its first, however long, as 128 bits and a number of words.

    at: (key, sentence, size) says where it stands; a context's words are written out only for
    the rows that are put out (see with_context). So a word's row takes the same bytes
    wherever it stands, where the contexts themselves grow with the square of a sentence.
    """
    rows = docs.select(key, F.posexplode(sentences(F.col(text))).alias("sentence", "s")).select(key, "sentence", words(F.col("s")).alias("t"))
    # as a generated row, so that the words aren't split off again for each use
    rows = rows.select(key, "sentence", F.explode(F.when(F.size("t") > 1, F.array("t"))).alias("t"))
    rows = rows.select(key, "sentence", "t", prefix_hashes(F.col("t")).alias("a"), prefix_hashes(F.col("t"), 0xD6E8FEB86659FD93, 1).alias("b"))
    each = F.arrays_zip(F.slice("a", 1, F.size("a") - 1).alias("a"), F.slice("b", 1, F.size("b") - 1).alias("b"), F.slice("t", 2, F.size("t") - 1).alias("w"))
    rows = rows.select(key, "sentence", F.posexplode(each).alias("i", "c"))
    size = (F.col("i") + 1).alias("size")
    return rows.select("c.a", "c.b", size, F.col("c.w").alias("next_word"), F.struct(key, "sentence", size).alias("at"))


def hashed_counts(contexts: DataFrame) -> DataFrame:
    """(a, b, size, next_word, n, at) of each pair of a context and the word after it; at: where it stands first. Combined before the shuffle."""
    return contexts.groupBy("a", "b", "size", "next_word").agg(F.count("*").alias("n"), F.min("at").alias("at"))


def hashed_statistics(counts: DataFrame) -> DataFrame:
    """(a, b, size, n, distinct_next, frequency, log_per_million, at) of each context of hashed_counts; the total is one broadcast row."""
    per = counts.groupBy("a", "b", "size").agg(F.sum("n").alias("n"), F.count("*").alias("distinct_next"), F.min("at").alias("at"))
    out = per.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))
    share = F.col("n") / F.col("total")
    return out.select("a", "b", "size", "n", "distinct_next", share.alias("frequency"), F.log10(share * 1e6).alias("log_per_million"), "at")


def top_hashed(counts: DataFrame, targets: DataFrame | None = None, top: int = 5, least_words: int = 1) -> DataFrame:
    """(word, n, rank, at): the `top` contexts of each target word that have least_words words, by count, of equals the one that stands first. Groups are limited before they are shuffled and sorted."""
    rows = counts.where(F.col("size") >= least_words).select(F.col("next_word").alias("word"), "n", "at")
    if targets is not None:
        rows = rows.join(targets.select("word").distinct(), "word", "left_semi")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), F.asc("at")))).where(F.col("rank") <= top)


def with_context(rows: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """rows (with at, as hashed_contexts gives it) with context, its words joined by blanks. Keys of docs are unique."""
    rest = [c for c in rows.columns if c != "at"]
    asked = rows.select(F.col(f"at.{key}").alias(key), F.col("at.sentence").alias("sentence"), F.struct(F.col("at.size").alias("__size"), *rest).alias("r"))
    # one row a sentence: its words are split off once, whatever is asked of it
    asked = asked.groupBy(key, "sentence").agg(F.collect_list("r").alias("r"))
    said = docs.select(key, F.posexplode(sentences(F.col(text))).alias("sentence", "s"))
    both = said.join(asked, [key, "sentence"]).select(words(F.col("s")).alias("t"), "r")
    both = both.select("t", F.explode("r").alias("r"))
    return both.select(*[f"r.{c}" for c in rest], F.array_join(F.slice("t", F.lit(1), F.col("r.__size")), " ").alias("context"))


def context_counts(pairs: DataFrame) -> DataFrame:
    """(context, next_word, n), combined before the shuffle."""
    return pairs.groupBy("context", "next_word").agg(F.count("*").alias("n"))


def context_statistics(counts: DataFrame) -> DataFrame:
    """(context, n, distinct_next, frequency, log_per_million) of each context; the total is one broadcast row."""
    per = counts.groupBy("context").agg(F.sum("n").alias("n"), F.count("*").alias("distinct_next"))
    total = counts.agg(F.sum("n").alias("total"))
    out = per.crossJoin(F.broadcast(total))
    share = F.col("n") / F.col("total")
    return out.select("context", "n", "distinct_next", share.alias("frequency"), F.when(F.col("n") > 0, F.log10(share * 1e6)).otherwise(F.lit(float("-inf"))).alias("log_per_million"))


def word_frequencies(docs: DataFrame, text: str = "text", most: int | None = None) -> DataFrame:
    """(word, n, frequency, log_per_million) of each word."""
    tokens = words(F.col(text))
    if most is not None:
        tokens = F.slice(tokens, 1, most)
    counts = docs.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return counts.crossJoin(F.broadcast(total)).select("word", "n", share.alias("frequency"), F.log10(share * 1e6).alias("log_per_million"))


def top_contexts(counts: DataFrame, targets: DataFrame | None = None, top: int = 5, least_words: int = 1, order: str = "count", seed: int = 0) -> DataFrame:
    """(word, context, n, rank): the `top` contexts of each target word that have least_words words, by count or by a seeded hash; of equals the first in text order.

    targets (word): all words without it. Catalyst limits groups before it sorts them whole.
    """
    rows = counts.withColumnRenamed("next_word", "word").where(F.size(F.split("context", " ")) >= least_words)
    if targets is not None:
        rows = rows.join(targets.select("word").distinct(), "word", "left_semi")
    by = [F.desc("n"), F.asc("context")] if order == "count" else [F.xxhash64("word", "context", F.lit(seed)), F.asc("context")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy(*by))).where(F.col("rank") <= top)


#: Words that may be broadcast.
SMALL = 1_000_000


def small(words_: DataFrame) -> DataFrame:
    """words_, with a hint to broadcast it if it has SMALL rows at most; they are counted first."""
    return F.broadcast(words_) if words_.count() <= SMALL else words_


def vocabulary_filter(rows: DataFrame, key: str, texts: list[str], vocabulary: DataFrame, lower: bool = True, tokens: Callable[[Column], Column] = words) -> DataFrame:
    """Rows of which every word in all the texts is in the vocabulary (word).

    tokens: how a text is cut, at white space, or `text.treebank_words` for words apart from
    their marks. Each row's words are distinct before they are looked up; a vocabulary of SMALL
    words at most is broadcast, so that words aren't shuffled; a larger one is joined. Null
    texts have no words, so a row of nulls is kept.
    """
    cut = [tokens(F.lower(t) if lower else F.col(t)) for t in texts]
    every = F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in cut]))
    known = vocabulary.select("word").where("word is not null").distinct()
    strange = rows.select(key, F.explode(every).alias("word")).join(small(known), "word", "left_anti").select(key).distinct()
    return rows.join(strange, key, "left_anti")


def shared_words_filter(rows: DataFrame, key: str, text: str, lower: bool = True, tokens: Callable[[Column], Column] = words) -> DataFrame:
    """Rows of which every word is in a row with another key too: vocabulary_filter with the vocabulary of the rows' own words in two keys or more.

    Texts are cut once: a word's least and greatest key tell whether it has two, and if not, which row it makes strange.
    """
    # outer, as the filter that Spark puts below an inner explode would cut each text a second time
    every = F.explode_outer(F.array_distinct(tokens(F.lower(text) if lower else F.col(text))))
    own = rows.select(key, every.alias("word")).where("word is not null")
    strange = own.groupBy("word").agg(F.min(key).alias(key), F.max(key).alias("__most")).where(F.col(key).eqNullSafe(F.col("__most")))
    return rows.join(strange.select(key).distinct(), key, "left_anti")


def in_dictionary(words_: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """Rows whose word is in a spelling dictionary (word), in any case of letters."""
    known = small(dictionary.select(F.lower("word").alias("__w")).distinct())
    return words_.join(known, F.lower(F.col(word)) == F.col("__w"), "left_semi")


#: Between the words of a sentence while sentences are sorted: less than any other byte, so sentences that begin with the same words stand next to each other.
_GAP = "\x00"


def gapped_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence, s): the sentences of two words or more, their words parted by 0 bytes; a word's own bytes 0 and 1 are written as 1 1 and 1 2."""
    rows = docs.select(key, F.posexplode(sentences(F.col(text))).alias("sentence", "s")).select(key, "sentence", words(F.col("s")).alias("t")).where(F.size("t") > 1)
    bare = F.replace(F.replace(F.array_join("t", " "), F.lit("\x01"), F.lit("\x01\x02")), F.lit(_GAP), F.lit("\x01\x01"))
    return rows.select(key, "sentence", F.replace(bare, F.lit(" "), F.lit(_GAP)).alias("s"))


def _combined(key: str) -> Callable:
    """Equal sentences of an Arrow batch as one row, with their number and the place of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch]).sort_by([("s", "ascending"), (key, "ascending"), ("sentence", "ascending")])
            yield from _distinct(rows.append_column("w", pa.array(np.ones(len(rows), np.int64)))).to_batches()

    return run


def _distinct(rows: pa.Table) -> pa.Table:
    """rows (s, w, ...), sorted by s, with one row for each s: its first, and the sum of w."""
    if not len(rows):
        return rows
    s = rows["s"].combine_chunks()
    first = np.flatnonzero(np.concatenate([[True], pc.not_equal(s[1:], s[:-1]).to_numpy(zero_copy_only=False)]))
    w = np.add.reduceat(rows["w"].to_numpy(), first)
    at = rows.schema.get_field_index("w")
    return rows.take(pa.array(first)).set_column(at, "w", pa.array(w))


def sorted_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence, s, w), those of equal first two words in one partition and sorted: distinct sentences of a batch of texts, how often they stand there, and where first."""
    rows = gapped_sentences(docs, key, text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    rows = rows.mapInArrow(_combined(key), f"{kinds}, w long")
    return rows.repartition(F.xxhash64(F.substring_index("s", _GAP, 2))).sortWithinPartitions("s", key, "sentence")


#: Bytes of sentences that are handled at once; all that begin with the same two words are.
TRIE_BYTES = 8 << 20


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Distinct sentences in tables of about TRIE_BYTES, cut where the first two words change."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        own = _distinct(pa.Table.from_batches([batch]))
        if size >= TRIE_BYTES:
            begin = pc.list_slice(pc.split_pattern(own["s"].combine_chunks(), _GAP, max_splits=2), 0, 2)
            begin = pc.binary_join(begin, _GAP)
            last = _GAP.join(held[-1]["s"][-1].as_py().split(_GAP)[:2])
            at = int(pc.index(pc.not_equal(begin, last), True).as_py())
            if at < 0:
                at = len(own)
            else:
                yield _distinct(pa.concat_tables([*held, own.slice(0, at)]))
                held, size, own = [], 0, own.slice(at)
        held.append(own)
        size += own.nbytes
    if held:
        yield _distinct(pa.concat_tables(held))


class _Trie:
    """The prefixes of sorted distinct sentences: how many sentences each begins, and where it stands first.

    low: words that a sentence shares with the one before or after it, the more of the two:
    longer prefixes are its own. Shorter ones are counted level by level, each level over
    the sentences that share so much.
    """

    def __init__(self, rows: pa.Table, key: str):
        data, offsets = _bytes(rows["s"])
        n = len(offsets) - 1
        start, end = offsets[:-1], offsets[1:]
        gaps = np.flatnonzero(data == 0)
        self.size = np.searchsorted(gaps, end) - np.searchsorted(gaps, start) + 1
        # bytes that neighbours share, in widths that double
        shared, live = np.zeros(max(n - 1, 0), np.int64), np.arange(max(n - 1, 0))
        most, at, width = np.minimum(end - start, np.append(end - start, 0)[1:])[: max(n - 1, 0)], 0, 32
        while len(live):
            # as many pairs at a time as a matrix of some MB takes
            keep = []
            for part in np.array_split(live, max(1, len(live) * width >> 22)):
                i = at + np.arange(width)
                ok = i[None, :] < most[part, None]
                a, b = (data[np.where(ok, start[part + k, None] + i, 0)] for k in (0, 1))
                same = ok & (a == b)
                run = np.where(same.all(1), width, np.argmin(same, 1))
                shared[part] += run
                keep.append(part[(run == width) & (most[part] > at + width)])
            live, at, width = np.concatenate(keep), at + width, width * 2
        # a word is shared if it ends in both where the bytes do
        stop = start[: max(n - 1, 0)] + shared
        whole = np.searchsorted(gaps, stop) - np.searchsorted(gaps, start[: max(n - 1, 0)])
        ends = lambda k: (start[k : n - 1 + k] + shared == end[k : n - 1 + k]) | (data[np.minimum(start[k : n - 1 + k] + shared, len(data) - 1)] == 0)
        lcp = np.concatenate([[0], whole + (ends(0) & ends(1)), [0]]) if n else np.zeros(1, np.int64)
        self.before = lcp[:-1]
        self.low = np.maximum(lcp[:-1], lcp[1:])
        self.w = rows["w"].to_numpy()
        order = pc.sort_indices(rows.select([key, "sentence"]), [(key, "ascending"), ("sentence", "ascending")]).to_numpy()
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        self.by_place = order

    def nodes(self, least: int) -> tuple[np.ndarray, ...]:
        """(row, level, n, place) of prefixes of `least` words or more: a sentence with it, its words, sentences that begin so, the first of them."""
        rows, levels, n, place = [], [], [], []
        for level in range(least, int(self.low.max(initial=0)) + 1):
            on = np.flatnonzero(self.low >= level)
            first = np.flatnonzero(self.before[on] < level)
            rows.append(on[first])
            levels.append(np.full(len(first), level))
            n.append(np.add.reduceat(self.w[on], first))
            place.append(np.minimum.reduceat(self.place[on], first))
        begin = np.maximum(self.low + 1, least)
        row, level = _spread(begin, self.size + 1)
        return tuple(np.concatenate(x) for x in ([*rows, row], [*levels, level], [*n, self.w[row]], [*place, self.place[row]]))

    def contexts(self, least: int) -> tuple[np.ndarray, ...]:
        """(row, level, n, distinct) of prefixes of `least` words or more that a word follows: how often one does, and how many do."""
        rows, levels, n, distinct = [], [], [], []
        for level in range(least, int(self.low.max(initial=0)) + 1):
            on = np.flatnonzero(self.low >= level)
            first = np.flatnonzero(self.before[on] < level)
            longer = self.size[on] > level
            times = np.add.reduceat(self.w[on] * longer, first)
            kinds = np.add.reduceat((longer & (self.before[on] <= level)).astype(np.int64), first)
            keep = times > 0
            rows.append(on[first][keep])
            levels.append(np.full(int(keep.sum()), level))
            n.append(times[keep])
            distinct.append(kinds[keep])
        row, level = _spread(np.maximum(self.low + 1, least), self.size)
        return tuple(np.concatenate(x) for x in ([*rows, row], [*levels, level], [*n, self.w[row]], [*distinct, np.ones(len(row), np.int64)]))


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, each of begin[k] to end[k] - 1)."""
    size = np.maximum(end - begin, 0)
    k = np.repeat(np.arange(len(size)), size)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size) + begin[k]


def _bytes(s: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    s = s.combine_chunks().cast(pa.large_string())
    offsets = np.frombuffer(s.buffers()[1], np.int64)[s.offset : s.offset + len(s) + 1]
    return np.frombuffer(s.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _said(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(sentences as they were, with blanks between words; where each word ends in them; the first word of each sentence)."""
    data, offsets = _bytes(rows["s"])
    own = data.tobytes()
    if 1 in data:
        mark = {b"\x00": b" ", b"\x01\x01": b"\x00", b"\x01\x02": b"\x01"}
        said = [re.sub(rb"\x00|\x01[\x01\x02]", lambda m: mark[m[0]], own[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in said])])
        own = b"".join(said)
    else:
        own = own.replace(b"\x00", b" ")
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(own)])
    gaps = np.flatnonzero(np.frombuffer(own, np.uint8) == 32)
    ends = np.sort(np.concatenate([gaps, offsets[1:]]))  # a sentence's last word ends where the next begins
    first = np.searchsorted(gaps, offsets[:-1]) + np.arange(len(offsets) - 1)
    return out.cast(pa.binary()), ends - np.repeat(offsets[:-1], np.diff(np.append(first, len(ends)))), first


def _written(key: str, least: int, pick: str) -> Callable:
    """Sentences with an array of what begins them: where its words end, and two numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            trie = _Trie(rows, key)
            row, level, a, b = getattr(trie, pick)(least)
            order = np.argsort(row, kind="stable")
            row, level, a, b = row[order], level[order], a[order], b[order]
            said, ends, first = _said(rows)
            at = first[row] + level - 1
            to = ends[at]
            context = ends[at - 1] if pick == "nodes" else to
            offsets = np.searchsorted(row, np.arange(len(rows) + 1)).astype(np.int32)
            item = pa.StructArray.from_arrays([pa.array(context.astype(np.int32)), pa.array(to.astype(np.int32)), pa.array(a), pa.array(b)], ["c", "e", "a", "b"])
            out = pa.RecordBatch.from_arrays([said, pa.ListArray.from_arrays(pa.array(offsets), item)], names=["s", "nodes"])
            for k in range(0, len(rows), 2000):
                yield out.slice(k, 2000)

    return run


_NODES = "s binary, nodes array<struct<c: int, e: int, a: long, b: long>>"


def _part(start: Column | int, length: Column) -> Column:
    return F.substring("s", F.lit(start) if isinstance(start, int) else start, length).cast("string")


def written_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(context, next_word, n): each beginning of a sentence, however long, with the word after it and how often it stands there.

    Sentences, not contexts, are shuffled, once: those that begin with the same two words are
    sorted in one task, which counts the prefixes that neighbours share; contexts are cut from
    their sentence as they are put out.
    """
    rows = sorted_sentences(docs, key, text).mapInArrow(_written(key, 2, "nodes"), _NODES).select("s", F.explode("nodes").alias("x"))
    return rows.select(_part(1, F.col("x.c")).alias("context"), _part(F.col("x.c") + 2, F.col("x.e") - F.col("x.c") - 1).alias("next_word"), F.col("x.a").alias("n"))


def written_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(context, n, distinct_next, frequency, log_per_million) of each context of written_counts; those of one word are added up over tasks, the total is one broadcast row."""
    rows = sorted_sentences(docs, key, text)
    long = rows.mapInArrow(_written(key, 2, "contexts"), _NODES).select("s", F.explode("nodes").alias("x")).select(_part(1, F.col("x.e")).alias("context"), F.col("x.a").alias("n"), F.col("x.b").alias("distinct_next"))
    two = rows.groupBy(F.substring_index("s", _GAP, 2).alias("two")).agg(F.sum("w").alias("n"))
    one = two.groupBy(F.substring_index("two", _GAP, 1).alias("one")).agg(F.sum("n").alias("n"), F.count("*").alias("distinct_next"))
    plain = F.replace(F.replace("one", F.lit("\x01\x01"), F.lit(_GAP)), F.lit("\x01\x02"), F.lit("\x01"))
    per = long.unionByName(one.select(plain.alias("context"), "n", "distinct_next"))
    gaps = F.length("s") - F.length(F.replace("s", F.lit(_GAP), F.lit("")))
    share = F.col("n") / F.col("total")
    out = per.crossJoin(F.broadcast(rows.agg(F.sum(gaps * F.col("w")).alias("total"))))
    return out.select("context", "n", "distinct_next", share.alias("frequency"), F.log10(share * 1e6).alias("log_per_million"))


def best_contexts(docs: DataFrame, targets: DataFrame | None = None, top: int = 5, least_words: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As top_hashed, from sorted sentences: (word, n, rank, at). Each task puts out the `top` of each word of the sentences it holds at once, so that few rows are shuffled."""
    rows = sorted_sentences(docs, key, text)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            trie = _Trie(rows, key)
            row, level, n, place = trie.nodes(max(2, least_words + 1))
            if not len(row):
                continue
            said, ends, first = _said(rows)
            at = first[row] + level - 1
            own = np.frombuffer(said.buffers()[2], np.uint8)
            start = np.frombuffer(said.buffers()[1], np.int32)[: len(said)].astype(np.int64)[row]
            a, b = start + ends[at - 1] + 1, start + ends[at]
            length = b - a
            at = np.cumsum(length) - length
            word = own[np.arange(int(length.sum())) - np.repeat(at - a, length)]
            word = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(np.append(at, length.sum()).astype(np.int64)), pa.py_buffer(word)]).dictionary_encode()
            of = word.indices.to_numpy()
            order = np.lexsort((level, place, -n, of))
            group = of[order]
            begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
            best = order[rank < top]
            stood = pa.array(trie.by_place[place[best]])
            names = word.dictionary.take(pa.array(of[best])).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(n[best]), rows[key].combine_chunks().take(stood), rows["sentence"].combine_chunks().take(stood), pa.array((level[best] - 1).astype(np.int32))], names=["word", "n", key, "sentence", "size"])

    found = rows.mapInArrow(run, f"word string, n long, `{key}` {kind}, sentence int, size int")
    found = found.select("word", "n", F.struct(key, "sentence", "size").alias("at"))
    if targets is not None:
        found = found.join(targets.select("word").distinct(), "word", "left_semi")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), F.asc("at")))).where(F.col("rank") <= top)
