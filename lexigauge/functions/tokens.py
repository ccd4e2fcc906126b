"""Arithmetic on token offsets and lists, of which models' inputs are made; no model is needed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def phrase_mask(offsets: Column, start: Column) -> Column:
    """1 for each token that ends after the phrase's first character, 0 for the others. offsets: array<struct<start,end>>."""
    return F.transform(offsets, lambda o: (o["end"] > start).cast("int"))


def word_ends(words: Column) -> Column:
    """Where each word ends in the words joined by single spaces, in characters; in time linear in their number."""

    @F.arrow_udf("array<int>")
    def running(lengths: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(lengths), 0).to_numpy(zero_copy_only=False)
        first = np.concatenate([[0], np.cumsum(size)])
        upto = np.concatenate([[0], np.cumsum(lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
        ends = upto[1:] - np.repeat(upto[first[:-1]], size) - 1
        return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ends, pa.int32()), mask=lengths.is_null())

    return running(F.transform(words, lambda w: F.length(w)))


def prefix_hashes(words: Column, base: int = 0x9E3779B97F4A7C15, seed: int = 0) -> Column:
    """A 64-bit hash of each prefix of an array of strings: of the first, the first two and so on; in time linear in its size. base is odd; two bases and seeds give 128 bits."""

    @F.arrow_udf("array<bigint>")
    def running(hashes: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(hashes), 0).to_numpy(zero_copy_only=False)
        first = np.concatenate([[0], np.cumsum(size)])
        own = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        up, down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(own), x, np.uint64)])) for x in (base, pow(base, -1, 1 << 64)))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up[: len(own)], dtype=np.uint64)])
        start = np.repeat(first[:-1], size)
        out = (total[1:] - total[start]) * down[start]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(out.view(np.int64)), mask=hashes.is_null())

    return running(F.transform(words, lambda w: F.xxhash64(w, F.lit(seed))))


def word_positions(ends: Column, start: Column, end: Column) -> Column:
    """Places of the tokens that end in (start, end]: each real token belongs to one word, and lone spaces between words to none. ends doesn't fall."""
    return F.filter(F.transform(ends, lambda e, i: F.when((e > start) & (e <= end), i)), lambda i: i.isNotNull())


def scoring_window(positions: Column, tokens: Column, budget: int) -> Column:
    """(a, b): the tokens that a model reads for a word: the head of the passage if it holds the word, else the last `budget` up to the word's end, and never less than the whole word. Null for a word without tokens."""
    last, first = F.element_at(positions, -1), F.get(positions, F.lit(0))
    end = last + 1
    head = F.struct(F.lit(0).alias("a"), F.least(tokens, F.lit(budget)).alias("b"))
    tail = F.struct(F.least(F.greatest(F.lit(0), end - budget), first).alias("a"), end.alias("b"))
    return F.when(F.size(positions) > 0, F.when(last < budget, head).otherwise(tail))


def with_start(ids: Column, start: int | None, keep: int | None = None) -> Column:
    """Token ids with the start token before them, and of those the last `keep`."""
    out = F.concat(F.array(F.lit(start)), ids) if start is not None else ids
    return F.when(F.size(out) > keep, F.slice(out, -keep, keep)).otherwise(out) if keep else out


def word_probability(tokens: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """(keys, p, surprisal, n_tokens): the product of a word's token probabilities, as a sum of logarithms. 0 if one is 0, null without any."""
    logs = F.sum(F.when(F.col(p) > 0, F.ln(p)).otherwise(F.when(F.col(p).isNotNull(), F.lit(float("-inf")))))
    return tokens.groupBy(*keys).agg(F.exp(logs).alias("p"), (0 - logs).alias("surprisal"), F.count(p).alias("n_tokens"))


def subword_count(with_word: Column, without: Column) -> Column:
    """Tokens that a word adds to a frame of words, 1 at least: from numbers of tokens with and without it."""
    return F.greatest(F.lit(1), with_word - without)


def cosine_schedule(step: Column, warmup: int, total: int, least: float) -> Column:
    """The factor of a learning rate: a linear rise over `warmup` steps, then half a cosine down to `least`."""
    progress = (step - warmup) / float(max(1, total - warmup))
    fall = F.greatest(F.lit(least), least + (1 - least) * 0.5 * (1 + F.cos(F.pi() * progress)))
    return F.when(step < warmup, step / float(max(1, warmup))).otherwise(fall)
