"""What models read, prepared without a model: variants with masked tokens, windows over passages, and batches under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, tokens
from .frames import numbered

KINDS = ("causal", "masked", "next", "encoder", "whole")


def phrase_places(offsets: Column, start: Column) -> Column:
    """Places of the tokens that end after the phrase's first character. offsets: array<struct<start,end>>."""
    return F.filter(F.transform(offsets, lambda o, i: F.when(o["end"] > start, i)), lambda i: i.isNotNull())


def masked_inputs(items: DataFrame, kind: str, mask: int | None = None, start: int | None = None) -> DataFrame:
    """Rows that a model reads for the phrases of items: (item_id, cand_idx, place, inputs, read_at, targets[, decoder]).

    items: (item_id, cand_idx, ids array<int>, offsets array<struct<start,end>>, phrase_start),
    phrase_start being the character at which the phrase begins.

    causal: one row, nothing masked, all places of the phrase as targets; a token's score is
    read one place before it, and a first token without one has none. masked: a row for each
    token of the phrase with that token masked, read at its place. next: the same, read one
    place before; a phrase token at place 0 needs a start token before the text (start), else it
    has no row. encoder: as masked, with (start, mask) for the decoder, read at its mask.
    whole: one row with all tokens of the phrase masked, read at their places.

    Rows keep nulls' items out only where there is nothing to read: an item without tokens in
    its phrase, or with null ids or offsets, has no row. All are Columns; nothing is shuffled.
    """
    if kind not in KINDS:
        raise ValueError(f"no kind {kind!r} of inputs; one of {', '.join(KINDS)}")
    if kind != "causal" and mask is None:
        raise ValueError(f"inputs of kind {kind!r} need a mask token")
    at = phrase_places(F.col("offsets"), F.col("phrase_start"))
    target = lambda at: F.transform(at, lambda i: F.get("ids", i))
    if kind in ("causal", "whole"):
        if kind == "causal" and start is None:
            at = F.filter(at, lambda i: i > 0)
        # as generated rows, so that the places aren't worked out again for each token; a filter would be pushed below
        rows = items.select("item_id", "cand_idx", "ids", "offsets", "phrase_start", F.explode(F.when(F.size(at) > 0, F.array(at))).alias("at"))
        if kind == "causal":
            before = 1 if start is None else 0  # a start token moves all places on by one
            inputs = F.col("ids") if start is None else F.concat(F.array(F.lit(start)), "ids")
            return rows.select("item_id", "cand_idx", F.lit(None).cast("int").alias("place"), inputs.alias("inputs"), F.transform("at", lambda i: i - before).alias("read_at"), target(F.col("at")).alias("targets"))
        return rows.select("item_id", "cand_idx", F.lit(None).cast("int").alias("place"), F.zip_with("ids", "offsets", lambda x, o: F.when(o["end"] > F.col("phrase_start"), F.lit(mask)).otherwise(x)).alias("inputs"), F.col("at").alias("read_at"), target(F.col("at")).alias("targets"))
    if kind == "next" and start is None:
        at = F.filter(at, lambda i: i > 0)
    rows = items.select("item_id", "cand_idx", "ids", F.explode(at).alias("place"))
    one = F.array("place")
    inputs = F.transform("ids", lambda x, i: F.when(i == F.col("place"), F.lit(mask)).otherwise(x))
    if kind == "next" and start is not None:
        inputs = F.concat(F.array(F.lit(start)), inputs)
    read = {"masked": one, "next": F.array(F.col("place") - (1 if start is None else 0)), "encoder": F.array(F.lit(1 if start is not None else 0))}[kind]
    out = [F.col("item_id"), F.col("cand_idx"), F.col("place"), inputs.alias("inputs"), read.alias("read_at"), target(one).alias("targets")]
    if kind == "encoder":
        out.append((F.array(F.lit(start), F.lit(mask)) if start is not None else F.array(F.lit(mask))).alias("decoder"))
    return rows.select(*out)


def prefix_inputs(items: DataFrame, mask: int, start: int, first: int | None = None, last: int | None = None) -> DataFrame:
    """(item_id, cand_idx, inputs, decoder, targets): the prefix with a mask after it for the encoder, between the tokens first and last if there are such, and for the decoder start, mask and the completion but for its last token.

    items: (item_id, cand_idx, prefix_ids, completion_ids); a null prefix is empty, an item
    without a completion has no row.
    """
    around = lambda t: F.array(F.lit(t)) if t is not None else F.array().cast("array<int>")
    prefix = F.coalesce("prefix_ids", F.array().cast("array<int>"))
    shifted = F.slice("completion_ids", F.lit(1), F.size("completion_ids") - 1)
    return items.where(F.size("completion_ids") > 0).select("item_id", "cand_idx", F.concat(around(first), prefix, around(mask), around(last)).alias("inputs"), F.concat(around(start), around(mask), shifted).alias("decoder"), F.col("completion_ids").alias("targets"))


def token_batches(rows: DataFrame, length: Column, order: Column, budget: int) -> DataFrame:
    """rows with (length, batch, slot): batches of rows of one length, so that none is padded, each of `budget` tokens at most (one row at least).

    A batch is named by its length and its number; slot counts from 0 in it, by `order`. Rows
    are numbered in ranges of the order (one column of numbers or texts), so a length that a third of all rows have is dealt
    by several tasks.
    """
    rows = rows.withColumn("length", F.greatest(length, F.lit(1)))
    out = numbered(rows, ["length"], order, "__n")
    per = F.greatest(F.floor(F.lit(budget) / F.col("length")), F.lit(1))
    place = F.col("__n") - 1
    return out.withColumn("batch", F.floor(place / per)).withColumn("slot", (place % per).cast("int")).drop("__n")


def passage_windows(words: DataFrame, ends: DataFrame, budget: int) -> DataFrame:
    """(passage, kind, a, b, words array<struct<word, places>>): which stretches of a passage's tokens are read, and which words each serves.

    words: (passage, word, full_text, marked), the word's text between marks as in
    prefix*target*; ends: (passage, ends array<int>), the last character of each of the
    passage's tokens, not falling. A token belongs to the word in whose span it ends. kind:

    window: tokens a to b (without b). The head, of `budget` tokens at most, serves all words
    that end in it; each further word is at the end of a window of its own, of the last
    `budget` tokens up to it, or of all its own tokens where they are more. Words with one
    span share a window. alone: words of a passage in which any mark doesn't fit the
    passage's longest text; they are read one by one, each with its own prefix. none: words
    that no token ends in.

    Every word is in exactly one row. Null marks don't fit; a passage without tokens has its
    words in none. A passage's words and tokens are bounded by its text; passages are joined
    and grouped by their key.
    """
    prefix, target = text.starred(F.col("marked"))
    full = words.groupBy("passage").agg(F.max_by("full_text", F.length("full_text")).alias("text"))
    rows = words.join(full, "passage").withColumn("start", F.length(prefix)).withColumn("end", F.length(prefix) + F.length(target))
    fits = F.coalesce(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == target, F.lit(False))
    rows = rows.select("passage", "word", "start", "end", fits.alias("fits"))
    whole = rows.groupBy("passage").agg(F.min("fits").alias("all_fit"))
    rows = rows.join(whole, "passage").join(ends, "passage", "left")
    own = F.coalesce("ends", F.array().cast("array<int>"))
    rows = rows.withColumn("places", tokens.word_positions(own, F.col("start"), F.col("end"))).withColumn("w", tokens.scoring_window(F.col("places"), F.size(own), budget))
    kind = F.when(~F.col("all_fit"), "alone").when(F.col("w").isNull(), "none").otherwise("window")
    read = kind == "window"
    rows = rows.select("passage", kind.alias("kind"), F.when(read, F.col("w.a")).alias("a"), F.when(read, F.col("w.b")).alias("b"), F.struct("word", F.when(read, F.col("places")).alias("places")).alias("own"))
    return rows.groupBy("passage", "kind", "a", "b").agg(F.sort_array(F.collect_list("own")).alias("words"))
