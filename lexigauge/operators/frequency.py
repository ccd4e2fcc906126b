"""Word frequencies from published lists: Zipf values of words, of numbers and of what a list holds only in parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words as cut
from .ngrams import small

#: How often a number begins with each digit, and a four-digit number that may be a year: the logarithm of a share at and after a year, its fall a year before it, its fall a year beyond some more, and the share of such numbers that are no years. Fixed values of the published lists' rule for digits.
FIRST_DIGITS = (0.009, 0.300, 0.175, 0.124, 0.096, 0.078, 0.066, 0.057, 0.050, 0.045)
YEAR, YEAR_TOP, YEAR_RISE, YEAR_PLATEAU, YEAR_FALL, NO_YEAR = 2019, -1.9185, 0.0083, 20, 0.2, 0.1
#: A number of several digits, which lists hold by its shape: each digit as 0. Fixed value.
NUMBER = r"\d[\d.,]+"
#: Words run together in these languages' texts: each part beyond the first makes a word ten times as rare. Fixed value.
JOINED = ("zh", "ja")
#: Parts of a word: runs of letters, marks and digits, with an apostrophe or the marks of a number inside.
PART = r"\d[\d.,]*\d|[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}\p{N}]+)*"


def shape(word: Column) -> Column:
    """The word with each digit of its numbers of several digits as 0."""
    found = F.regexp_extract_all(word, F.lit(NUMBER), F.lit(0))
    parts = F.split(word, NUMBER, -1)
    zeros = F.concat(F.transform(found, lambda x: F.regexp_replace(x, r"\d", "0")), F.array(F.lit("")))
    return F.array_join(F.transform(F.arrays_zip(parts.alias("p"), zeros.alias("z")), lambda x: F.concat(x["p"], x["z"])), "")


def number_share(word: Column) -> Column:
    """The share of the numbers of a word's shape that are these: 1 for words without any.

    A number goes by its first digit and its length; four digits may be a year too, whose
    share rises slowly to YEAR, stays for YEAR_PLATEAU years and falls fast.
    """

    def first(x: Column) -> Column:
        digit = F.element_at(F.array(*map(F.lit, FIRST_DIGITS)), F.substring(x, 1, 1).cast("int") + 1)
        return digit / F.pow(F.lit(10.0), F.length(x) - 1)

    def share(x: Column) -> Column:
        year = x.try_cast("int")
        late = year - (YEAR + YEAR_PLATEAU)
        log = F.when(year <= YEAR, YEAR_TOP - YEAR_RISE * (YEAR - year)).when(late <= 0, F.lit(YEAR_TOP)).otherwise(YEAR_TOP - YEAR_FALL * late)
        return F.when(x.rlike(r"^\d{4}$"), F.pow(F.lit(10.0), log) + NO_YEAR * first(x)).otherwise(first(x))

    return F.aggregate(F.regexp_extract_all(word, F.lit(NUMBER), F.lit(0)), F.lit(1.0), lambda a, x: a * share(x))


def significant(x: Column, digits: int = 3) -> Column:
    """x rounded to some significant digits; 0 stays."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(x)))
    return F.when(x > 0, F.rint(x * scale) / scale).otherwise(0.0)


def word_counts(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, word, n) of each word between white space; each text is cut once."""
    # outer, as the filter that Spark puts below an inner explode would cut each text a second time
    tokens = docs.select(*keys, F.explode_outer(cut(F.col(text))).alias("word")).where("word is not null")
    return tokens.groupBy(*keys, "word").agg(F.count("*").alias("n"))


def distinct_zipf(keys: DataFrame, lists: DataFrame, language: str | None = None, least: float = 0.0, counted: bool = False) -> DataFrame:
    """(word[, language], freq): zipf of words that are distinct, nulls among them, each one row.

    counted: the lists are counted, to be broadcast if they are small; else Spark decides it
    when they are made, so that lists which are costly to make are made once.
    """
    own = [language] if language else []
    # outer, as the filter that Spark puts below an inner explode would cut each word a second time
    several = F.regexp_extract_all(F.lower("word"), F.lit(PART), F.lit(0))
    parts = keys.select("word", *own, F.explode_outer(several).alias("__part"))
    parts = parts.select("word", *own, shape(F.col("__part")).alias("__shape"), number_share(F.col("__part")).alias("__share"))
    table = lists.groupBy(*(["list"] if language else []), F.col("word").alias("__shape")).agg(F.max("frequency").alias("__f"))
    if language:
        table = table.withColumnRenamed("list", language)
    found = parts.join(small(table) if counted else table, [*own, "__shape"], "left")
    # a part that isn't listed makes the word unknown, and a word without parts has a null one
    f = F.col("__f") * F.col("__share")
    whole = found.groupBy("word", *own).agg(F.count("*").alias("__n"), F.count("__f").alias("__known"), F.sum(1 / f).alias("__rare"))
    value = 1 / F.col("__rare")
    if language:
        value = F.when(F.col(language).isin(*JOINED), value / F.pow(F.lit(10.0), F.col("__n") - 1)).otherwise(value)
    # in columns of their own, as they stand for large expressions that are read several times
    whole = whole.select("word", *own, "__n", "__known", value.alias("__value"))
    whole = whole.select("word", *own, (F.col("__n") == F.col("__known")).alias("__whole"), significant(F.col("__value")).alias("__value"))
    score = F.when(F.col("__whole") & (F.col("__value") > 0), F.greatest(F.round(F.log10("__value") + 9, 2), F.lit(least))).otherwise(F.lit(least))
    return whole.select("word", *own, score.alias("freq"))


def zipf(words: DataFrame, lists: DataFrame, language: str | None = None, least: float = 0.0) -> DataFrame:
    """words (word[, language]) with freq: the Zipf value of each, the logarithm of its occurrences in a thousand million words, to two places.

    lists: (list, word, frequency), as frequency_lists reads them; `language` names the column
    that tells which list a word is looked up in, else there is one list only. A word is
    looked up in lower case by its parts (runs of letters and digits): of one part its
    frequency, of several 1 / (1/f + 1/g + ...), tenfold rarer for each further part in
    languages without spaces. Numbers of several digits are looked up by their shape and
    take a share of it. A word with a part that isn't listed, without parts, or null has
    `least`. Frequencies have three significant digits.

    Distinct words only are looked up: lists of a million words at most are broadcast (they
    are counted), larger ones joined. Of repeated entries in a list the highest counts.
    """
    own = [language] if language else []
    whole = distinct_zipf(words.select("word", *own).distinct(), lists, language, least, counted=True)
    return words.join(whole, ["word", *own], "left").withColumn("freq", F.coalesce("freq", F.lit(least)))
