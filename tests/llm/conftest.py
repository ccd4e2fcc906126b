import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("size", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("hash", T.StringType())])
SYLLABLES = ["the", "er", "in", "st", "ou", "ble", "ha", "nd", "re", "th", "es", "ción", "über", "né"]


def prose(rng: random.Random, words: int) -> str:
    out = []
    for i in range(words):
        w = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
        out.append(w + rng.choice(["", "", "", ",", ".", ".\n", "!!"]))
    return " ".join(out)


def row(i, text, lang="en"):
    return (i, text, lang, "src0", None if text is None else len(text), "x", "y", 7, 3, "h")


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, odd characters, ties and repeated rows; other columns have names that operators use."""
    rng = random.Random(5)
    base = prose(rng, 120)
    texts = [None, "", " ", "\n\n", "a", "don't we'll 'S", "<|endoftext|> x<|endoftext|>", "aaaa" * 300, prose(rng, 4000), base, base, base + " end", base.upper(), "日本語テキスト ok", "x\x00y \x85z q\x1cw", "123 456½ ٣٤ ²", "🙂🙂 é", "the"]
    texts += [prose(rng, rng.randint(1, 300)) for _ in range(30)]
    rows = [row(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(texts)]
    rows.append((None, "null id " + base, None, None, None, None, None, None, None, None))
    return rows + [rows[9], rows[9], rows[0]]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
