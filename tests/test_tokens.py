import pytest
from pyspark.sql import functions as F

from lexigauge.functions import tokens
from lexigauge.operators import decode, metrics


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_offsets(spark):
    pairs = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 3), (3, 5), (5, 9))])
    assert one(spark, tokens.phrase_mask(pairs, F.lit(4))) == [0, 1, 1]
    ends = F.array(*map(F.lit, (3, 4, 9, 9, 12)))
    assert one(spark, tokens.word_positions(ends, F.lit(3), F.lit(9))) == [1, 2, 3]
    assert one(spark, tokens.word_positions(ends, F.lit(5), F.lit(8))) == []


@pytest.mark.parametrize(("positions", "want"), [([1, 2], (0, 4)), ([3], (0, 4)), ([5], (2, 6)), ([4, 5, 6, 7, 8], (4, 9))])
def test_windows(spark, positions, want):
    w = one(spark, tokens.scoring_window(F.array(*map(F.lit, positions)), F.lit(10), 4))
    assert (w.a, w.b) == want


def test_lists_and_products(spark):
    ids = F.array(*map(F.lit, (5, 6, 7)))
    assert one(spark, tokens.with_start(ids, 1)) == [1, 5, 6, 7]
    assert one(spark, tokens.with_start(ids, 1, 2)) == [6, 7] and one(spark, tokens.with_start(ids, 1, 9)) == [1, 5, 6, 7]
    df = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", 0.0), ("b", 0.3), ("c", None)], "w string, p double")
    got = {r.w: (r.p, r.n_tokens) for r in tokens.word_probability(df, ["w"]).collect()}
    assert got == {"a": (pytest.approx(0.25), 2), "b": (0.0, 2), "c": (None, 0)}
    assert one(spark, tokens.subword_count(F.lit(3), F.lit(3))) == 1
    assert [round(one(spark, tokens.cosine_schedule(F.lit(s), 10, 110, 0.1)), 6) for s in (0, 5, 10, 60, 110)] == [0, 0.5, 1, 0.55, 0.1]


def test_dataset_configs():
    assert decode.dataset_config("aialt/MuBench", "nl", "arc") == ("ARCEasyDataset_en_template_nl", {"sentence": "prompt", "label": "label"})
    assert decode.dataset_config("Davlan/sib200", "bg", scripts={"bg": "bul_Cyrl"})[0] == "bul_Cyrl"
    assert decode.dataset_config("CohereLabs/include-base-44", "nl")[0] == "Dutch"
    for bad in (("x", "en"), ("masakhane/afrixnli", "qq"), ("aialt/MuBench", "en", "x"), ("facebook/belebele", "en")):
        with pytest.raises(ValueError):
            decode.dataset_config(*bad)


def test_small_metrics(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5), ("a", 0.0, 0.5)], "k string, x double, y double")
    assert [r.c for r in df.select(metrics.combined(["x", "y"]).alias("c")).collect()] == [0.75, 0.25]
    assert metrics.categories(df, "k").first().n == 2
    images = spark.createDataFrame([(0, "i")], "position int, image string")
    assert {r.image for r in decode.with_images(spark.createDataFrame([(0,), (1,)], "idx int"), images, "idx").collect()} == {"i", None}
