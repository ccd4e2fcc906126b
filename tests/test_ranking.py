import math

import pytest
from pyspark.sql import functions as F

from lexigauge.functions import numeric
from lexigauge.operators import ranking

SCORES = "item_id int, cand_idx int, score double, gold boolean, unk boolean"


@pytest.fixture(scope="module")
def scores(spark):
    nan = float("nan")
    cases = {
        1: ([2.0, 1.0], 0, []), 2: ([1.0, 1.0], 0, []), 3: ([1.0, 1.0, 1.0], 2, []), 4: ([1.0, 2.0, 2.0], 0, []), 5: ([nan, -5.0], 0, []), 6: ([nan, -5.0], 1, []),
        7: ([3.0], 0, []), 8: ([2.0, 1.0], 0, [1]), 9: ([None, None], 1, []),
    }
    return spark.createDataFrame([(i, k, s, k == g, k in u) for i, (own, g, u) in cases.items() for k, s in enumerate(own)], SCORES)


def by_item(df, value):
    return {r.item_id: r[value] for r in df.collect()}


def test_tie_policies(scores):
    assert by_item(ranking.credit(scores, policy="fractional"), "credit") == {1: 1, 2: 0.5, 3: pytest.approx(1 / 3), 4: 0, 5: 0, 6: 1, 7: 1, 8: 1, 9: 0.5}
    assert by_item(ranking.credit(scores, policy="strict", unknown="unk"), "credit") == {1: 1, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1, 7: 1, 8: 0, 9: 0}
    assert by_item(ranking.credit(scores, policy="first"), "credit") == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1, 7: 1, 8: 1, 9: 0}
    assert by_item(ranking.pick(scores), "pred") == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 0, 8: 0, 9: 0}
    with pytest.raises(ValueError):
        ranking.credit(scores, policy="none")
    with pytest.raises(ValueError):
        ranking.pick(scores, policy="fractional")


def test_seeded_ties_are_repeatable_and_even(spark):
    rows = spark.range(4000).select(F.col("id").alias("item_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("cand_idx"), F.lit(1.0).alias("score"))
    a, b = (by_item(ranking.pick(rows.repartition(n), seed=3, policy="seeded"), "pred") for n in (1, 5))
    assert a == b and 0.45 < sum(a.values()) / len(a) < 0.55


def test_token_sums(spark):
    rows = spark.createDataFrame([(1, 0, 0, -1.0, True), (1, 0, 1, -3.0, True), (1, 0, 2, -9.0, False), (1, 1, 0, -4.0, False)], "item_id int, cand_idx int, pos int, logprob double, in_phrase boolean")
    assert sorted((r.cand_idx, r.score, r.n_tokens) for r in ranking.sum_in_phrase(rows).collect()) == [(0, -4.0, 2), (1, 0.0, 0)]
    assert sorted((r.cand_idx, r.score) for r in ranking.sum_in_phrase(rows, normalise=True).collect()) == [(0, -2.0), (1, 0.0)]


def test_averages(spark):
    rows = spark.createDataFrame([("a", 100.0, 1), ("b", 0.0, 3)], "uid string, accuracy double, total int")
    r = ranking.macro_micro(rows).first()
    assert (r.macro, r.micro) == (50.0, 25.0)
    rows = spark.createDataFrame([("regular", "r0", 1.0), ("regular", "r1", 0.0), ("ambiref", "a0", 1.0)], "split string, uid string, v double")
    assert ranking.nested_macro(rows, ["split", "uid"], "v").first().macro == 0.75
    splits = spark.createDataFrame([("regular_0_ops",), ("move_contents_1_ops",), ("x",)], "u string").select(ranking.operations_split(F.col("u")).alias("s"))
    assert [r.s for r in splits.collect()] == ["regular", "move_contents", None]
    t = spark.createDataFrame([(1.0, 50.0), (0.5, 60.0), (2.0, 60.0)], "temperature double, accuracy double")
    assert ranking.best_temperature(t).first().temperature == 0.5


def test_best_epoch(spark):
    rows = spark.createDataFrame([("t", e, s) for e, s in enumerate([0.5, 0.7, 0.7, 0.69, 0.9])], "task string, epoch int, score double")
    assert ranking.best_epoch(rows, ["task"]).first().epoch == 4
    r = ranking.best_epoch(rows, ["task"], patience=2).first()
    assert (r.epoch, r.score) == (1, 0.7)


def test_numbers(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    a = F.array(*map(F.lit, (1.0, 2.0, 3.0)))
    total = math.log(sum(math.exp(x / 2) for x in (1, 2, 3)))
    assert one(numeric.log_softmax(a, 2.0)) == pytest.approx([x / 2 - total for x in (1, 2, 3)])
    assert sum(one(numeric.softmax(a, 3.0))) == pytest.approx(1)
    assert one(numeric.cosine(a, a)) == pytest.approx(1)
    assert one(numeric.divergence(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.5), F.lit(0.5)))) == pytest.approx(math.log(2), abs=1e-6)
    assert numeric.temperatures(0.0, 0.2, 0.1) == pytest.approx([1e-6, 0.1, 0.2]) and numeric.temperatures(1.0) == [1.0]
    assert len(numeric.revisions(True)) == 19 and len(numeric.revisions(False)) == 28 and numeric.revisions(False)[-1] == "chck_1000M"
    assert numeric.t_test(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert numeric.correlation_test(0.9, 5) == pytest.approx(0.0373861, abs=1e-6)


def test_levels_from_one_shuffle(spark):
    rows = [(1, {"a": "x", "b": "p"}, True), (2, {"a": "x"}, False), (3, {"a": "y", "b": None}, True), (4, {}, True), (5, None, False), (6, {"a": ""}, True)]
    df = spark.createDataFrame([(*r, t) for r in rows for t in (0.5, 1.0)], "i int, meta map<string,string>, ok boolean, t double")
    got = {(r.level, r.t, r.key, r.value): (r.total, r.correct, r.accuracy) for r in ranking.levels(df, F.col("ok"), temperature="t").collect()}
    for t in (0.5, 1.0):
        assert got.pop(("all", t, None, None)) == (6, 4.0, 100 * 4.0 / 6)
        assert got.pop(("key", t, "a", None)) == (4, 3.0, 75.0) and got.pop(("key", t, "b", None)) == (2, 2.0, 100.0)
        assert got.pop(("value", t, "a", "x")) == (2, 1.0, 50.0) and got.pop(("value", t, "a", "y")) == (1, 1.0, 100.0) and got.pop(("value", t, "a", "")) == (1, 1.0, 100.0)
        assert got.pop(("value", t, "b", "p")) == (1, 1.0, 100.0) and got.pop(("value", t, "b", None)) == (1, 1.0, 100.0)
    assert not got
    plan = ranking.levels(df, F.col("ok"))
    plan.collect()
    assert plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
    assert {r.level: r.total for r in ranking.levels(df.where("false"), F.col("ok")).collect()} in ({}, {"all": None}, {"all": 0})
