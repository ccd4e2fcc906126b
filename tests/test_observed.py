"""Checks that ride on the write of predictions."""

import pytest

from lexigauge.operators import checks


def rows_of(spark, tmp_path, data, expected, kind="string"):
    df = spark.createDataFrame(data, f"uid string, place long, pred {kind}").repartition(4)
    df, found = checks.observed(df, expected)
    spark.sparkContext.setJobGroup("observed", "")
    try:
        df.write.parquet(str(tmp_path / "out"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("observed"))
        out = {r.uid: tuple(r)[1:] for r in checks.verdict(spark, found, expected).collect()}
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(data)
    return out, jobs


def test_every_fault_is_seen_in_the_write(spark, tmp_path):
    data = [("ok", k, "x") for k in range(70_000)] + [("few", k, "x") for k in range(4)] + [("twice", k % 9, "x") for k in range(10)] + [("far", k, "x") for k in (0, 1, 5)] + [("none", 0, None), ("none", 1, "x"), ("other", 0, "x"), (None, 0, "x")]
    out, jobs = rows_of(spark, tmp_path, data, [("ok", 70_000), ("few", 5), ("twice", 10), ("far", 3), ("none", 2), ("absent", 3), ("empty", 0)])
    # the shuffle that deals the rows out is a stage of its own under an adaptive plan; nothing reads them again
    assert jobs <= 2
    assert out == {
        "ok": (70_000, 70_000, 70_000, 0, "ok"), "few": (5, 4, 4, 0, "wrong size"), "twice": (10, 10, 9, 0, "repeated"), "far": (3, 3, 2, 0, "repeated"), "none": (2, 2, 2, 1, "no value"),
        "absent": (3, 0, 0, 0, "missing"), "empty": (0, 0, 0, 0, "ok"), None: (0, 2, 0, 0, "unknown"),
    }


def test_numbers_and_nothing(spark, tmp_path):
    out, _ = rows_of(spark, tmp_path, [("a", 0, 1.0), ("a", 1, float("nan"))], [("a", 2)], "double")
    assert out == {"a": (2, 2, 2, 1, "no value")}
    (tmp_path / "more").mkdir()
    out, _ = rows_of(spark, tmp_path / "more", [], [("a", 2)])
    assert out == {"a": (2, 0, 0, 0, "missing")}


@pytest.mark.parametrize("n", [checks.BITMAP - 1, checks.BITMAP, checks.BITMAP + 1])
def test_edges_of_bitmaps(spark, tmp_path, n):
    out, _ = rows_of(spark, tmp_path, [("a", k, "x") for k in range(n)], [("a", n)])
    assert out["a"] == (n, n, n, 0, "ok")
