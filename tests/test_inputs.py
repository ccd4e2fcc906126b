"""Masked inputs, batches and window plans against loops."""

import random

import pytest
from pyspark.sql import functions as F

from lexigauge.operators import inputs

ITEM = "item_id long, cand_idx int, ids array<int>, offsets array<struct<start:int,end:int>>, phrase_start int"
ROWS = [(1, 0, [11, 12, 13, 14], [(0, 2), (3, 5), (6, 8), (9, 12)], 6), (1, 1, [11, 15], [(0, 2), (3, 9)], 0), (2, 0, [], [], 0), (3, 0, None, None, 0), (4, 0, [7], [(0, 3)], 3)]


def read(df):
    return sorted(((r.item_id, r.cand_idx, -1 if r.place is None else r.place, r.inputs, r.read_at, r.targets) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ROWS, ITEM)


def test_four_kinds(items):
    assert read(inputs.masked_inputs(items, "masked", mask=99)) == [(1, 0, 2, [11, 12, 99, 14], [2], [13]), (1, 0, 3, [11, 12, 13, 99], [3], [14]), (1, 1, 0, [99, 15], [0], [11]), (1, 1, 1, [11, 99], [1], [15])]
    assert read(inputs.masked_inputs(items, "next", mask=99)) == [(1, 0, 2, [11, 12, 99, 14], [1], [13]), (1, 0, 3, [11, 12, 13, 99], [2], [14]), (1, 1, 1, [11, 99], [0], [15])]
    assert read(inputs.masked_inputs(items, "next", mask=99, start=1))[2] == (1, 1, 0, [1, 99, 15], [0], [11])
    assert read(inputs.masked_inputs(items, "causal")) == [(1, 0, -1, [11, 12, 13, 14], [1, 2], [13, 14]), (1, 1, -1, [11, 15], [0], [15])]
    assert read(inputs.masked_inputs(items, "causal", start=1))[1] == (1, 1, -1, [1, 11, 15], [0, 1], [11, 15])
    assert read(inputs.masked_inputs(items, "whole", mask=99)) == [(1, 0, -1, [11, 12, 99, 99], [2, 3], [13, 14]), (1, 1, -1, [99, 99], [0, 1], [11, 15])]
    rows = inputs.masked_inputs(items, "encoder", mask=99, start=1).where("item_id = 1 and cand_idx = 0").orderBy("place").collect()
    assert [(r.inputs, r.decoder, r.read_at, r.targets) for r in rows] == [([11, 12, 99, 14], [1, 99], [1], [13]), ([11, 12, 13, 99], [1, 99], [1], [14])]
    assert inputs.masked_inputs(items, "encoder", mask=99).first().decoder == [99]
    with pytest.raises(ValueError):
        inputs.masked_inputs(items, "other", mask=1)
    with pytest.raises(ValueError):
        inputs.masked_inputs(items, "masked")


def test_prefix_inputs(spark):
    df = spark.createDataFrame([(1, 0, [5, 6], [7, 8, 9]), (2, 0, None, [7]), (3, 0, [5], []), (4, 0, [5], None)], "item_id int, cand_idx int, prefix_ids array<int>, completion_ids array<int>")
    got = {r.item_id: (r.inputs, r.decoder, r.targets) for r in inputs.prefix_inputs(df, 99, 1, 2, 3).collect()}
    assert got == {1: ([2, 5, 6, 99, 3], [1, 99, 7, 8], [7, 8, 9]), 2: ([2, 99, 3], [1, 99], [7])}
    assert inputs.prefix_inputs(df, 99, 1).where("item_id = 1").first().inputs == [5, 6, 99]


def test_batches(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 2, 3, 7, 40, 7, 7, 7])) for i in range(400)] + [(1000, 0), (1001, None)]
    got = inputs.token_batches(spark.createDataFrame(rows, "i int, n int").repartition(5), F.col("n"), F.col("i"), 20).collect()
    assert len(got) == len(rows)
    batches = {}
    for r in got:
        batches.setdefault((r.length, r.batch), []).append((r.slot, r.i))
    for (length, _), own in batches.items():
        assert len(own) * length <= max(20, length) and [s for s, _ in sorted(own)] == list(range(len(own)))
    for length in {r.length for r in got}:
        order = [i for b in sorted(b for x, b in batches if x == length) for _, i in sorted(batches[length, b])]
        assert order == sorted(order) and len({b for x, b in batches if x == length}) == -(-len(order) // max(1, 20 // length))


def plan(passage, words, ends, budget):
    """The plan of one passage in a loop."""
    full = max((f for _, f, _ in words), key=len)
    spans = []
    for w, _, marked in words:
        parts = marked.split("*") if marked is not None else []
        fits = len(parts) > 1 and full[len(parts[0]) : len(parts[0]) + len(parts[1])] == parts[1]
        spans.append((w, len(parts[0]), len(parts[0]) + len(parts[1])) if fits else None)
    if None in spans:
        return {(passage, "alone", None, None): sorted(w for w, _, _ in words)}
    out = {}
    for w, lo, hi in spans:
        places = [i for i, e in enumerate(ends) if lo < e <= hi]
        if not places:
            key = (passage, "none", None, None)
        elif places[-1] < budget:
            key = (passage, "window", 0, min(len(ends), budget))
        else:
            key = (passage, "window", min(max(0, places[-1] + 1 - budget), places[0]), places[-1] + 1)
        out.setdefault(key, []).append(w)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("budget", [1, 3, 5, 100])
def test_window_plans(spark, budget):
    rng = random.Random(budget)
    words, ends, want = [], [], {}
    for p in range(12):
        texts = ["".join(rng.choice("abc日") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 14))]
        full, at, own, tokens = " ".join(texts), 0, [], []
        for w, t in enumerate(texts):
            own.append((w, full, full[:at] + "*" + t + "*" + full[at + len(t) :]))
            k = at
            while k < at + len(t):  # tokens of 1 to 4 characters
                k = min(at + len(t), k + rng.randint(1, 4))
                tokens.append(k)
            at += len(t) + 1
            if rng.random() < 0.1:
                tokens[-1:] = []  # a word whose last token is gone
        if p == 3:
            own[0] = (0, full, "no marks")
        if p == 4:
            own[-1] = (own[-1][0], full[:-1], own[-1][2])  # a shorter text; the longest counts
        if p == 5:
            own.append((99, full, own[0][2]))  # two words with one span
        if p == 6:
            own[0] = (0, full, None)
        words += [(p, *x) for x in own]
        if p != 7:
            ends.append((p, tokens))
        want |= plan(p, own, tokens if p != 7 else [], budget)
    out = inputs.passage_windows(spark.createDataFrame(words, "passage int, word int, full_text string, marked string"), spark.createDataFrame(ends, "passage int, ends array<int>"), budget)
    got = {(r.passage, r.kind, r.a, r.b): sorted(x.word for x in r.words) for r in out.collect()}
    assert got == want
    assert sorted(x for v in got.values() for x in v) == sorted(w[1] for w in words)
    assert all(x.places and x.places[-1] < r.b and x.places[0] >= r.a for r in out.where("kind = 'window'").collect() for x in r.words)
