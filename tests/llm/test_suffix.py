import random
from collections import Counter

import numpy as np
import pytest

from lexigauge.llm import common, suffix_dedup
from lexigauge.llm.suffix_dedup import Run, anchors, lcp, merge, remove_repeats

from .conftest import SCHEMA, prose, row


def brute(texts, window):
    raws = [(t or "").encode() for t in texts]
    n = Counter(r[i : i + window] for r in raws for i in range(len(r) - window + 1))
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - window + 1):
            if n[r[i : i + window]] > 1:
                gone[i : i + window] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        yield len(r), int(gone.sum()), int((edge == 1).sum()), bytes(np.frombuffer(r, np.uint8)[~gone])


def texts():
    rng = random.Random(11)
    out = [None, "", "short", "ab" * 400, "a" * 700, "a" * 199, "a" * 200]
    base = prose(rng, 400)
    passage = prose(rng, 60)
    for _ in range(25):
        w = base.split(" ")
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        out.append(" ".join(w))
    out += [prose(rng, rng.randint(1, 80)) + passage + prose(rng, rng.randint(1, 80)) for _ in range(30)]
    out += [base, base, passage, passage + passage[:150], base[:900] + base[:900], base[100:310], base[50:251]]
    for k in range(195, 206):
        out += [prose(rng, 20) + base[300 + k : 300 + 2 * k] + prose(rng, 20)]
    return out + [prose(rng, 100) for _ in range(20)]


@pytest.mark.parametrize(("hot", "spread"), [(suffix_dedup.HOT, common.HOT_ROWS), (8, 4)])
def test_against_brute_force(spark, monkeypatch, hot, spread):
    monkeypatch.setattr(common, "HOT_ROWS", spread)
    t = texts()
    df = spark.createDataFrame([row(i, x) for i, x in enumerate(t)], SCHEMA).repartition(4)
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df, hot=hot).collect()}
    for i, want in enumerate(brute(t, 200)):
        assert got[i] == want, (i, got[i][:3], want[:3])


def test_odd_rows(spark, docs, no_docs):
    rows = docs.collect()
    got = sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs).collect()), key=str)
    assert got == sorted(((d.doc_id, *b) for d, b in zip(rows, brute([d.text for d in rows], 200), strict=True)), key=str)
    assert remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("stretch", [suffix_dedup.STRETCH, 300])
def test_each_window_holds_an_anchor(monkeypatch, stretch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
    rng = random.Random(2)
    raw = [(prose(rng, n) + "x" * m).encode() for n, m in ((300, 0), (50, 300), (1, 1), (200, 5))]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0, *map(len, raw)])
    at, h = anchors(data, offsets, 200)
    monkeypatch.undo()
    whole = dict(zip(*anchors(data, offsets, 200), strict=True))
    assert all(whole[i] == v for i, v in zip(at.tolist(), h, strict=True) if i in whole) and set(whole) <= set(at.tolist())
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        for i in range(lo, hi - 199):
            assert ((at >= i) & (at <= i + 160)).any()


def test_merge_knows_common_prefixes():
    rng = random.Random(7)
    for k in (1, 2, 3, 5, 8):
        runs, every = [], []
        for _ in range(k):
            own = sorted(bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(rng.randint(0, 40)))
            every += own
            shared = [lcp(a, b, 0) if a else 0 for a, b in zip([b"", *own], own, strict=False)]
            runs.append(Run(np.array(shared, np.uint16), b"".join(s[n:] for s, n in zip(own, shared, strict=True)), 12))
        out = list(merge(runs))
        assert [x[3] for x in out] == sorted(every)
        assert [x[2] for x in out[1:]] == [lcp(a[3], b[3], 0) for a, b in zip(out, out[1:], strict=False)]


def test_hot_and_rare_anchors_in_one_bucket(spark):
    rng = random.Random(4)
    blocks = [prose(rng, 12)[:60] for _ in range(24)]
    t = ["".join(rng.choice(blocks[:4] if rng.random() < 0.3 else blocks) + (prose(rng, 20)[: rng.randint(0, 60)]) for _ in range(12)) for _ in range(60)]
    df = spark.createDataFrame([row(i, x) for i, x in enumerate(t)], SCHEMA).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df, hot=12).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for i, want in enumerate(brute(t, 200)):
        assert got[i] == want, (i, got[i][:3], want[:3])
