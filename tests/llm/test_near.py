import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lexigauge.llm import common, near_duplicates as module
from lexigauge.llm.near_duplicates import least_agreement, near_duplicates, weighted_samples

from .conftest import SCHEMA, odd_rows, prose, row

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, k=5, least=0.8):
    """Classes by links of equal texts and of weighted Jaccard similarity over all pairs."""
    texts = [r[1] for r in rows]
    words = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    df = defaultdict(int)
    for w in words:
        for x in set(w):
            df[x] += 1
    idf = {x: 1 + np.log((1 + len(rows)) / (1 + n)) for x, n in df.items()}
    sets = []
    for w in words:
        s, n = defaultdict(float), min(k, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            s[tuple(w[i : i + n])] += sum(idf[x] for x in w[i : i + n]) / n
        sets.append(s)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = sum(min(v, sets[j][x]) for x, v in sets[i].items() if x in sets[j])
            all_ = sum(sets[i].values()) + sum(sets[j].values()) - both
            if texts[i] is not None and texts[i] == texts[j] or both and both >= least * all_ - 1e-9:
                root[top(i)] = top(j)
    groups = defaultdict(set)
    for i, r in enumerate(rows):
        groups[top(i)].add(r[0])
    return {frozenset(g) for g in groups.values()}


def corpus():
    rng = random.Random(3)
    out = []
    for g in range(6):
        base = prose(rng, 150)
        for n in range([2, 3, 25, 40, 8, 12][g]):
            w = base.split(" ")
            for _ in range(n % 7):
                w[rng.randrange(len(w))] = prose(rng, 1)
            out.append(" ".join(w))
        out += [base] * g
    chain = prose(rng, 200).split(" ")
    out += [" ".join(chain[i : i + 150]) for i in range(0, 50, 6)]
    out += [prose(rng, rng.randint(1, 200)) for _ in range(40)]
    rng.shuffle(out)
    return [row(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("tile, hot, memory", [(512, 1000, 1 << 25), (5, 4, 3000)])
def test_against_brute_force(spark, monkeypatch, tile, hot, memory):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(module, "MEMORY", memory)
    rows = corpus()
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), tile=tile, share=tile).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.class_id].add(r.id)
        assert r.kept == (r.id == r.class_id)
    assert all(c == min(g) for c, g in groups.items())
    assert {frozenset(g) for g in groups.values()} == brute(rows)


def test_odd_rows(spark, no_docs):
    rows = [r for r in odd_rows() if r[0] is not None]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    # null ids: of a text that has an id, of texts that have none
    null = [(None, *rows[9][1:]), row(None, "of no id at all " * 9), row(None, "of no id at all " * 9), row(None, None)]
    groups, of_null = defaultdict(set), []
    for r in near_duplicates(spark.createDataFrame(rows + null, SCHEMA)).collect():
        if r.id is None:
            of_null.append((r.class_id, r.kept))
        else:
            groups[r.class_id].add(r.id)
    assert {frozenset(g) for g in groups.values()} == brute(rows)
    assert sorted(of_null, key=str) == sorted([(9, False), (None, True), (None, True), (None, True)], key=str)
    assert near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("most", [32_000_000, 0])
def test_words_are_counted_one_by_one(spark, monkeypatch, most):
    """More words than any table of cells would keep apart, words in more documents than a byte counts, and both ways by which counts come."""
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(400_000)}" for _ in range(3000)) for _ in range(220)] + [None, "", "W7 w7 x"] + ["often said"] * 300
    monkeypatch.setattr(module, "HELD", 5000)
    monkeypatch.setattr(module, "BUCKET", 1 << 14)
    monkeypatch.setattr(module, "WORDS", most)
    monkeypatch.setattr(common, "HOT_ROWS", 200)
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    df = defaultdict(int)
    for t in texts:
        for w in {x.lower() for x in (t or "").split()}:
            df[w] += 1
    assert len(df) > 1 << 18
    docs, w = module.with_weights(frame)
    rows = {r.id: r for r in docs.collect()}
    assert len(rows) == len(texts) and all(rows[i].text == t for i, t in enumerate(texts))
    n = len(texts)
    for i in (0, 7, 219, 220, 221, 222, 400):
        h, row = module._word_hashes(*common.text_buffers(pa.array([texts[i]], pa.string())))
        assert np.allclose(w(h, row, [rows[i].own]), [1 + np.log((1 + n) / (1 + df[x.lower()])) for x in (texts[i] or "").split()])


def test_classes_by_words_counts_joined(spark, monkeypatch):
    monkeypatch.setattr(module, "WORDS", 0)
    test_against_brute_force(spark, monkeypatch, 5, 4, 3000)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rare_words_weigh_as_rare_as_they_are(spark):
    """Two texts that differ in one word, among 24,000: with rare words as heavy as they are, they aren't similar; weighed as words in one of 10,000 documents, they would be."""
    rng = random.Random(8)
    vocabulary = [f"c{i}" for i in range(178)]
    base = rng.sample(vocabulary, 89)
    texts = [" ".join(rng.sample(vocabulary, 89)) for _ in range(24_000)]
    texts += [" ".join([*base[:44], w, *base[45:]]) for w in ("rarely", "seldom")]
    df = defaultdict(int)
    for t in texts:
        for x in set(t.split()):
            df[x] += 1
    n = len(texts)

    def similarity(least):
        idf = {x: 1 + np.log((1 + n) / (1 + max(c, least))) for x, c in df.items()}
        a, b = ([sum(idf[x] for x in t.split()[i : i + 5]) / 5 for i in range(85)] for t in texts[-2:])
        both = sum(x for k, x in enumerate(a) if not 40 <= k <= 44)
        return both / (sum(a) + sum(b) - both)

    assert similarity(0) < 0.8 < similarity(1e-4 * n)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert near_duplicates(docs).where("class_id <> id").count() == 0


def test_recall_at_the_limit(spark):
    """Pairs whose similarity is just the limit: few may be missed by bands."""
    rng = random.Random(12)
    rows = []
    for g in range(300):
        base = [f"v{g}x{i}" for i in range(200)]
        other = base[:]
        for i in range(0, 200, 9)[: rng.choice((3, 4))]:
            other[i] = "y" + other[i]
        rows += [row(2 * g, " ".join(base)), row(2 * g + 1, " ".join(other))]
    want = brute_pairs(rows)
    got = {r.id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = sum(got[2 * g] == got[2 * g + 1] for g in want)
    assert len(want) > 200 and found >= len(want) - 1
    assert all(got[2 * g + 1] == 2 * g + 1 for g in range(300) if g not in want)


def brute_pairs(rows):
    """Groups whose two texts are similar."""
    classes = brute(rows)
    return {g for g in range(len(rows) // 2) if frozenset((2 * g, 2 * g + 1)) in classes}


def test_samples_that_pairs_at_the_limit_agree_in():
    assert 36 <= least_agreement(64, 0.8) <= 40


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 400, dtype=np.uint64)
    w = rng.random(400) + 0.5
    v = w.copy()
    v[:60] *= 3
    a, b = weighted_samples(h, w, 4000), weighted_samples(h[20:], v[20:], 4000)
    want = np.minimum(w, v)[20:].sum() / np.maximum(np.where(np.arange(400) < 20, w, 0), np.where(np.arange(400) < 20, w, np.maximum(w, v))).sum()
    assert abs((a == b).mean() - want) < 0.04
