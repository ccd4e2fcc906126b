"""Queries over words read whole texts: against brute force, on texts longer than any prefix."""

import math
import random
import re
from collections import Counter

import pytest

from lexigauge.functions import text
from lexigauge.queries import QUERIES


def sentence(rng, n):
    return " ".join(rng.choice(("the", "a", "dog", "cat", "sees", "hears", "and", "le's", "Der")) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    docs = ["\n ".join(sentence(rng, rng.randint(1, 6)) + rng.choice(".!?") for _ in range(30)) for _ in range(12)]
    docs += [sentence(rng, 60), "x " * 40 + "the", "one", "", None, "Wait... what?) Yes, 3.5 of it. \n"]
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d, docs


def pairs(docs):
    """How often each context, all of a sentence before a word, stands before the word, and where it stands first."""
    out, first = Counter(), {}
    for d, x in enumerate(docs):
        for k, s in enumerate(re.split(r"(?:(?<=[!?)])|(?<=[^.]\.))\s+", x or "")):
            w = s.split()
            for i in range(1, len(w)):
                key = (" ".join(w[:i]), w[i])
                out[key] += 1
                first.setdefault(key, (d, k, i))
    return out, first


def test_sentences(spark):
    x = "Wait... what?) Yes, 3.5 of it. \n No end"
    assert spark.range(1).select(text.sentences(text.F.lit(x)).alias("x")).first().x == ["Wait... what?)", "Yes, 3.5 of it.", "No end"]


def test_contexts(spark, folder):
    d, docs = folder
    want, _ = pairs(docs)
    assert max(len(c.split()) for c, _ in want) > 50 and sum(want.values()) > 500
    got = {(r.n_words, r.next_word, r.n): r.contexts for r in QUERIES["ngram_bos_contexts"](spark, d).collect()}
    assert got == Counter((len(c.split()), w, n) for (c, w), n in want.items())


def test_frequencies(spark, folder):
    d, docs = folder
    counts, _ = pairs(docs)
    n, words = Counter(), Counter()
    for (c, _), k in counts.items():
        n[c] += k
        words[c] += 1
    total = sum(counts.values())
    rows = QUERIES["ngram_freq_per_million"](spark, d).collect()
    assert {(r.n_words, r.n, r.distinct_next): r.contexts for r in rows} == Counter((len(c.split()), n[c], words[c]) for c in n)
    assert all(r.log_per_million == pytest.approx(math.log10(r.n / total * 1e6), abs=1e-6) for r in rows)


def test_top_contexts(spark, folder):
    d, docs = folder
    counts, first = pairs(docs)
    want = {}
    for (c, w), n in counts.items():
        if " " in c:
            want.setdefault(w, []).append((-n, first[c, w], c))
    want = {(w, c, -n, k + 1) for w, x in want.items() for k, (n, _, c) in enumerate(sorted(x)[:3])}
    assert {(r.word, r.context, r.n, r["rank"]) for r in QUERIES["topk_contexts_per_word"](spark, d).collect()} == want


def offsets(x):
    ends, at = [], -1
    for w in (x or "").split():
        at += len(w) + 1
        ends.append(at)
    return ends, ends[min(len(ends), 3) - 1] if ends else 0


@pytest.fixture(scope="module")
def talks(spark, tmp_path_factory):
    rng = random.Random(6)
    rows = [(i, 0, sentence(rng, i)) for i in range(40)] + [(40, 1, None), (41, 0, "a b c " + "x" * 40 + " d"), (42, 0, "é ü " * 30)]
    d = str(tmp_path_factory.mktemp("talks"))
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{d}/conversations.parquet")
    return d, rows


def test_offset_mask(spark, talks):
    d, rows = talks
    want = {(c, t, len(e), sum(x > lo for x in e)) for c, t, x in rows for e, lo in [offsets(x)]}
    assert {tuple(r) for r in QUERIES["token_offset_mask"](spark, d).collect()} == want


def test_context_windows(spark, talks):
    d, rows = talks
    want = set()
    for c, t, x in rows:
        e, lo = offsets(x)
        p = [i for i, v in enumerate(e) if lo < v <= lo + 15]
        end = p[-1] + 1 if p else 0
        want.add((c, t, *((None, None) if not p else (0, min(len(e), 5)) if p[-1] < 5 else (min(max(0, end - 5), p[0]), end))))
    assert {tuple(r) for r in QUERIES["context_window_anchor"](spark, d).collect()} == want


def test_spelling(spark, folder):
    d, docs = folder
    n = {i: sum(w.lower() in ("the", "and", "der", "les") for w in (x or "").split()) for i, x in enumerate(docs)}
    assert {r.doc_id: r.n for r in QUERIES["spelling_filter"](spark, d).collect()} == {i: k for i, k in n.items() if k}


def test_missing_tasks(spark, tmp_path):
    from lexigauge.operators.checks import EXPECTED_FINETUNE, expected_tasks

    every = expected_tasks()
    rows = [(1, every.index(("finetune", "nl", "pos"))), (2, every.index(("zeroshot", "zho", "zhoblimp")))]
    found = [(k, f"{every[i][0]}-{every[i][1]}", every[i][2]) for k, i in rows]
    expected = spark.createDataFrame([(f"{k}-{lang}", t) for k, lang, t in every], "grp string, task string")
    from lexigauge.operators.checks import missing_tasks

    got = {(r.grp, r.task) for r in missing_tasks(spark.createDataFrame(found, "k long, grp string, task string"), expected, "grp", "task").collect()}
    want = {("finetune-nl", t) for t in EXPECTED_FINETUNE["nl"] if t != "pos"} | {(f"{k}-{lang}", t) for k, lang, t in every if (k, lang) == ("zeroshot", "zho") and t != "zhoblimp"}
    assert got == want
