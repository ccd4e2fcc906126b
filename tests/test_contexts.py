"""Contexts of any length by hashes of prefixes, against contexts that are written out."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigauge import queries
from lexigauge.functions import tokens
from lexigauge.operators import ngrams


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    said = [" ".join(rng.choice("a b cc ddd é").replace("é", "é") if rng.random() < 0.9 else rng.choice(["x.", "y!", "z?"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    said += [None, "", "one", "  . ! ", "w " * 3000, said[0], "a b cc. a b ddd. a b cc"]
    return spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").repartition(4).cache()


def test_prefix_hashes_tell_prefixes_apart(spark):
    rows = spark.createDataFrame([(["a", "b", "a"],), (["a", "b", "c"],), ([],), (None,), (["b", "a"],), (["x"] * 500,)], "w array<string>").repartition(1)
    got = [(r.w, r.h) for r in rows.select("w", tokens.prefix_hashes(F.col("w")).alias("h")).collect()]
    known = {}
    for w, h in got:
        assert (w is None) == (h is None) and len(h or ()) == len(w or ())
        for k, x in enumerate(h or ()):
            assert known.setdefault(tuple(w[: k + 1]), x) == x
    assert len(set(known.values())) == len(known)


def test_hashed_contexts_are_those_written_out(docs):
    plain = ngrams.context_counts(ngrams.prefix_contexts(docs, by_sentence=True))
    want = Counter({(r.context, r.next_word): r.n for r in plain.collect()})
    counts = ngrams.hashed_counts(ngrams.hashed_contexts(docs)).cache()
    got = Counter({(r.context, r.next_word): r.n for r in ngrams.with_context(counts.select("next_word", "n", "at"), docs).collect()})
    assert got == want and counts.count() == len(want)
    stats = {r.context: r for r in ngrams.context_statistics(plain).collect()}
    for r in ngrams.with_context(ngrams.hashed_statistics(counts).drop("a", "b"), docs).collect():
        s = stats.pop(r.context)
        assert (r.n, r.distinct_next) == (s.n, s.distinct_next) and r.frequency == pytest.approx(s.frequency) and r.log_per_million == pytest.approx(s.log_per_million)
        assert len(r.context.split(" ")) == r.size
    assert not stats


def test_top_contexts_by_count_then_place(docs):
    counts = ngrams.hashed_counts(ngrams.hashed_contexts(docs))
    rows = [r.asDict() for r in ngrams.with_context(counts.select("next_word", "n", "size", "at", F.col("at").alias("place")), docs).collect()]
    want = {}
    for word in {r["next_word"] for r in rows}:
        own = sorted((r for r in rows if r["next_word"] == word and r["size"] >= 2), key=lambda r: (-r["n"], tuple(r["place"])))[:2]
        want |= {(word, k + 1): (r["context"], r["n"]) for k, r in enumerate(own)}
    best = ngrams.top_hashed(counts, top=2, least_words=2)
    assert {(r.word, r.rank): (r.context, r.n) for r in ngrams.with_context(best, docs).collect()} == want
    targets = docs.sparkSession.createDataFrame([("a",), ("a",)], "word string")
    assert {r.word for r in ngrams.top_hashed(counts, targets).collect()} == {"a"}


def test_no_contexts(spark):
    none = spark.createDataFrame([(1, None), (2, "one. two.")], "doc_id long, text string")
    counts = ngrams.hashed_counts(ngrams.hashed_contexts(none))
    assert counts.count() == 0 and ngrams.hashed_statistics(counts).count() == 0
    assert ngrams.with_context(ngrams.top_hashed(counts), none).count() == 0


@pytest.fixture(params=[1 << 23, 300])
def sentences_at_once(request, monkeypatch):
    monkeypatch.setattr(ngrams, "TRIE_BYTES", request.param)


@pytest.fixture(scope="module")
def odd(docs):
    said = ["a\x01 b. a\x00 b. a b", "a\x01\x02 b c. a\x01\x01 b c. a\x00\x01 b c.", "a b. a b", "a bc. a b c. a b\x01 c", "é é é. éé é. é", "a b c d e. a b c d", None]
    return docs.union(docs.sparkSession.createDataFrame([(1000 + k, x) for k, x in enumerate(said * 2)], "doc_id long, text string")).cache()


def test_written_contexts_are_whole(odd, sentences_at_once):
    plain = ngrams.context_counts(ngrams.prefix_contexts(odd, by_sentence=True))
    want = {(r.context, r.next_word): r.n for r in plain.collect()}
    got = [(r.context, r.next_word, r.n) for r in ngrams.written_counts(odd).collect()]
    assert len(got) == len(want) and {x[:2]: x[2] for x in got} == want
    stats = {r.context: r for r in ngrams.context_statistics(plain).collect()}
    own = ngrams.written_statistics(odd).collect()
    assert len(own) == len(stats)
    for r in own:
        s = stats[r.context]
        assert (r.n, r.distinct_next) == (s.n, s.distinct_next) and r.frequency == pytest.approx(s.frequency) and r.log_per_million == pytest.approx(s.log_per_million)


def test_best_contexts_are_those_of_all_counts(odd, sentences_at_once):
    counts = ngrams.hashed_counts(ngrams.hashed_contexts(odd))
    for least, targets in ((1, None), (2, None), (1, odd.sparkSession.createDataFrame([("a",), ("é",)], "word string"))):
        want = sorted(map(str, ngrams.top_hashed(counts, targets, top=3, least_words=least).select("word", "n", "rank", "at").collect()))
        assert sorted(map(str, ngrams.best_contexts(odd, targets, top=3, least_words=least).select("word", "n", "rank", "at").collect())) == want


def test_queries_put_out_each_context(spark):
    d = "/root/testdata/sf0.001"
    for name, words_ in (("ngram_bos_contexts", {"context", "next_word", "n"}), ("ngram_freq_per_million", {"context", "n", "distinct_next", "frequency", "log_per_million"})):
        assert set(queries.QUERIES[name](spark, d).columns) == words_


def test_sentences_are_shuffled_not_contexts(docs):
    plan = ngrams.written_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "HashAggregate" not in plan


def test_no_sentences(spark):
    none = spark.createDataFrame([(1, None), (2, "one. two.")], "doc_id long, text string")
    assert ngrams.written_counts(none).count() == 0 and ngrams.written_statistics(none).count() == 0 and ngrams.best_contexts(none).count() == 0


def test_words_in_two_rows_are_shared(spark):
    rows = [(1, "A b"), (2, "a c"), (3, "b a"), (4, None), (5, ""), (6, "c d d"), (7, "e"), (7, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngrams.shared_words_filter(docs, "doc_id", "text")
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 3, 4, 5]  # two rows of one key are one
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1  # texts are cut once
