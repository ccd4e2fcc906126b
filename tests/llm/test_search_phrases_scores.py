"""Ranked search, collocations and language-model scores against plain versions."""

import math
import re
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigauge.llm import arrays, collocations, context_mixing, ranked_search
from lexigauge.llm import queries as q
from lexigauge.llm.common import IS_WORD, fold

from .conftest import SCHEMA, row

SF = "/root/testdata/sf0.001"
LONG = [" " * 1_100_000, "a" * 1_100_000, "ab " * 400_000, "é" * 600_000]
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def raw(text):
    return (text or "").encode().translate(LOW)


def test_words_of_cut_texts():
    texts = ["x" * 5000 + " yé\n" * 300, "", None, "a,b" * 2000, "end"]
    for most in (64, 1 << 20):
        t = arrays.Texts(pa.array(texts), IS_WORD, most)
        want = [(i, w) for i, x in enumerate(texts) for w in re.findall(rb"[0-9a-z\x80-\xff]+", raw(x))]
        assert [(int(r), t.word(k)) for k, r in enumerate(t.row)] == want
        first, number = arrays.distinct_words(t)
        assert [t.word(int(first[n])) for n in number] == [w for _, w in want] and len({t.word(int(i)) for i in first}) == len(first)
        assert len({int(h) for h in t.hash}) == len(first)


def test_words_that_share_a_hash_stay_apart():
    t = arrays.Texts(pa.array(["aa bb aa cc bb"]), IS_WORD)
    t.hash[:] = 7
    first, number = arrays.distinct_words(t)
    assert [t.word(int(first[n])) for n in number] == [b"aa", b"bb", b"aa", b"cc", b"bb"]
    v = ranked_search.Vocabulary([b"aa", b"cc", b"bb"])
    v.hash[:], t.hash[:] = 7, 7
    assert [v.terms[n] for n in v.numbers(t)] == [b"aa", b"bb", b"aa", b"cc", b"bb"]


def test_same_bytes():
    a = np.frombuffer(b"abcdefghijabcdefghix" + bytes(8), np.uint8)
    s, e = np.array([0, 0, 0, 3, 5]), np.array([10, 9, 4, 3, 9])
    t, f = np.array([10, 10, 10, 4, 5]), np.array([20, 19, 15, 4, 9])
    assert arrays.same_bytes(a, s, e, a, t, f).tolist() == [False, True, False, True, True]


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 20_000, dtype=np.uint64))
    for own in (keys, keys[:1], keys[:0]):
        assert sorted(arrays.Slots(own).slot(own).tolist()) == list(range(len(own)))
    with pytest.raises(ValueError):
        arrays.Slots(np.array([5, 5], np.uint64))


@pytest.mark.parametrize("fan", [3, 64])
def test_tree_sum(spark, monkeypatch, fan):
    monkeypatch.setattr(arrays, "FAN", fan)

    def make(batches):
        for _ in batches:
            pass
        counts = np.arange(70_000)
        counts[5] = 300
        yield from arrays.array_rows(counts)

    parts = spark.range(100, numPartitions=40).mapInArrow(make, arrays.PART)
    got = np.zeros(2 * arrays.CHUNK, np.int64)
    for r in arrays.tree_sum(parts, 40).collect():
        at, n = arrays.cells_of(r.asDict())
        got[r["chunk"] * arrays.CHUNK + at] = n
    want = 40 * np.arange(2 * arrays.CHUNK)
    want[5], want[70_000:] = 12_000, 0
    assert (got == want).all()


# ranked search


def plain_search(docs, items, k):
    cut = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", raw(t))
    split = [(i, Counter(cut(t))) for i, t in docs]
    split = [(i, c) for i, c in split if c]
    n, total = len(split), sum(sum(c.values()) for _, c in split)
    df = Counter(w for _, c in split for w in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(cut(t)) if t is not None else set()
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in split:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


ITEMS = [(1, "the same end er in"), (2, None), (3, ""), (4, "nothing-like-it"), (None, "end THE"), (1, "ou ou né"), (5, "end end end"), (6, "日本語テキスト ok a"), (7, "ha nd re")]


@pytest.mark.parametrize("block", [500_000, 3])
def test_search_equals_all_scores(spark, docs, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    monkeypatch.setattr(ranked_search, "SHARD", 2000)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = ranked_search.rank_documents(docs, items, k=4)
    assert got.columns == ["item", "rank", "id", "score"]
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], ITEMS, 4)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_search_on_empty_tables(spark, no_docs, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.rank_documents(no_docs, items).count() == 0
    assert ranked_search.rank_documents(docs, items.where("false")).count() == 0


def test_maxscore_skips_no_document():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, terms = int(rng.integers(1, 60)), int(rng.integers(1, 9))
        lists = [np.sort(rng.choice(n, rng.integers(1, n + 1), replace=False)) for _ in range(terms)]
        shard = object.__new__(ranked_search.Shard)
        shard.ids, shard.posts = list(range(n)), np.concatenate(lists)
        shard.ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        shard.adds = rng.integers(0, 50, len(shard.posts))
        shard.place = {t: t for t in range(terms)}
        shard.bound = np.maximum.reduceat(shard.adds, shard.ends[:-1])
        total = np.bincount(shard.posts, weights=shard.adds, minlength=n).astype(int)
        for least in (0, 1, int(np.median(total)), int(total.max()), int(total.max()) + 1):
            want = sorted((-s, p) for p, s in enumerate(total.tolist()) if s >= max(1, least))[:5]
            place, score = shard.best(list(range(terms)), 5, least)
            assert [(-s, p) for p, s in zip(place.tolist(), score.tolist(), strict=True)] == want


# collocations


def plain_phrases(docs, least, longest, top, share):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", raw(text)):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            around = [b for p2, b in found.items() if len(p2) > len(p) and any(p2[i : i + len(p)] == p for i in range(len(p2) - len(p) + 1))]
            if any(100 * b >= share * a for b in around):
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            s, _, left, right = min(cuts)
            rows.append((-s, -a, b" ".join(p), left, right))
        out += [(lang, r + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for r, x in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def phrases(spark, docs):
    chant = "red lorry, yellow lorry red lorry yellow Lorry\tgo go go go go! né né 日本 né. "
    rows = [row(100 + i, chant * (i % 7), ["en", None, "de"][i % 3]) for i in range(20)]
    return spark.createDataFrame(rows, SCHEMA).union(docs).repartition(5).cache()


@pytest.mark.parametrize(("block", "size", "sketch", "longest"), [(2_000_000, 32_000_000, 26, 3), (7, 40, 3, 4)])
def test_collocations_equal_plain_counts(phrases, monkeypatch, block, size, sketch, longest):
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "BLOCK_BYTES", size)
    monkeypatch.setattr(collocations, "SKETCH", sketch)
    got = collocations.mine_collocations(phrases, least=6 if longest == 3 else 12, longest=longest, top=30, share=50)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain_phrases([(r.lang, r.text) for r in phrases.collect()], 6 if longest == 3 else 12, longest, 30, 50)
    assert len(want) > 5 and sorted(map(tuple, got.collect())) == want


def test_few_copies_of_texts_stay_on_disk(phrases, monkeypatch):
    live, most, cut, forget = set(), [], collocations.common.cut, collocations.common.forget

    def cut_(df):
        out = cut(df)
        if "ids" in out.columns:
            live.add(id(out))
            kept.append(out)
            most.append(len(live))
        return out

    def forget_(df):
        live.discard(id(df))
        forget(df)

    kept = []
    monkeypatch.setattr(collocations.common, "cut", cut_)
    monkeypatch.setattr(collocations.common, "forget", forget_)
    monkeypatch.setattr(collocations, "BLOCK", 8)
    assert collocations.mine_collocations(phrases, least=6, longest=3, top=30, share=50).count() > 0
    assert len(most) > 6 and max(most) <= 3


def test_collocations_of_nothing(spark, no_docs):
    assert collocations.mine_collocations(no_docs).count() == 0
    assert collocations.mine_collocations(spark.createDataFrame([row(1, None), row(2, "one two")], SCHEMA)).count() == 0


def test_scores_past_64_bits(spark):
    big = 10**12
    rows = [(1, "en", ["a", "b", "c"], big, [3 * big, 2 * big, big], [big + 1, 7 * big, big]), (2, "en", ["a", "b", "c"], 10, [10, 20, 10], [20, 10, 10])]
    got = collocations._scored(spark.createDataFrame(rows, "id long, lang string, words array<string>, n long, firsts array<long>, lasts array<long>"), 3).orderBy("id").collect()
    for r, x in zip(got, rows, strict=True):
        cuts = [(10**6 * x[3] ** 2 // (x[4][k - 1] * x[5][2 - k]), k) for k in (1, 2)]
        s, k = min(cuts)
        assert (r.score, r.l, r.r) == (s, x[4][k - 1], x[5][2 - k])
    assert Decimal(10**6) * big * big > 1 << 64


# language-model scores


def plain_base(docs):
    cut = lambda t: [*re.findall(rb"[^\x20\x09-\x0d]+", raw(t)), b"\n"]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in docs]
    c = Counter(w for (_, t), h in zip(docs, held, strict=True) if not h for w in cut(t))
    n, v = sum(c.values()), len(c)
    out = []
    for (i, t), h in zip(docs, held, strict=True):
        w = cut(t)
        out.append((str(i), h, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)))
    return sorted(out)


def digest(rows):
    return sorted((str(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)


@pytest.mark.parametrize("size", [16 << 20, 3000])
def test_base_equals_plain_counts(docs, monkeypatch, size):
    monkeypatch.setattr(context_mixing, "SLICE", size)
    out = context_mixing.score_texts(docs, fold("doc_id", 7) != 2)
    rows = out.collect()
    assert out.columns == ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert digest(rows) == plain_base([(r.doc_id, r.text) for r in docs.collect()])
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    copies = {r.score for r in rows if r.id == 9}
    assert len(copies) == 1


@pytest.mark.parametrize("rare", [1 << 20, 12, 2])
def test_anchors_are_counted_in_every_training_text(spark, monkeypatch, rare):
    monkeypatch.setattr(context_mixing, "ANCHORS", 15)
    monkeypatch.setattr(context_mixing, "RARE", rare)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)] + ["Ü", "THE", "a\x00b"]
    share = 1 / np.arange(2, len(words) + 2) ** 0.7
    texts = [" ".join(w for w, x in zip(words, rng.random(len(words)) < share, strict=True) if x) for _ in range(5000)]
    rows = spark.createDataFrame([(i % 7 == 2, t) for i, t in enumerate(texts)] + [(False, None), (False, ""), (None, "w0")], "held boolean, text string")
    own = [t.translate({c: c + 32 for c in range(65, 91)}).encode() for i, t in enumerate(texts) if i % 7 != 2]
    sets = [set(t.split()) for t in own]
    df = Counter(w for x in sets for w in x)
    top = sorted(df, key=lambda w: (-df[w], w))[:15]
    found, letters, n = context_mixing.may_be_anchors(rows.where("not held and text is not null").select("text"), rare)
    assert set(top) <= set(found) and n == sum(map(bool, sets))
    want = np.bincount(np.frombuffer(b" ".join([*own, b""]), np.uint8), minlength=256)
    want[32] = sum(len(t.split()) for t in own)
    want[[32, 10]] += 1
    assert (letters == want).all()
    together = context_mixing.shared_texts(rows.where("not held and text is not null").select("text"), top)
    assert (together == [[sum(a in x and b in x for x in sets) for b in top] for a in top]).all()
    kinds, _ = context_mixing.text_kinds(rows)
    assert set(kinds) == set(top)


def test_scores_without_rows_to_learn_from(spark, no_docs, docs):
    assert context_mixing.score_texts(no_docs, F.lit(True)).count() == 0
    rows = context_mixing.score_texts(docs, F.lit(False)).collect()
    assert len(rows) == docs.count() and all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in rows)


def test_chunks_end_where_beginnings_do(monkeypatch):
    monkeypatch.setattr(context_mixing, "CHUNK_WORDS", 50)
    words = sorted(f"{i % 37:04d}{i}".encode() for i in range(900)) + [b"zzzz%03d" % i for i in range(200)]
    batches = [pa.RecordBatch.from_pydict({"word": words[a : a + 30]}) for a in range(0, len(words), 30)]
    chunks = [c.column("word").to_pylist() for c in context_mixing._chunks(iter(batches))]
    assert [w for c in chunks for w in c] == words and len(chunks) > 5
    assert all(a[-1][:4] != b[0][:4] for a, b in zip(chunks, chunks[1:], strict=False))


def made(words, kinds, counts, code):
    """Events, and the words and kinds in their order."""
    spelled = [code.spell(w) for w in words]
    order = sorted(range(len(words)), key=lambda i: (spelled[i], kinds[i]))
    spelled = [spelled[i] for i in order]
    start = np.concatenate([[0], np.cumsum([len(x) for x in spelled])])
    e = context_mixing.Events(np.frombuffer(b"".join(spelled), np.uint8), start, kinds[order], counts[order], code)
    return e, spelled


def random_events(rng, n):
    words = {bytes(rng.choice(list(b"abcd")) for _ in range(rng.integers(1, 12))) for _ in range(n)} | {b"\n", b"x" * 90, b"x" * 91}
    pairs = [(w, k) for w in words for k in range(context_mixing.KINDS) if rng.random() < 0.3]
    return [w for w, _ in pairs], np.array([k for _, k in pairs]), rng.integers(0, 5, len(pairs))


def test_counts_of_the_word_so_far():
    rng = np.random.default_rng(2)
    words, kinds, counts = random_events(rng, 300)
    code = context_mixing.Code(np.bincount(np.frombuffer(b"abcdx \n" * 5 + b"aab", np.uint8), minlength=256))
    e, spelled = made(words, kinds, counts, code)
    e.with_deep(code)
    kinds, counts = e.kind, e.count
    path = lambda x: "".join("".join(map(str, code.bit[code.start[s] : code.start[s + 1]])) for s in x)
    paths = [path(x) for x in spelled]
    assert paths == sorted(paths)
    for j, (x, p) in enumerate(zip(spelled, paths, strict=True)):
        head, reach = (len(path(x[:k])) for k in (context_mixing.HEAD, context_mixing.REACH))
        for t in range(head, reach + 1):
            if t == head and reach == head:
                continue
            agree = [i for i, x in enumerate(paths) if x[:t] == p[:t]]
            at = e.deep[j] + t - head
            assert e.all[at] == counts[agree].sum()
            assert e.own[at] == sum(counts[i] for i in agree if kinds[i] == kinds[j])


def test_a_plain_loop_gives_the_same_score():
    rng = np.random.default_rng(4)
    words, kinds, counts = random_events(rng, 60)
    code = context_mixing.Code(np.bincount(np.frombuffer(b"abcdx \n" * 5, np.uint8), minlength=256))
    ones = rng.integers(0, 50, 1 << context_mixing.SLOTS)
    table = context_mixing.packed_counts(ones + rng.integers(0, 50, len(ones)), ones)
    e, _ = made(words, kinds, counts, code)
    e.with_deep(code)
    m = context_mixing.Mixer(code, table)

    def loss(mixer):
        total = 0.0
        for block in e.blocks(code):
            total += e.count[block[0]].dot(np.logaddexp(0, -mixer._mixed(*mixer._inputs(e, block, 1))))
        return total

    before = loss(m)
    for _ in range(3):
        m.learn(e)
    final = context_mixing.Mixer(code, table, {"weight": m.weight, "seen": m.seen})
    got = final.score(e)
    assert loss(m) < before  # it has learned
    want = np.zeros(len(e.count))
    for event, node, bit, depth, hashes, of, deep, beyond in e.blocks(code):
        for i in range(len(node)):
            odds, totals = [], []
            for j in range(context_mixing.INPUTS):
                v = int(table[context_mixing.slots(hashes[j][of[i] : of[i] + 1], node[i : i + 1])[0]])
                n, one = v >> 16, v & 0xFFFF
                came = one if bit[i] else n - one
                if j >= 4 and deep[i] >= 0:
                    a = e.all if j == 4 else e.own
                    n, came = int(a[deep[i]]), int(a[deep[i] + 1])
                if j >= 4 and beyond[i]:
                    n = came = 0
                odds.append(math.log((came + 0.4) / (n - came + 0.4)))
                totals.append(n)
            step = lambda n: sum(n >= x for x in (1, 2, 4, 16, 256))
            gate = (step(totals[5]) * 6 + step(totals[4])) * 3 + (totals[3] >= 1) + (totals[3] >= 32)
            mixed = min(20, max(-20, float(np.dot(final.weight[gate], odds))))
            p = 1 / (1 + math.exp(-mixed))
            x = (min(12, max(-12, mixed if bit[i] else -mixed)) + 12) / 24 * 32
            lo = min(int(x), 31)
            at = (int(e.kind[event[i]]) * 16 + min(int(depth[i]), 15)) * 33 + lo
            r = final.refined[at] * (1 - (x - lo)) + final.refined[at + 1] * (x - lo)
            want[event[i]] += math.log10((p + (r if bit[i] else 1 - r)) / 2)
    assert np.allclose(got, want)


def test_mixing_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = q.op13_context_mixing(spark, SF).withColumnRenamed("doc_id", "id").collect()
    assert digest(rows) == plain_base(docs)
    known = [r for r in rows if not r.held_out]
    assert sum(r.score for r in known) > sum(r.base_score for r in known)


def test_long_texts(spark):
    rows = [row(i, t) for i, t in enumerate(LONG)] + [row(9, "ab ab")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    items = spark.createDataFrame([(1, "ab"), (2, "a" * 1_100_000), (3, "é" * 600_000)], "item_id long, text string")
    got = sorted(map(tuple, ranked_search.rank_documents(docs, items).collect()))
    assert got == plain_search([(r[0], r[1]) for r in rows], [(1, "ab"), (2, "a" * 1_100_000), (3, "é" * 600_000)], 10)
    phrases = collocations.mine_collocations(docs).collect()
    assert [(r.phrase, r.a, r.l) for r in phrases] == [("ab ab ab", 399_998, 400_002)]
    scored = context_mixing.score_texts(docs, F.lit(True)).collect()
    assert digest(r for r in scored) == [(a, False, *b) for a, _, *b in digest(scored)] and {r.id: r.n_tokens for r in scored} == {0: 1, 1: 2, 2: 400_001, 3: 2, 9: 3}
