import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lexigauge.llm.packing import SumOfSquares, _close, pack_documents
from lexigauge.llm.token_counts import count_tokens, counter

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(spark, docs):
    got = sorted(map(tuple, count_tokens(docs, PATH).collect()), key=str)
    want = sorted([(r.doc_id, len((r.text or "").encode()), n := len(ids_of(r.text)), n > 512) for r in docs.collect()], key=str)
    assert got == want


def test_counts_on_all_kinds_of_characters():
    rng, count = random.Random(1), counter(PATH)
    pool = [chr(c) for c in [*range(0, 0x3100), *range(0xA000, 0xA100), *range(0x1F600, 0x1F640), *range(0xFE00, 0x10000)]]
    pool = [c for c in pool if not 0xD800 <= ord(c) < 0xE000]
    for _ in range(600):
        text = "".join(rng.choice([rng.choice(pool), " ", "a", "'s", "\n", "9"]) for _ in range(rng.randint(1, 60)))
        assert count(text) == len(ids_of(text)), text


def check_packing(rows, docs, window=2048):
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        pieces[r.id].append(r)
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
    want = defaultdict(list)
    for d in docs:
        want[d.doc_id].append([*ids_of(d.text), 1])
    assert set(want) == set(pieces)
    for i, texts in want.items():
        ps = sorted(pieces[i], key=lambda r: r.start)
        assert sum(p.length for p in ps) == sum(map(len, texts))
        for p in ps:
            x = [t[p.start : p.start + p.length] for t in texts if len(t) == p.doc_tokens]
            assert any(list(p.ids) == y and p.ids_crc32 == zlib.crc32(np.array(y, "<u4").tobytes()) for y in x)
    return [sum(r.length for r in s) for s in sequences.values()]


def test_packing_keeps_every_id_once(spark, docs):
    for window in (2048, 64):
        fill = check_packing(pack_documents(docs, PATH, window=window).collect(), docs.collect(), window)
        assert all(f == window or f & (f - 1) == 0 for f in fill)


def test_packing_of_nothing(no_docs):
    assert pack_documents(no_docs, PATH).count() == 0 and count_tokens(no_docs, PATH).count() == 0


def test_level_choice_minimises_the_sum_of_squares():
    rng, p = random.Random(3), SumOfSquares(32)
    for i in range(2000):
        s = rng.randint(1, 32)
        before = p.counts.copy()
        p.place((i, 0, s, b"", s), s)

        def squares(h):
            c = before.copy()
            c[h] -= h > 0
            c[h + s] += h + s < 32
            return int((c[1:32] ** 2).sum())

        if s < 32:
            assert int((p.counts[1:32] ** 2).sum()) == min(squares(h) for h in range(32 - s + 1) if h == 0 or before[h])
    assert len(p.open) == p.counts.sum()


def test_packed_ids_on_all_kinds_of_characters():
    from lexigauge.llm.packing import encoder

    rng, encode = random.Random(2), encoder(PATH, 1)
    pool = [chr(c) for c in [*range(0, 0x260), *range(0x370, 0x400), *range(0x2000, 0x2100), *range(0x1F600, 0x1F640)]]
    texts = ["".join(rng.choice([rng.choice(pool), " ", "a", "'s", "\n", "9", "<|endoftext|>"]) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    assert encode(texts) == [np.array([*ids_of(t), 1], "<u4").tobytes() for t in texts]


def test_closing_windows_moves_little():
    rng = random.Random(4)
    p, closed, total = SumOfSquares(2048), [], 0
    for i in range(1500):
        s = min(2048, int(rng.lognormvariate(6, 1)) + 1)
        total += s
        if full := p.place((i, 0, s, b"".join(k.to_bytes(4, "little") for k in range(s)), s), s):
            closed.append(full)
    rest = p.rest()
    before = sorted((i, k) for w in rest for i, a, n, _, _ in w for k in range(a, a + n))
    out, moved = _close(rest, 2048)
    fills = [sum(x[2] for x in w) for w in out]
    assert all(f == 2048 or f & (f - 1) == 0 for f in fills) and len({f for f in fills if f < 2048}) == sum(f < 2048 for f in fills)
    assert sorted((i, k) for w in out for i, a, n, _, _ in w for k in range(a, a + n)) == before
    assert all(ids == b"".join(k.to_bytes(4, "little") for k in range(a, a + n)) for w in out for _, a, n, ids, _ in w)
    assert moved < 0.05 * total
    assert _close([], 2048) == ([], 0)


def test_very_long_texts_without_words(spark):
    rows = [(0, " " * 1_100_000), (1, "\n" * 1_100_000), (2, " \t\n" * 400_000), (3, "a" * 1_100_000), (4, " " * 70_000 + "x")]
    long_ = spark.createDataFrame(rows, "doc_id long, text string")
    check_packing(pack_documents(long_, PATH).collect(), long_.collect())
    assert {r.id: r.n_tokens for r in count_tokens(long_, PATH).collect()} == {i: len(ids_of(t)) for i, t in rows}
