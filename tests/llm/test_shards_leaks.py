import hashlib
import re
import zlib
from collections import Counter

import pytest

from lexigauge.llm import common, decontamination
from lexigauge.llm.decontamination import find_contamination
from lexigauge.llm.sharding import shard_documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_shards(spark, docs, no_docs):
    rows = shard_documents(docs, shards=4).collect()
    want = Counter((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for s in range(4):
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 4) <= most
        ids = [-1 if r.doc_id is None else r.doc_id for r in sorted(own, key=lambda r: r.slot)]
        assert ids == sorted(ids)
    assert shard_documents(no_docs).count() == 0


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n):
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    for d in docs:
        w, hit, found = words(d.text), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if (x := tuple(w[a : a + k])) in windows:
                    hit |= set(range(a, a + k))
                    found |= windows[x]
        yield d.doc_id, len(w), len(hit), sorted(found)


@pytest.mark.parametrize("as_a_whole, hashes", [(1 << 24, 1 << 22), (1000, 1 << 22), (0, 0)])
def test_leaks_against_brute_force(spark, docs, monkeypatch, as_a_whole, hashes):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", as_a_whole)
    monkeypatch.setattr(decontamination, "BROADCAST_HASHES", hashes)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    texts = [d.text for d in docs.collect() if d.text and len(d.text) > 300]
    items = [(1, texts[0][40:260]), (2, texts[1].upper()), (3, "the"), (4, ""), (5, None), (6, "nowhere to be found at all in any of these texts x"), (7, texts[2][:200]), (8, texts[2][:200]), (9, "don T we LL")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for n in (10, 3):
        got = find_contamination(docs, bench, n=n).collect()
        assert sorted(((r.id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == sorted(brute(docs.collect(), items, n), key=str)
    by_id = {d.doc_id: d.text for d in docs.collect()}
    for r in got:
        raw = (by_id[r.id] or "").encode()
        hit = b" ".join(raw[s.start : s.end] for s in r.spans)
        assert sum(s.end - s.start for s in r.spans) + len((r.kept_text or "").encode()) == len(raw)
        assert len(words(hit.decode())) == r.n_hit
    assert hashlib.sha256(b"").hexdigest()


def test_no_leaks(spark, docs, no_docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in find_contamination(docs, empty).collect())
    assert find_contamination(no_docs, empty).count() == 0
