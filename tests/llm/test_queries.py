"""The queries themselves on the smallest tables: against SQL where there is some, else against brute force."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from lexigauge.llm import queries as q

from .test_suffix import brute
from .test_tokens import ids_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = q.queries()[name](spark, SF)
    want = con.execute(q.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_packing_digest(spark, texts):
    rows = q.op1_packing(spark, SF).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in texts.items():
        ids, at = [*ids_of(text), 1], 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    fill = [sum(r.length for r in s) for s in sequences.values()]
    assert max(fill) <= 2048 and sum(f for f in fill if f & (f - 1) == 0) == sum(fill)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length


def test_suffix_digest(spark, texts):
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in q.op3_suffix_dedup(spark, SF).collect()}
    want = {i: (*b[:3], hashlib.sha256(b[3]).hexdigest()) for i, b in zip(texts, brute(texts.values(), 200), strict=True)}
    assert rows == want


def test_token_counts(spark, texts):
    rows = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in q.op4_token_counts(spark, SF).collect()}
    assert rows == {i: (len(t.encode()), n := len(ids_of(t)), n > 512) for i, t in texts.items()}


def test_held_out_rows(spark):
    for name, m, k in (("op2_toxicity", 4, 2), ("op7_language_id", 4, 2), ("op9_quality", 5, 0)):
        rows = q.queries()[name](spark, SF).collect()
        assert len(rows) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % m == k) for r in rows)
