import numpy as np
import pytest
from pyspark.sql import types as T

from lexigauge.llm import embedding_duplicates
from lexigauge.llm.embedding_duplicates import count_for, linked_pairs, linked_vectors, tables_for

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("key", T.StringType()), T.StructField("v", T.IntegerType())])


def rows_of(vectors, labels):
    return [(i, None if v is None else [None if c is None else float(c) for c in v], y, "a", "b", 1) for i, (v, y) in enumerate(zip(vectors, labels, strict=True))]


def brute(rows, least):
    ok = [r for r in rows if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    links = {r[0]: set() for r in rows}
    for y, d in {(r[2], len(r[1])) for r in ok}:
        own = [r for r in ok if (r[2], len(r[1])) == (y, d)]
        x = np.array([np.float32(r[1]) for r in own], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(x @ x.T >= least), strict=True):
            if i != j:
                links[own[i][0]].add(own[j][0])
    out = {}
    for r in rows:
        seen, todo = {r[0]}, [r[0]]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        out[r[0]] = (len(links[r[0]]), min(seen), min(seen) == r[0])
    return out


@pytest.mark.parametrize("tile", [2048, 40])
def test_against_brute_force(spark, tile):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 16))
    vectors = [c + s * rng.standard_normal(16) for c in centres for s in (0.05, 0.12, 0.25, 0.3)]
    vectors += [vectors[3]] * 90 + [vectors[7] * 2]
    labels = [i // 4 % 3 for i in range(240)] + [3] * 90 + [labels_of := 1]
    vectors += [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 8, [1.0] * 8, [-0.0] + [1.0] * 15, [0.0] + [1.0] * 15, [1.0] * 16]
    labels += [1, 1, 1, 1, 1, 1, 1, 1, 2, 2, None]
    rows = rows_of(vectors, labels)
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in linked_vectors(spark.createDataFrame(rows, SCHEMA), tile=tile).collect()}
    assert got == brute(rows, 0.93)
    assert labels_of == 1


def test_nothing(spark):
    assert linked_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_more_vectors_take_more_tables():
    assert tables_for(100, 0.93) == (0, 1) and tables_for(10**9, 0.93)[0] == 19
    assert 20 <= count_for(0.93) < 24


def near(rng, base, cosine):
    """Unit vectors at a cosine from those of base."""
    noise = rng.standard_normal(base.shape)
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return cosine * base + np.sqrt(1 - cosine**2) * noise


@pytest.mark.parametrize("block, tile", [(2048, 4096), (256, 300)])
def test_a_label_of_many_blocks(spark, monkeypatch, block, tile):
    monkeypatch.setattr(embedding_duplicates, "BLOCK", block)
    rng = np.random.default_rng(9)
    base = rng.standard_normal((2500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    hot = near(rng, np.repeat(base[:1], 400, 0), 0.968)  # one group whose pairs lie about the limit
    vectors = np.concatenate([base, near(rng, base, 0.9302), near(rng, base[:900], 0.96), hot]).astype(np.float32)
    rows = rows_of(vectors, [1] * len(vectors))
    want = brute(rows, 0.93)
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in linked_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4), tile=tile).collect()}
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert len(rows) > 5000 and there > 10_000
    assert all(got[k][0] <= want[k][0] for k in want) and found >= 0.999 * there
    assert np.mean([got[k] == want[k] for k in want]) > 0.99


def test_counts_miss_few_pairs_at_the_limit():
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(10):
        base = rng.standard_normal((1000, 64))
        base /= np.linalg.norm(base, axis=1, keepdims=True)
        x = np.concatenate([base, near(rng, base, 0.9301)])
        missed += 1000 - sum(int((abs(a - b) == 1000).sum()) for a, b in linked_pairs(x, 0.93))
    assert missed <= 8  # 2 are expected, by sweep and count


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, [1.0, 0.0], 1, "", "", 0), (None, None, 1, "", "", 0), (3, [1.0, 0.0], 1, "", "", 0), (3, [1.0, 0.0], 1, "", "", 0), (4, [0.0, 1.0], None, "", "", 0)]
    got = sorted((str(r.id), r.n_links, str(r.component_id)) for r in linked_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("3", 2, "3"), ("3", 2, "3"), ("4", 0, "4"), ("None", 0, "None"), ("None", 2, "3")]
