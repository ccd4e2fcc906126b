import re

from lexigauge.llm.quality import fit_quality, keep_quality, score_quality

from .conftest import SCHEMA
from .test_near import brute as classes
from .test_shards_leaks import WORD
from .test_shards_leaks import brute as leaks
from .test_suffix import brute as repeats
from .test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    import corpus_pipeline as cp
    from lexigauge.llm import common

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(cp.STAGES)
    assert list(stages) == ["quality", "near_dedup", "substring_dedup", "decontaminate", "pack"]
    good = common.cut(stages["quality"](spark, docs, SF))
    model = fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"), common.fold("doc_id", 5) != 0)
    want = {r.id for r in score_quality(docs, model).collect() if r.predicted}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == want

    once = common.cut(stages["near_dedup"](spark, good, SF))
    rows = [tuple(r) for r in good.collect()]
    assert once.columns == docs.columns and {r.doc_id for r in once.collect()} == {min(c) for c in classes(rows)}

    cut = common.cut(stages["substring_dedup"](spark, once, SF))
    rows = once.collect()
    want = {r.doc_id: b[3].decode("utf-8", "ignore") for r, b in zip(rows, repeats([r.text for r in rows], 200), strict=True)}
    assert cut.columns == docs.columns and {r.doc_id: r.text for r in cut.collect()} == want
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    clean = common.cut(stages["decontaminate"](spark, cut, SF))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = {i: (n, h) for i, n, h, _ in leaks(cut.collect(), bench, 10)}
    assert clean.columns == docs.columns
    before = {r.doc_id: r.text for r in cut.collect()}
    for r in clean.collect():
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        n, h = hits[r.doc_id]
        assert r.text == before[r.doc_id] if not h else n - h - 2 * h <= len(words) <= n - h

    packed = stages["pack"](spark, clean, SF).withColumnRenamed("doc_id", "id")
    check_packing(packed.collect(), clean.collect())
    assert len(cp.run(spark, SF).collect()) == packed.count()


def test_odd_rows_and_nothing(spark, docs, no_docs):
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(3, None), (None, 1), (4, 0)], "doc_id long, quality int")
    from lexigauge.llm import common

    model = fit_quality(docs, labels, common.fold("doc_id", 5) != 0)
    assert score_quality(docs, model).count() == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in score_quality(docs, model).collect())
    assert keep_quality(no_docs, model).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int")
    none = fit_quality(no_docs, empty, common.fold("doc_id", 5) != 0)
    assert all(r.score == 1 for r in score_quality(docs, none).collect())
    import corpus_pipeline as cp

    for name, stage in cp.STAGES:
        out = stage(spark, docs.select(*cp.COLUMNS, "label"), SF)
        assert out.count() > 0 and (name == "pack" or out.columns == list(cp.COLUMNS))
        assert stage(spark, spark.createDataFrame([], SCHEMA), SF).count() == 0


def test_quality_and_decontamination_of_odd_rows(spark, docs):
    import corpus_pipeline as cp
    from lexigauge.llm import common

    stages, odd = dict(cp.STAGES), docs.select(*cp.COLUMNS)
    model = fit_quality(odd, spark.read.parquet(f"{SF}/labels.parquet"), common.fold("doc_id", 5) != 0)
    good = sorted((str(r.id) for r in score_quality(odd, model).collect() if r.predicted))
    assert sorted(str(r.doc_id) for r in stages["quality"](spark, odd, SF).collect()) == good
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = spark.createDataFrame([(900, "x " + bench[0][1] + " y", "en", "s", 1), (900, "x " + bench[0][1] + " y", "en", "s", 1), (901, bench[1][1] * 2000, None, None, None)], odd.schema)
    got = {r.doc_id: r.text for r in stages["decontaminate"](spark, odd.unionByName(leaked), SF).collect()}
    assert set(got) == {r.doc_id for r in odd.collect()} | {900, 901}
    assert WORD.findall(got[900]) == ["x", "y"] and len(WORD.findall(got[901])) < 2000
    assert all(got[r.doc_id] == r.text for r in odd.collect() if r.doc_id is not None and list(leaks([r], bench, 10))[0][2] == 0)


def test_ways_beyond_the_broadcast_bound(spark, docs, monkeypatch):
    import corpus_pipeline as cp
    from lexigauge.llm import common

    stage = dict(cp.STAGES)["near_dedup"]
    small = sorted(map(str, map(tuple, stage(spark, docs, SF).collect())))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(str, map(tuple, stage(spark, docs, SF).collect()))) == small
    ids = [r.doc_id for r in stage(spark, docs, SF).collect()]
    assert len(ids) == len(set(ids))
