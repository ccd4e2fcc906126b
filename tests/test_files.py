import gzip
import json
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigauge import schemas
from lexigauge.operators import checks, collate, frames, metrics, ngrams, splits
from lexigauge.sources import binary, files, sinks, tasks
from lexigauge.streaming import sweeps


def test_json_lines_with_order(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"sentence_good": f"{name}{k}", "sentence_bad": "x"}) + "\n" for k in range(5)))
    (tmp_path / "c.txt").write_text("{}")
    rows = files.json_lines(spark, str(tmp_path), schemas.MINIMAL_PAIR, numbered=True)
    got = sorted((r.file[-7:], r.ord, r.sentence_good) for r in rows.collect())
    assert got == [(f"{n}.jsonl", k, f"{n}{k}") for n in "ab" for k in range(5)]


def test_tables(spark, tmp_path):
    (tmp_path / "cdi.csv").write_text("word,16,17\ndog,0.1,0.2\ncat,,0.4\n")
    assert sorted(map(tuple, files.vocabulary_shares(spark, str(tmp_path / "cdi.csv")).collect()), key=str) == [("cat", 16, None), ("cat", 17, 0.4), ("dog", 16, 0.1), ("dog", 17, 0.2)]
    (tmp_path / "no.csv").write_text("word,x\na,1\n")
    with pytest.raises(ValueError):
        files.vocabulary_shares(spark, str(tmp_path / "no.csv"))
    with gzip.open(tmp_path / "s.tsv.gz", "wt") as f:
        f.write("itemid\twordnum\tword\tFullText\tgpt\n1.0\t3\t the \tx\t5.25\n")
    t = files.surprisal_table(spark, str(tmp_path / "s.tsv.gz"))
    assert [tuple(r) for r in files.long_surprisal(t, ["itemid", "wordnum", "word"]).collect()] == [("1", 3, "the", "gpt", 5.25)]
    (tmp_path / "w.json").write_text(json.dumps({"dog": [{"context": "the"}, {"context": "a"}], "a": [{"context": "x"}], "cat": []}))
    assert [r.word for r in files.word_contexts(spark, str(tmp_path / "w.json")).collect()] == ["dog"]
    (tmp_path / "w.txt").write_text("one\n\n two \n")
    assert [r.word for r in files.target_words(spark, str(tmp_path / "w.txt")).collect()] == ["one", "two"]
    with pytest.raises(ValueError):
        files.target_words(spark, "x.xml")
    (tmp_path / "r.csv").write_text("item,word\n3,a\n,b\n")
    assert [r.item for r in files.reading_times(spark, str(tmp_path / "r.csv"), "item string, word string").collect()] == ["3", "None"]
    (tmp_path / "m.csv").write_text("image1,image2,text1\na,b,c\nd,e,f\n")
    df, images, texts = files.manifest(spark, str(tmp_path / "m.csv"))
    assert (images, texts) == (2, 1) and [r.trial for r in df.orderBy("trial").collect()] == [1, 2]


def test_results(spark, tmp_path):
    d = tmp_path / "x" / "org__model-a"
    d.mkdir(parents=True)
    (d / "results_1.json").write_text(json.dumps({"results": {"blimp": {"alias": "blimp", "acc,none": 0.5}, "piqa": {"alias": " piqa", "acc,none": 0.1}}}))
    (d / "results_2.json").write_text(json.dumps({"results": {"blimp": {"alias": "blimp", "acc,none": 0.75}}}))
    got = {r.task: (r.model, float(r.metrics["acc,none"]), r.alias) for r in files.task_results(spark, str(tmp_path / "x")).collect()}
    assert got == {"blimp": ("model-a", 0.75, "blimp"), "piqa": ("model-a", 0.1, " piqa")}
    for outer, inner in (("nl", "arc"), ("pos", "zh")):
        p = tmp_path / "f" / outer / inner
        p.mkdir(parents=True)
        (p / "eval_results.json").write_text(json.dumps({"eval_accuracy": 0.25, "eval_samples": 8, "epoch": 1.0}))
    assert sorted((r.lang, r.task) for r in files.finetune_results(spark, str(tmp_path / "f")).collect()) == [("nl", "arc"), ("zh", "pos")]
    (tmp_path / "predictions.txt").write_text("index\tprediction\n0\ta\tb\n\n1\n")
    assert sorted((r["index"], r.prediction) for r in files.predictions_text(spark, str(tmp_path / "predictions.txt")).collect()) == [(0, "a\tb"), (1, "")]
    s = tmp_path / "s"
    s.mkdir()
    for date, acc in (("2024-01", 0.0), ("2024-02", 1.0)):
        (s / f"samples_hanzi_pinyin_{date}.jsonl").write_text(json.dumps({"doc_id": 1, "doc_hash": "h", "filtered_resps": [["-1", "f"], ["-2", "f"]], "target": "0", "acc": acc}) + "\n")
    (r,) = files.newest_samples(spark, str(s), schemas.SAMPLE_LOG).collect()
    assert r.task == "hanzi_pinyin" and r.acc == 1.0
    (s / "samples_hanzi_pinyin_2024-03.jsonl").write_text(2 * (json.dumps({"doc_id": 1, "doc_hash": "h"}) + "\n"))
    with pytest.raises(Exception, match="occurs twice"):
        files.newest_samples(spark, str(s), schemas.SAMPLE_LOG).collect()
    (tmp_path / "report.txt").write_text("TEMP: 1.0\nblimp: 70.5\n### AVERAGE ACCURACY\n65.25\n")
    (r,) = files.reports(spark, str(tmp_path), "report.txt").collect()
    assert r.average == 65.25 and r.scores["blimp"] == 70.5
    (tmp_path / "n.json").write_text(json.dumps({"meco": {"nl": 0.5}}))
    assert [tuple(r) for r in files.nested_scores(spark, str(tmp_path / "n.json")).collect()] == [("meco_nl", 0.5)]
    t = tmp_path / "t"
    t.mkdir()
    for k in (1, 2):
        (t / f"meco_{k}_a.json").write_text("{}")
        time.sleep(1.1)
    assert files.newest_by_time(spark, str(t), "meco_*.json", r"_([a-z])\.json$").first().file.endswith("meco_2_a.json")


def test_registry(spark, tmp_path):
    (tmp_path / "_base_yaml").write_text("dataset_path: org/data\ntest_split: test\nmetric_list:\n  - metric: acc\n    aggregation: mean\nprocess_results: !function utils.score\n")
    (tmp_path / "en.yaml").write_text("include: _base_yaml\ntask: t_en\ntest_split: validation\n")
    (tmp_path / "de.yaml").write_text("include: _base_yaml\ntask: t_de\n")
    (tmp_path / "g.yaml").write_text("group: all\ntask:\n  - part\naggregate_metric_list:\n  - metric: acc\n    weight_by_size: true\n")
    (tmp_path / "p.yaml").write_text("group: part\ntask:\n  - t_en\n  - t_de\n")
    reg = tasks.registry(spark, str(tmp_path))
    own = {r.name: r for r in reg.where("parent is null").collect()}
    assert own["t_en"].split == "validation" and own["t_de"].split == "test" and own["t_de"].dataset == "org/data" and own["t_en"].metric == "acc"
    assert tasks.leaves(reg, "all") == ["t_de", "t_en"]
    assert reg.where("parent = 'all'").first().weight_by_size


def test_binary(spark, tmp_path):
    a = np.arange(24.0).reshape(4, 3, 2)
    np.save(tmp_path / "a.npy", a)
    rows = binary.matrix_rows(spark, str(tmp_path / "a.npy")).orderBy("i").collect()
    assert [r.vec for r in rows] == a.reshape(4, -1).tolist()

    def element(kind, raw):
        return struct.pack("<II", kind, len(raw)) + raw + b"\0" * (-len(raw) % 8)

    body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", 2, 3)) + element(1, b"sim") + element(9, np.arange(6.0).tobytes())
    (tmp_path / "m.mat").write_bytes(b" " * 124 + struct.pack("<H", 0x0100) + b"IM" + element(14, body))
    rows = binary.matrix_rows(spark, str(tmp_path / "m.mat"), "sim").orderBy("i").collect()
    assert [r.vec for r in rows] == [[0, 2, 4], [1, 3, 5]]

    i = lambda x: struct.pack(">i", x)
    chars = lambda s: i(9 | 64 << 12) + i(len(s)) + s.encode()
    strings = lambda *s: i(16) + i(len(s)) + b"".join(map(chars, s))
    symbol = lambda s: i(1) + chars(s)
    nil = i(254)
    attrs = i(2 | 1024) + symbol("names") + strings("subid", "firstrun.dur", "lang") + i(2 | 1024) + symbol("class") + strings("data.frame") + nil
    factor = i(13 | 512 | 256) + i(2) + i(2) + i(1) + i(2 | 1024) + symbol("levels") + strings("du", "en") + nil
    value = i(19 | 512 | 256) + i(3) + strings("s1", "s2") + i(14) + i(2) + struct.pack(">dd", 1.5, float("nan")) + factor + attrs
    raw = b"RDX2\nX\n" + i(2) + i(0) + i(0) + i(2 | 1024) + symbol("df") + value + nil
    (tmp_path / "x.rda").write_bytes(gzip.compress(raw))
    rows = binary.r_frames(spark, str(tmp_path / "x.rda"), "subid string, firstrun_dur double, lang string, sentnum double").collect()
    assert [(r.subid, r.lang, r.sentnum) for r in rows] == [("s1", "en", None), ("s2", "du", None)] and rows[0].firstrun_dur == 1.5


def test_sinks(spark, tmp_path):
    preds = spark.createDataFrame([("u", 1, "u_1", "b"), ("u", 0, "u_0", "a"), ("v", 0, "v_0", 'c"')], "uid string, ord int, id string, pred string")
    sinks.write_predictions(preds, str(tmp_path / "p"))
    got = {}
    for r in spark.read.text(str(tmp_path / "p")).collect():
        got |= json.loads(r.value)
    assert got == {"u": {"predictions": [{"id": "u_0", "pred": "a"}, {"id": "u_1", "pred": "b"}]}, "v": {"predictions": [{"id": "v_0", "pred": 'c"'}]}}
    (tmp_path / "one.json").write_text(json.dumps(got))
    assert files.uid_predictions(spark, str(tmp_path / "one.json")).count() == 3
    acc = spark.createDataFrame([("b", 50.0), ("a", 75.125)], "uid string, accuracy double")
    assert [r.value for r in sinks.report_lines(acc, "uid").collect()] == ["a: 75.13", "b: 50.00", "### AVERAGE ACCURACY", "62.56"]
    sinks.write_report(acc, str(tmp_path / "r"), "uid")
    sinks.write_json(preds, str(tmp_path / "j"), by="uid")
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    sinks.write_csv(acc, str(tmp_path / "c"))
    for step in (1, 2, 1):
        sinks.append_step(spark.createDataFrame([(step, "w")], "step int, word string"), str(tmp_path / "s"), "step")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    tags = spark.createDataFrame([(0, ["N", "V", "N"], [3, -100, 1])], "i int, t array<string>, g array<int>")
    assert sinks.tag_lines(tags, "i", "t", "g").first().value == "0\tN N"
    assert json.loads(sinks.submission({"zero_shot": acc.select(F.col("uid").alias("name"), F.col("accuracy").alias("score"))})) == {"zero_shot": {"a": 75.125, "b": 50.0}}


def test_stream_resumes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def write(name, n):
        (src / name).write_text("".join(json.dumps({"task": "t", "revision": "r", "item_id": k, "correct": 1.0}) + "\n" for k in range(n)))

    def run():
        sweeps.resumable_counts(sweeps.score_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "ck"))
        return sweeps.totals(spark, str(tmp_path / "out")).first().n

    write("a.jsonl", 3)
    assert run() == 3
    write("b.jsonl", 4)
    assert run() == 7
    assert run() == 7


def test_checks(spark):
    assert len(checks.expected_sizes()) == 67 + 11 + 4 + 5 + 7 + 18 + 6 and len(checks.expected_sizes(fast=True)) == 67 + 5 + 11 + 6 + 1
    shapes = spark.createDataFrame([("trog", [76, 4, 1], "float32"), ("things", [1854, 1854], "int64"), ("things", [1, 1854], "float64"), ("other", [1], "float64")], "subtask string, shape array<long>, dtype string")
    assert [r.ok for r in checks.shape_report(shapes).collect()] == [True, False, False, False]
    pred = spark.createDataFrame([("A",)] * 2 + [("x",)], "uid string")
    want = spark.createDataFrame([("a", 2), ("b", 1)], "uid string, expected_rows int")
    assert {r.uid: r.status for r in checks.size_report(pred, want, ["uid"]).collect()} == {"a": "ok", "b": "missing", "x": "unknown"}
    gold = spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), ("u", 3, "c")], "uid string, ord int, v string")
    assert checks.positional_join(gold, gold.where("ord < 3"), "uid", "ord").count() == 2
    with pytest.raises(Exception, match="no prediction for 3"):
        checks.keyed_join(gold.select("ord", "v"), gold.where("ord < 3").select("ord", F.col("v").alias("p")), "ord").collect()
    checks.same_labels(gold.select("uid", "v"), "uid", "v")
    with pytest.raises(ValueError):
        checks.same_labels(gold.select("ord", "v"), "ord", "v")
    assert checks.remaining(gold, gold.where("ord = 2"), "ord").count() == 2
    assert checks.one_each(gold, "uid").first().n == 3
    assert [len(checks.required_paths("main", "causal", f, m)) for f, m in ((True, False), (False, False), (False, True))] == [7, 16, 21]
    with pytest.raises(Exception, match="not finite"):
        spark.range(1).select(checks.finite_or_fail(F.lit(float("nan")), "not finite")).collect()


def test_missing_paths(spark, tmp_path):
    need = checks.required_paths("main", "causal", True)
    for p in need[:3]:
        (tmp_path / "model" / p).parent.mkdir(parents=True)
        (tmp_path / "model" / p).write_text("{}")
    assert sorted(r.path for r in checks.missing_paths(spark, str(tmp_path / "model"), need).collect()) == sorted(need[3:])


def test_collation(spark):
    rows = spark.createDataFrame([(0, "grp"), (1, "  a"), (2, "  b"), (3, "other"), (4, " c")], "ord int, alias string")
    filled = collate.header_fill(rows, "ord", collate.indent(F.col("alias")) == 0, F.col("alias"))
    assert [r.header for r in filled.orderBy("ord").collect()] == ["grp"] * 3 + ["other"] * 2
    scores = spark.createDataFrame([("m", "a", 50.0), ("m", "b", 61.0), ("n", "a", 70.0)], "model string, task string, v double")
    table = collate.leaderboard(scores, "model", "task", "v").orderBy("model")
    assert [(r.model, r.a, r.b, r.avg) for r in table.collect()] == [("m", 50.0, 61.0, 55.5), ("n", 70.0, None, 70.0)]
    assert collate.markdown(table, "model").splitlines()[-1] == "| n | **70.00** |  | **70.00** |"
    assert {(r.model, r.task) for r in collate.best_marks(scores, ["task"], "v").where("is_best").collect()} == {("n", "a"), ("m", "b")}
    parts = [spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), spark.createDataFrame([("b", 2)], "k string, v int")]
    assert {r.k: r.v for r in collate.merged(parts, ["k"]).collect()} == {"a": 1, "b": 2}
    langs = spark.createDataFrame([(["eng", "nld"],), ([],)], "l array<string>").select(collate.language_rank(F.col("l")).alias("r"))
    assert [r.r for r in langs.collect()] == [3, 7]


def test_frames(spark):
    rows = [("i", 1, 1, 10.0), ("i", 2, 1, 20.0), ("i", 2, 1, 21.0), ("i", 3, None, 30.0), ("i", 4, None, 40.0), ("i", 6, None, 60.0)]
    df = spark.createDataFrame(rows, "itemid string, wordnum int, sentnum int, v double")
    got = sorted((r.wordnum, r.v, r.v1p, r.v2p) for r in frames.spillover(df.drop("sentnum"), ["v"]).collect())
    assert got == [(1, 10.0, 20.0, 30.0), (1, 10.0, 21.0, 30.0), (2, 20.0, 30.0, 40.0), (2, 21.0, 30.0, 40.0)]
    assert [r.wordnum for r in frames.trim_edges(df, ["itemid", "sentnum"]).collect()] == [4]
    assert frames.null_safe_join(df, df.withColumn("w", F.lit(1)), df.columns).count() == 6
    assert sorted(r.v for r in frames.first_of(df, ["itemid", "wordnum"], "v").collect()) == [10.0, 20.0, 30.0, 40.0, 60.0]
    z = [r.z_v for r in frames.z_scores(df, ["v"]).collect()]
    assert np.mean(z) == pytest.approx(0, abs=1e-12) and np.std(z, ddof=1) == pytest.approx(1)


def test_contexts_and_vocabulary(spark):
    docs = spark.createDataFrame([(1, "the dog runs"), (2, "the cat"), (3, "the dog sleeps"), (4, "x"), (5, None)], "doc_id int, text string")
    counts = ngrams.context_counts(ngrams.prefix_contexts(docs))
    assert {(r.context, r.next_word): r.n for r in counts.collect()} == {("the", "dog"): 2, ("the", "cat"): 1, ("the dog", "runs"): 1, ("the dog", "sleeps"): 1}
    assert ngrams.prefix_contexts(docs, context=1).where("context = 'dog'").count() == 2
    stats = {r.context: r for r in ngrams.context_statistics(counts).collect()}
    assert stats["the"].n == 3 and stats["the"].frequency == pytest.approx(0.6) and stats["the"].log_per_million == pytest.approx(np.log10(6e5))
    words = {r.word: r.n for r in ngrams.word_frequencies(docs).collect()}
    assert words["the"] == 3 and sum(words.values()) == 9
    assert ngrams.top_contexts(counts, top=1, order="seed").groupBy("word").count().where("count > 1").count() == 0
    vocabulary = spark.createDataFrame([("the",), ("dog",), ("runs",), ("x",)], "word string")
    assert {r.doc_id for r in ngrams.vocabulary_filter(docs, "doc_id", ["text"], vocabulary).collect()} == {1, 4, 5}


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (2.0, 5.0), (4.0, 9.0), (None, 1.0), (float("nan"), 3.0)], "a double, b double")
    assert metrics.correlations(df, "a", ["b"]).first().n == 4
    r = metrics.rank_correlation(df.where("a is not null and not isnan(a)"), "a", "b").first()
    assert r.rho == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4], [2, 1, 3, 4])[0, 1])
    labels = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "g int, p int")
    m = metrics.binary_metrics(labels, "g", "p").first()
    assert (m.accuracy, m.f1) == (0.75, pytest.approx(2 / 3)) and m.mcc == pytest.approx(2 / np.sqrt(1 * 2 * 2 * 3))
    assert metrics.binary_metrics(labels.where("g = 0"), "g", "p").first().mcc == 0
    assert metrics.macro_f1(labels, "g", "p").first().macro_f1 == pytest.approx((2 / 3 + 4 / 5) / 2)
    assert metrics.squared_error(labels, "g", "p").first().mse == 0.25


def test_splits(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    parts = {r.split: r["count"] for r in splits.share_split(df, "id", {"train": 0.8, "valid": 0.1, "test": 0.1}).groupBy("split").count().collect()}
    assert sum(parts.values()) == 1000 and 750 < parts["train"] < 850 and min(parts.values()) > 60
    exact = splits.exact_split(df, ["g"], F.col("id"), {"train": 0.8, "valid": 0.2}).groupBy("g", "split").count()
    assert {(r.g, r.split): r["count"] for r in exact.collect()} == {(0, "train"): 268, (0, "valid"): 66, (1, "train"): 267, (1, "valid"): 66, (2, "train"): 267, (2, "valid"): 66}
    assert splits.sample(df, "id", 10).count() == 10 and splits.sample(df.limit(5), "id", 10).count() == 5
    assert splits.uniform_mixture(df.where("g <> 1 or id < 9"), "g", F.col("id")).count() == 9
    with pytest.raises(ValueError):
        splits.share_split(df, "id", {"a": 0.5})


def test_numbers_by_ranges_are_row_numbers(spark):
    # one group of two thirds of the rows, a null group and null values
    rows = [("hot" if k % 3 else [None, "a", "b"][k % 7 % 3], (k * 7919) % 3001 if k else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int")
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r[1] for r in rows if r[0] == g), key=lambda o: (o is not None, o))
        want |= {(g, o): (n, len(own)) for n, o in enumerate(own, 1)}
    padded = F.when(F.col("o").isNotNull(), F.lpad(F.col("o").cast("string"), 5, "0"))
    for order in ("o", padded, F.col("o").cast("timestamp")):
        got = frames.numbered(df, ["g"], order, "n", size="s").collect()
        assert {(r.g, r.o): (r.n, r.s) for r in got} == want and len(got) == 3000
    few = frames.numbered(df, ["g"], "o", "n", most=5).collect()
    assert {(r.g, r.o): r.n for r in few} == {k: n for k, (n, _) in want.items() if n <= 5}
    ties = frames.numbered(df.select("g", F.lit(1).alias("o")), ["g"], "o", "n").groupBy("g").agg(F.count("*").alias("c"), F.countDistinct("n").alias("d"), F.max("n").alias("m")).collect()
    assert all(r.c == r.d == r.m for r in ties)
    assert frames.numbered(df.where("o < 0"), ["g"], "o", "n").count() == 0


def test_reading_frame_is_the_null_equal_join(spark):
    rows = [("i", w, s, v) for w, s, v in [(1, 1, 1.0), (2, 1, 2.0), (2, 1, 2.0), (3, 1, None), (4, 1, 4.0), (5, 1, 5.0), (1, None, 1.5), (2, None, 2.5), (3, None, 3.5)]]
    df = spark.createDataFrame(rows, "itemid string, wordnum int, sentnum int, v double")
    want = frames.null_safe_join(frames.trim_edges(df, ["itemid", "sentnum"]), frames.spillover(df, ["v"]), df.columns)
    got = frames.reading_frame(df, ["v"])
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, map(tuple, want.collect()))) and got.count() > 5
