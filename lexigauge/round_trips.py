"""Queries that write what a table holds by a sink, or as files of a known layout, and read it back by a source."""

from __future__ import annotations

import io
import json
import tempfile
import uuid

import numpy as np
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from .functions import templates
from .operators import checks, frames, ranking, scorers, splits
from .queries import query
from .session import table
from .sources import binary, files, sinks, tasks


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or a temporary one on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base or tempfile.mkdtemp()}/{name}-{uuid.uuid4()}"


def put(spark: SparkSession, path: str, content: str | bytes) -> None:
    """One small file, in any store that Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(content.encode() if isinstance(content, str) else content))
    finally:
        out.close()


def _shares(spark, d):
    """(event_type, accuracy, n): a row for each type."""
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.avg((F.col("value") > 10).cast("double")).alias("accuracy"), F.count("*").alias("n"))


@query("SELECT source AS uid, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS ord, source || '_' || CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS VARCHAR) AS id, lang AS pred FROM documents")
def written_predictions(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("uid"), F.col("doc_id").alias("ord"), F.col("lang").alias("pred"))
    path = shared_folder(spark, "predictions")
    sinks.write_predictions(ranking.prediction_ids(docs, "ord"), path)
    return files.uid_predictions(spark, path, lines=True)


@query("WITH s AS (SELECT event_type, round(100.0 * sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) / count(*), 2) AS score, 100.0 * sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) / count(*) AS raw FROM events GROUP BY 1) SELECT event_type, score, (SELECT round(avg(raw), 2) FROM s) AS average FROM s")
def written_report(spark, d):
    path = shared_folder(spark, "report")
    sinks.write_report(_shares(spark, d).withColumn("accuracy", 100 * F.col("accuracy")), path, "event_type")
    return files.reports(spark, path, "*.txt").select(F.explode("scores").alias("event_type", "score"), "average")


@query("SELECT lang, doc_id, source, n_chars FROM documents")
def written_json_by_domain(spark, d):
    path = shared_folder(spark, "domains")
    sinks.write_json(table(spark, d, "documents").select("lang", "doc_id", "source", "n_chars"), path, by="lang")
    return spark.read.schema("doc_id long, source string, n_chars long, lang string").json(path)


@query("SELECT CAST(event_id AS BIGINT) AS event_id, CASE WHEN event_type = 'view' THEN 'None' ELSE event_type END AS item, value FROM events")
def written_csv(spark, d):
    path = shared_folder(spark, "times")
    e = table(spark, d, "events")
    sinks.write_csv(e.select("event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("item"), "value"), path)
    return files.reading_times(spark, path, "event_id long, item string, value double")


@query("SELECT event_type AS word, CAST(16 + user_id % 3 AS INT) AS age, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 6) AS proportion FROM events GROUP BY 1, 2")
def written_vocabulary_shares(spark, d):
    path = shared_folder(spark, "vocabulary")
    e = table(spark, d, "events").select(F.col("event_type").alias("word"), (16 + F.col("user_id") % 3).cast("string").alias("age"), (F.col("value") > 10).cast("double").alias("known"))
    sinks.write_csv(e.groupBy("word").pivot("age", ["16", "17", "18"]).agg(F.avg("known")), path)
    return files.vocabulary_shares(spark, path).where("proportion is not null").withColumn("proportion", F.round("proportion", 6))


@query("SELECT CAST(event_id AS VARCHAR) AS itemid, event_type AS word, 'a' AS model, value AS surprisal FROM events UNION ALL SELECT CAST(event_id AS VARCHAR), event_type, 'b', value * 2 FROM events")
def written_surprisal_table(spark, d):
    path = shared_folder(spark, "surprisal")
    e = table(spark, d, "events")
    rows = e.select("event_id", F.lit("all of it").alias("FullText"), F.col("event_id").cast("double").alias("itemid"), F.concat(F.lit(" "), "event_type").alias("word"), F.col("value").alias("a"), (F.col("value") * 2).alias("b"))
    rows.withColumnRenamed("event_id", "Unnamed: 0").write.option("ignoreLeadingWhiteSpace", False).csv(path, sep="\t", header=True)
    return files.long_surprisal(files.surprisal_table(spark, path), ["itemid", "word"])


@query("SELECT n_name AS word FROM nation")
def written_target_words(spark, d):
    path = shared_folder(spark, "targets") + ".txt"
    table(spark, d, "nation").select(F.concat(F.lit(" "), "n_name").alias("value")).write.text(path)
    return files.target_words(spark, path)


@query("SELECT r_name AS word, n_name AS context FROM region JOIN nation ON n_regionkey = r_regionkey")
def written_word_contexts(spark, d):
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    each = both.groupBy("r_name").agg(F.collect_list(F.struct(F.col("n_name").alias("context"))).alias("c"))
    path = shared_folder(spark, "contexts")
    each.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", "c")))).alias("value")).write.text(path)
    return files.word_contexts(spark, path).select("word", F.explode("contexts").alias("context"))


@query("SELECT CAST(doc_id AS INT) AS index, CAST(n_chars % 5 AS VARCHAR) || ' ' || CAST(n_chars % 2 AS VARCHAR) AS prediction FROM documents")
def written_tag_lines(spark, d):
    n = F.col("n_chars")
    docs = table(spark, d, "documents").select("doc_id", F.array(n % 5, n % 3, n % 2).alias("tags"), F.array(F.lit(0), F.lit(-100), F.lit(1)).alias("gold"))
    path = shared_folder(spark, "tags")
    sinks.tag_lines(docs, "doc_id", "tags", "gold").write.text(path)
    return files.predictions_text(spark, path).select("index", "prediction")


@query("SELECT event_type AS step, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def written_steps(spark, d):
    """The steps once with half their rows, then one by one with all: each replaces its own."""
    e = table(spark, d, "events").select(F.col("event_type").alias("step"), "event_id", "value")
    path = shared_folder(spark, "steps")
    sinks.append_step(e.where("event_id % 2 = 0"), path, "step")
    for step in [r[0] for r in e.select("step").distinct().collect()]:
        sinks.append_step(e.where(F.col("step") == step), path, "step")
    return spark.read.parquet(path).groupBy("step").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT 'events_' || event_type AS name, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 6) AS score FROM events GROUP BY 1 UNION ALL SELECT 'rows_' || event_type, CAST(count(*) AS DOUBLE) FROM events GROUP BY 1")
def written_submission(spark, d):
    shares = _shares(spark, d)
    path = shared_folder(spark, "submission") + "/submission.json"
    put(spark, path, sinks.submission({"events": shares.select(F.col("event_type").alias("name"), F.round("accuracy", 6).alias("score")), "rows": shares.select(F.col("event_type").alias("name"), F.col("n").cast("double").alias("score"))}))
    return files.nested_scores(spark, path)


@query("SELECT 'tiny' AS model, event_type AS task, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 6) AS acc FROM events GROUP BY 2")
def newest_task_results(spark, d):
    """A first file of a model with wrong values for all tasks, then one a task with right ones."""
    rows = _shares(spark, d).collect()
    base = shared_folder(spark, "results") + "/org__tiny"
    put(spark, f"{base}/results_2024-01-01.json", json.dumps({"results": {r["event_type"]: {"alias": r["event_type"], "acc": -1.0} for r in rows}}))
    for k, r in enumerate(rows):
        put(spark, f"{base}/results_2024-02-{k + 1:02d}.json", json.dumps({"results": {r["event_type"]: {"alias": r["event_type"], "acc": r["accuracy"]}}}))
    return files.task_results(spark, base).select("model", "task", F.round(F.col("metrics")["acc"].cast("double"), 6).alias("acc"))


@query("SELECT CASE WHEN event_type = 'view' THEN 'xx' ELSE event_type END AS lang, CASE WHEN event_type = 'view' THEN 'pos' ELSE 'qa' END AS task, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS samples FROM events GROUP BY event_type")
def finetune_result_folders(spark, d):
    base = shared_folder(spark, "finetune")
    for r in _shares(spark, d).collect():
        where = "pos/xx" if r["event_type"] == "view" else f"{r['event_type']}/qa"
        put(spark, f"{base}/{where}/eval_results.json", json.dumps({"eval_accuracy": r["accuracy"], "eval_samples": r["n"], "epoch": 3.0}, indent=1))
    return files.finetune_results(spark, base).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT n_regionkey AS region, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS ord, n_name AS name FROM nation")
def numbered_json_lines(spark, d):
    """A file of lines for each region, beside one that isn't read."""
    base = shared_folder(spark, "lines")
    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()
    for key in {r["n_regionkey"] for r in rows}:
        put(spark, f"{base}/{key}.jsonl", "".join(json.dumps({"region": key, "name": r["n_name"]}) + "\n" for r in rows if r["n_regionkey"] == key))
    put(spark, f"{base}/notes.txt", '{"region": 9, "name": "x"}\n')
    return files.json_lines(spark, base, "region long, name string", numbered=True).select("region", "ord", "name")


@query("SELECT n_nationkey AS doc_id, n_name AS target, CASE WHEN n_regionkey = 1 THEN 'hanzi_structure' ELSE 'hanzi_pinyin' END AS task FROM nation WHERE n_regionkey < 2")
def newest_sample_logs(spark, d):
    """An old log of each task with a wrong row, then a newer one; only the one that comes last by name is read."""
    base = shared_folder(spark, "samples")
    for key, task in ((0, "hanzi_pinyin"), (1, "hanzi_structure")):
        own = table(spark, d, "nation").where(F.col("n_regionkey") == key).collect()
        put(spark, f"{base}/samples_{task}_2024-01-01.jsonl", json.dumps({"doc_id": -1, "doc_hash": "x", "target": "old"}) + "\n")
        put(spark, f"{base}/samples_{task}_2024-02-01.jsonl", "".join(json.dumps({"doc_id": r["n_nationkey"], "doc_hash": f"h{r['n_nationkey']}", "target": r["n_name"]}) + "\n" for r in own))
    return files.newest_samples(spark, base, "doc_id long, doc_hash string, target string").select("doc_id", "target", "task")


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INT) AS trial, n_name AS text1, 1 AS images, 2 AS texts FROM nation")
def manifest_trials(spark, d):
    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()
    path = shared_folder(spark, "manifest") + "/manifest.csv"
    put(spark, path, "image1,text1,text2\n" + "".join(f"{r['n_nationkey']}.png,{r['n_name']},{r['n_regionkey']}\n" for r in rows))
    trials, images, texts = files.manifest(spark, path)
    return trials.select("trial", "text1", F.lit(images).alias("images"), F.lit(texts).alias("texts"))


@query("SELECT 't_' || n_nationkey AS task, 'org/' || r_name AS dataset, CASE WHEN n_nationkey % 2 = 0 THEN 'test' ELSE 'validation' END AS split, 'all' AS root FROM nation JOIN region ON n_regionkey = r_regionkey")
def task_registry_leaves(spark, d):
    """A base file for each region, a group of its nations' tasks that include it, and a group of these groups; every second task has a split of its own."""
    base = shared_folder(spark, "registry")
    regions = table(spark, d, "region").collect()
    put(spark, f"{base}/all.yaml", "group: all\ntask:\n" + "".join(f"  - g_{r['r_regionkey']}\n" for r in regions))
    for r in regions:
        key = r["r_regionkey"]
        own = [n["n_nationkey"] for n in table(spark, d, "nation").where(F.col("n_regionkey") == key).collect()]
        put(spark, f"{base}/_base_{key}_yaml", f"dataset_path: org/{r['r_name']}\ntest_split: validation\n")
        put(spark, f"{base}/g_{key}.yaml", f"group: g_{key}\ntask:\n" + "".join(f"  - t_{n}\n" for n in own))
        for n in own:
            put(spark, f"{base}/t_{n}.yaml", f"include: _base_{key}_yaml\ntask: t_{n}\n" + ("test_split: test\n" if n % 2 == 0 else ""))
    known = tasks.registry(spark, base)
    under = spark.createDataFrame([(name,) for name in tasks.leaves(known, "all")], "name string")
    return known.where("parent is null").join(under, "name").select(F.col("name").alias("task"), "dataset", "split", F.lit("all").alias("root"))


@query("SELECT CAST(n_nationkey AS INT) AS i, CAST(n_nationkey + n_regionkey * 100 AS DOUBLE) AS total FROM nation")
def stored_matrix_rows(spark, d):
    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()
    held = io.BytesIO()
    np.save(held, np.array([[r["n_nationkey"], r["n_regionkey"] * 100] for r in rows], np.float32).reshape(len(rows), 2, 1))
    path = shared_folder(spark, "matrix") + "/a.npy"
    put(spark, path, held.getvalue())
    return binary.matrix_rows(spark, path).select("i", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"))


_TASK_FILES = {
    "multi/_base_yaml": "dataset_path: org/data\ntest_split: test\nmetric_list:\n  - metric: acc\n    aggregation: mean\n",
    "multi/t_0.yaml": "include: _base_yaml\ntask: t_0\nprocess_results: !function tie_handling.process_results\n",
    "multi/t_1.yaml": "include: _base_yaml\ntask: t_1\nprocess_results: !function tie_handling.process_results_labeled\n",
    "hanzi/t_2.yaml": "task: t_2\nprocess_results: !function utils.process_results\nmetric_list:\n  - metric: acc\n",
    "global_piqa_parallel/t_3.yaml": "task: t_3\nprocess_results: !function utils.process_results\nmetric_list:\n  - metric: acc_norm\n",
    "multi/t_4.yaml": "include: _base_yaml\ntask: t_4\n",
}


@query("""WITH c AS (SELECT 't_' || l_orderkey % 5 AS task, l_orderkey AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS k, -l_quantity AS s, 1 + l_suppkey % 7 AS nt, 1 + l_partkey % 11 AS nc, l_returnflag = 'R' AS unk, l_orderkey % 3 AS label FROM lineitem),
r(task, metric, policy, len, g) AS (VALUES ('t_0', 'acc', 'part', '', 0), ('t_1', 'acc', 'part', '', -1), ('t_1', 'acc_norm', 'part', 'c', -1), ('t_2', 'acc', 'strict', '', 0), ('t_3', 'acc_norm', 'first', 't', -1), ('t_4', 'acc', 'first', '', -1), ('t_4', 'acc_norm', 'first', 'c', -1)),
x AS (SELECT c.task, metric, policy, item, k, CASE len WHEN '' THEN s WHEN 'c' THEN s / nc ELSE s / nt END AS s, k = CASE WHEN g < 0 THEN label ELSE g END AS gold, policy = 'strict' AND unk AS bad FROM c JOIN r USING (task)),
m AS (SELECT *, max(s) OVER (PARTITION BY task, metric, item) AS top FROM x),
i AS (SELECT task, metric, policy, item, count(*) FILTER (s = top) AS n, bool_or(s = top AND gold) AS g, min(k) FILTER (s = top) AS first, min(k) FILTER (s = top AND gold) AS hit, bool_or(bad) AS bad FROM m GROUP BY 1, 2, 3, 4)
SELECT task, metric, count(*) AS items, round(avg(CASE WHEN bad OR NOT g THEN 0 WHEN policy = 'part' THEN 1 / n WHEN policy = 'strict' THEN CASE WHEN n = 1 THEN 1 ELSE 0 END ELSE CASE WHEN hit = first THEN 1 ELSE 0 END END), 6) AS value FROM i GROUP BY 1, 2""")
def scored_by_task_tags(spark, d):
    """Tasks with five rules of scoring, read from their files, in one pass over all candidates."""
    base = shared_folder(spark, "scorers")
    for name, content in _TASK_FILES.items():
        put(spark, f"{base}/{name}", content)
    rows = table(spark, d, "lineitem")
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    rows = rows.select(F.concat(F.lit("t_"), F.col("l_orderkey") % 5).alias("task"), F.col("l_orderkey").alias("item_id"), k.alias("cand_idx"), (-F.col("l_quantity")).alias("score"), (1 + F.col("l_suppkey") % 7).alias("n_tokens"), (1 + F.col("l_partkey") % 11).alias("n_chars"), (F.col("l_returnflag") == "R").alias("has_unk"), (F.col("l_orderkey") % 3).cast("int").alias("label"))
    out = scorers.task_scores(rows, tasks.registry(spark, base))
    return out.withColumn("value", F.round("value", 6))


@query("""SELECT p_partkey AS item_id, trim(p_name) || chr(10) || 'A. ' || p_brand || chr(10) || ' B. ' || upper(p_type) || CASE WHEN p_size > 25 THEN ' (large)' WHEN p_size = 1 THEN ' (one)' ELSE '' END || chr(10) || 'Answer:' AS prompt, p_brand || '|' || p_type AS choices, 1 AS gold FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, p_name, 'A|B|C|D', CASE WHEN p_size < 4 THEN CAST(p_size AS INT) ELSE -100 END FROM part WHERE p_partkey % 2 = 1""")
def templated_prompts(spark, d):
    """Prompts, choices and targets as task files write them: a template, or names of columns."""
    base = shared_folder(spark, "templates")
    put(spark, f"{base}/t_0.yaml", 'task: t_0\ndoc_to_text: "{{p_name.strip()}}\\nA. {{p_brand}}\\n\n  B. {{p_type|upper}}{% if p_size > 25 %} (large){% elif p_size == 1 %} (one){% endif %}\\nAnswer:"\ndoc_to_choice: \'{{[p_brand, p_type]}}\'\ndoc_to_target: 1\n')
    put(spark, f"{base}/t_1.yaml", "task: t_1\ndoc_to_text: p_name\ndoc_to_choice:\n  - A\n  - B\n  - C\n  - D\ndoc_to_target: target\n")
    specs = {r["name"]: r.asDict() for r in tasks.registry(spark, base).collect()}
    target = F.when(F.col("p_size") < 4, F.get(F.array(*map(F.lit, "ABCD")), F.col("p_size").cast("int"))).otherwise("none")
    parts = table(spark, d, "part").withColumn("target", target)
    out = [templates.prompts(parts.where(F.col("p_partkey") % 2 == k), specs[f"t_{k}"]) for k in (0, 1)]
    return out[0].union(out[1]).select(F.col("p_partkey").alias("item_id"), "prompt", F.array_join("choices", "|").alias("choices"), "gold")


@query("SELECT CASE WHEN CAST('0x' || substr(md5('7|' || doc_id), 1, 12) AS BIGINT) / 281474976710656.0 < 0.8 THEN 'train' ELSE 'valid' END AS split, doc_id, lang, n_chars FROM documents")
def written_splits(spark, d):
    """Training and validation rows as JSON lines, in a folder each."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    path = shared_folder(spark, "splits")
    sinks.write_json(splits.share_split(docs, "doc_id", {"train": 0.8, "valid": 0.2}, seed=7), path, by="split")
    schema = "doc_id long, lang string, n_chars long"
    out = [spark.read.schema(schema).json(f"{path}/split={name}").select(F.lit(name).alias("split"), "doc_id", "lang", "n_chars") for name in ("train", "valid")]
    return out[0].union(out[1])


_SUBSETS = [("click", 400), ("view", 40_000), ("purchase", 700), ("nothing", 5)]


@query(f"""WITH e(uid, n) AS (VALUES {", ".join(f"('{u}', {n})" for u, n in _SUBSETS)}), r AS (SELECT event_type AS uid, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k, CASE WHEN value > 5 THEN value END AS pred FROM events), p AS (SELECT uid, CASE WHEN k = 7 THEN 6 ELSE k END AS place, pred FROM r),
f AS (SELECT uid, count(*) AS found, count(DISTINCT CASE WHEN place < n THEN place END) AS different, count(*) FILTER (pred IS NULL) AS bad FROM p JOIN e USING (uid) GROUP BY uid)
SELECT e.uid, CAST(n AS BIGINT) AS expected_rows, coalesce(found, 0) AS found_rows, coalesce(different, 0) AS different, coalesce(bad, 0) AS bad, CASE WHEN found IS NULL THEN 'missing' WHEN found <> n THEN 'wrong size' WHEN different <> n THEN 'repeated' WHEN bad > 0 THEN 'no value' ELSE 'ok' END AS status FROM e LEFT JOIN f ON e.uid = f.uid
UNION ALL SELECT NULL, 0, count(*), 0, 0, 'unknown' FROM p WHERE uid NOT IN (SELECT uid FROM e) HAVING count(*) > 0""")
def checked_while_written(spark, d):
    """Predictions are written and checked by one job; each subset's eighth prediction has the seventh's place."""
    rows = frames.numbered(table(spark, d, "events").select(F.col("event_type").alias("uid"), "event_id", F.when(F.col("value") > 5, F.col("value")).alias("pred")), ["uid"], "event_id", "n")
    rows = rows.select("uid", F.when(F.col("n") == 8, 6).otherwise(F.col("n") - 1).alias("place"), "pred")
    rows, found = checks.observed(rows, _SUBSETS)
    rows.write.parquet(shared_folder(spark, "observed"))
    return checks.verdict(spark, found, _SUBSETS)
