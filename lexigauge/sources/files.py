"""Readers of benchmark, result and score files. All read through Spark, so any store that it knows will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import file_stem, normal_id, strip, words
from ..operators.collate import last_wins


def _file() -> Column:
    return F.col("_metadata.file_path")


def json_lines(spark: SparkSession, folder: str, schema: str | None = None, numbered: bool = False) -> DataFrame:
    """Rows of all .jsonl files under a folder, with `file`; numbered adds `ord`, the line's place in its file. A schema saves a pass over the data."""
    reader = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true")
    df = (reader.schema(schema) if schema else reader).json(folder).select("*", _file().alias("file"), F.col("_metadata.file_block_start").alias("__at"))
    if numbered:
        df = df.withColumn("__k", F.monotonically_increasing_id())
        df = df.withColumn("ord", F.row_number().over(Window.partitionBy("file").orderBy("__at", "__k")) - 1).drop("__k")
    return df.drop("__at")


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def reading_times(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV of reading times; a missing item is the text None."""
    return spark.read.schema(schema).csv(path, header=True).withColumn("item", F.coalesce("item", F.lit("None")))


def vocabulary_shares(spark: SparkSession, path: str, ages: range = range(16, 31)) -> DataFrame:
    """(word, age, proportion) of a wide CSV with a column for each month; an error if it has none."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    own = [str(a) for a in ages if str(a) in df.columns]
    if not own:
        raise ValueError(f"{path} has no age column")
    return df.unpivot(["word"], own, "age", "proportion").select("word", F.col("age").cast("int").alias("age"), F.col("proportion").cast("double").alias("proportion"))


def surprisal_table(spark: SparkSession, path: str) -> DataFrame:
    """A TSV (gzip too) of surprisals: item ids as text, trimmed words, without index and full-text columns."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=True)
    drop = [c for c in df.columns if c in ("FullText", "FullTextMarked", "_c0", "") or c.startswith("Unnamed")]
    return df.drop(*drop).withColumn("itemid", normal_id(F.col("itemid"))).withColumn("word", strip(F.col("word")))


def long_surprisal(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model, surprisal) of a table with a column for each model."""
    return df.unpivot(keys, [c for c in df.columns if c not in keys], "model", "surprisal")


def word_contexts(spark: SparkSession, path: str, least_contexts: int = 1) -> DataFrame:
    """(word, contexts) of a JSON object from words to lists of {context}; words of one letter or with too few contexts are left out."""
    text = spark.read.text(path, wholetext=True)
    each = text.select(F.explode(F.from_json("value", "map<string,array<struct<context:string>>>")).alias("word", "c"))
    return each.select("word", F.col("c.context").alias("contexts")).where((F.length("word") > 1) & (F.size("contexts") >= least_contexts))


def target_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a .txt file's lines or a .csv file's word column."""
    if path.endswith(".txt"):
        return spark.read.text(path).select(strip(F.col("value")).alias("word")).where("word <> ''")
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True).select(strip(F.col("word")).alias("word")).where("word is not null")
    raise ValueError(f"{path} is neither .txt nor .csv")


def task_results(spark: SparkSession, folder: str) -> DataFrame:
    """(model, task, place, alias, metrics) of results_*.json under a folder; of a task in several files of a model the last file's. The model's name is its folder's after the last double underscore."""
    text = spark.read.option("pathGlobFilter", "results*.json").option("recursiveFileLookup", "true").text(folder, wholetext=True)
    parts = F.split(_file(), "/")
    rows = text.select(F.element_at(F.split(F.get(parts, F.size(parts) - 2), "__"), -1).alias("model"), _file().alias("file"), F.from_json(F.get_json_object("value", "$.results"), "map<string,map<string,string>>").alias("r"), F.json_object_keys(F.get_json_object("value", "$.results")).alias("names"))
    each = rows.select("model", "file", "r", F.posexplode("names").alias("place", "task")).select("model", "task", "file", "place", F.col("r")[F.col("task")].alias("metrics"))
    out = last_wins(each.withColumn("metrics", F.to_json("metrics")), ["model", "task"], ["file"])
    out = out.withColumn("metrics", F.from_json("metrics", "map<string,string>"))
    return out.select("model", "task", "file", "place", F.col("metrics")["alias"].alias("alias"), "metrics")


def finetune_results(spark: SparkSession, folder: str) -> DataFrame:
    """(lang, task, accuracy, samples) of <lang>/<task>/eval_results.json; those under pos/ have the two the other way round."""
    schema = "eval_accuracy double, eval_samples long, epoch double"
    df = spark.read.option("pathGlobFilter", "eval_results.json").option("recursiveFileLookup", "true").option("multiLine", "true").schema(schema).json(folder)
    parts = F.split(_file(), "/")
    outer, inner = F.get(parts, F.size(parts) - 3), F.get(parts, F.size(parts) - 2)
    pos = outer == "pos"
    return df.select(F.when(pos, inner).otherwise(outer).alias("lang"), F.when(pos, outer).otherwise(inner).alias("task"), F.col("eval_accuracy").alias("accuracy"), F.col("eval_samples").alias("samples"))


def predictions_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, index, prediction) of tab-separated lines: the header and blank lines are skipped; what follows the first tab is the prediction, empty without one."""
    parts = F.split("value", "\t", 2)
    rows = spark.read.text(path).select(_file().alias("file"), F.get(parts, F.lit(0)).alias("index"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("prediction"))
    return rows.where((F.trim("index") != "") & (F.col("index") != "index")).withColumn("index", F.col("index").try_cast("int"))


def newest_samples(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(task, rows) of the samples_<task>_<date>.jsonl that comes last by name for each task; (doc_id, doc_hash) twice in a task is an error when it is read."""
    df = spark.read.option("pathGlobFilter", "samples_*.jsonl").option("recursiveFileLookup", "true").schema(schema).json(folder).select("*", F.col("_metadata.file_name").alias("name"))
    df = df.withColumn("task", F.regexp_extract("name", r"^samples_(.*)_[^_]*\.jsonl$", 1))
    last = df.groupBy("task").agg(F.max("name").alias("name"))
    n = F.count("*").over(Window.partitionBy("task", "doc_id", "doc_hash"))
    out = df.join(F.broadcast(last), ["task", "name"]).withColumn("__n", n)
    return out.where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("a sample occurs twice in "), F.col("task"))).cast("boolean")).otherwise(True)).drop("__n", "name")


def newest_by_time(spark: SparkSession, folder: str, pattern: str, key: str) -> DataFrame:
    """(key, file) of the file modified last for each key, which `key` (an expression with one group) takes from paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    rows = files.select(F.regexp_extract("path", key, 1).alias("key"), "path", "modificationTime")
    return rows.groupBy("key").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("file"))


def reports(spark: SparkSession, folder: str, name: str = "*report*.txt") -> DataFrame:
    """(file, average, scores): the number on the line after ### AVERAGE, and `key: value` lines as a map."""
    text = spark.read.option("pathGlobFilter", name).option("recursiveFileLookup", "true").text(folder, wholetext=True)
    pairs = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.struct(F.regexp_extract(x, r"^\s*([^:#]+?)\s*:\s*[-+]?[\d.]+", 1).alias("k"), F.regexp_extract(x, r"^\s*[^:#]+?\s*:\s*([-+]?[\d.]+)", 1).try_cast("double").alias("v"))), lambda x: (x.k != "") & x.v.isNotNull())
    return text.select(_file().alias("file"), F.regexp_extract("value", r"(?m)^### AVERAGE[^\n]*\n\s*([-+]?[\d.]+)", 1).try_cast("double").alias("average"), F.map_from_entries(F.array_distinct(pairs)).alias("scores"))


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """A stimulus table with `trial` from 1, and how many image and text columns it has."""
    import re

    df = spark.read.csv(path, header=True)
    images, texts = (len([c for c in df.columns if re.fullmatch(rf"{kind}\d", c)]) for kind in ("image", "text"))
    trial = F.row_number().over(Window.orderBy("__k"))  # a manifest has a row for each stimulus, so it is small
    return df.withColumn("__k", F.monotonically_increasing_id()).withColumn("trial", trial).drop("__k"), images, texts


def nested_scores(spark: SparkSession, path: str) -> DataFrame:
    """(name, score) of {task: {language: score}}: names are task_language."""
    text = spark.read.text(path, wholetext=True)
    each = text.select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("task", "m")).select("task", F.explode("m").alias("lang", "score"))
    return each.select(F.concat_ws("_", "task", "lang").alias("name"), "score")


def uid_predictions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(uid, ord, id, pred) of {uid: {predictions: [{id, pred}]}}: one object a file or, with lines, a line."""
    text = spark.read.text(path, wholetext=not lines)
    each = text.select(F.explode(F.from_json("value", "map<string,struct<predictions:array<struct<id:string,pred:string>>>>")).alias("uid", "p"))
    return each.select("uid", F.posexplode("p.predictions").alias("ord", "x")).select("uid", "ord", "x.id", "x.pred")


def step_surprisals(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a surprisal log's results, NaN as null."""
    schema = "metadata map<string,string>, results array<struct<step:string,word_count:double,target_word:string,context_id:int,context:string,surprisal:double>>"
    rows = json_document(spark, path, schema).select(F.explode("results").alias("r")).select("r.*")
    return rows.withColumn("surprisal", F.when(~F.isnan("surprisal"), F.col("surprisal")))


def corpus_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(line tokens) of text files."""
    return spark.read.text(path).select(words(F.col("value")).alias("tokens"))


def uid_from_file(df: DataFrame) -> DataFrame:
    return df.withColumn("uid", file_stem(F.col("file")))
