"""Writers of predictions, reports and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nested_predictions(df: DataFrame, uid: str = "uid", order: str = "ord", fields: tuple[str, ...] = ("id", "pred")) -> DataFrame:
    """(uid, json): each uid's predictions in order, as {"predictions": [...]}."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), *fields)))
    bare = F.transform(listed, lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return df.groupBy(uid).agg(F.to_json(F.struct(bare.alias("predictions"))).alias("json"))


def write_predictions(df: DataFrame, path: str, **how) -> None:
    """Lines of {uid: {"predictions": [...]}}, one a uid; tasks write their own."""
    uid = how.get("uid", "uid")
    quoted = F.regexp_extract(F.to_json(F.struct(F.col(uid).cast("string").alias("k"))), r"^\{\"k\":(.*)\}$", 1)
    nested_predictions(df, **how).select(F.concat(F.lit("{"), quoted, F.lit(": "), "json", F.lit("}"))).write.mode("overwrite").text(path)


def report_lines(accuracies: DataFrame, key: str, value: str = "accuracy") -> DataFrame:
    """(value): lines of `key: accuracy` with two digits and, after ### AVERAGE, their mean."""
    body = accuracies.select(F.lit(0).alias("o"), F.col(key).cast("string").alias("k"), F.format_string("%s: %.2f", F.col(key).cast("string"), F.col(value)).alias("value"))
    mean = accuracies.agg(F.avg(value).alias("m"))
    tail = mean.select(F.explode(F.array(F.struct(F.lit(1).alias("o"), F.lit("").alias("k"), F.lit("### AVERAGE ACCURACY").alias("value")), F.struct(F.lit(2).alias("o"), F.lit("").alias("k"), F.format_string("%.2f", F.col("m")).alias("value")))).alias("x")).select("x.*")
    return body.unionByName(tail).orderBy("o", "k").select("value")


def write_report(accuracies: DataFrame, path: str, key: str, value: str = "accuracy") -> None:
    report_lines(accuracies, key, value).coalesce(1).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, in a folder for each value of `by` if given."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def append_step(df: DataFrame, path: str, step: str) -> None:
    """Adds a step's rows; a step written before is replaced, so a sweep can be taken up again."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(step).parquet(path)


def tag_lines(df: DataFrame, index: str, tags: str, gold: str, ignore: int = -100) -> DataFrame:
    """(value): index and predicted tags, those left out whose gold label is `ignore`."""
    both = F.filter(F.arrays_zip(F.col(tags).alias("t"), F.col(gold).alias("g")), lambda x: x.g != ignore)
    return df.select(F.concat_ws("\t", F.col(index).cast("string"), F.concat_ws(" ", F.transform(both, lambda x: x.t.cast("string")))).alias("value"))


def submission(parts: dict[str, DataFrame]) -> str:
    """One JSON object of score tables (name, score): small by nature, so it comes to the driver."""
    import json

    return json.dumps({k: {r["name"]: r["score"] for r in df.select("name", "score").orderBy("name").collect()} for k, df in parts.items()}, ensure_ascii=False, indent=1)
