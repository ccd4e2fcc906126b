"""Task registries: YAML files with includes and groups, flattened to tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession


def parse(text: str) -> dict:
    """The top of a task file: scalars (quoted ones over several lines too), lists of scalars, lists of mappings by their `task` or `metric`, and whether groups weight by size. Tags such as !function are kept as text."""
    out: dict = {}
    key = None
    lines = iter(text.splitlines())
    for line in lines:
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if m := re.match(r"([A-Za-z_]+)\s*:\s*(.*)$", line):
            key, value = m[1], m[2].strip()
            if value[:1] in ("'", '"'):
                while not _closed(value):
                    more = next(lines, None)
                    if more is None:
                        raise ValueError(f"{key}: a quote isn't closed")
                    value = _folded(value, more.strip())
            out[key] = _scalar(value) if value and value not in ("|", ">", "|-") else []
        elif key and (m := re.match(r"\s*-\s+(.*)$", line)):
            if isinstance(out[key], list):
                item = re.sub(r"^(task|metric)\s*:\s*", "", m[1].strip())
                out[key].append(_scalar(item))
        if re.search(r"weight_by_size\s*:\s*true", line, re.I):
            out["weight_by_size"] = True
    return out


def _closed(value: str) -> bool:
    """Whether a quoted scalar ends in its quote: '' stands for a quote within single quotes, \\" within double ones."""
    body = value[1:].split(" #")[0] if value.rstrip().endswith(("'", '"')) else value[1:]
    return bool(re.fullmatch(r"(?:[^']|'')*'\s*" if value[0] == "'" else r'(?:[^"\\]|\\.)*"\s*', body, re.S))


def _folded(value: str, more: str) -> str:
    """A quoted scalar with its next line: line ends are spaces, an empty line is a line end, a backslash joins."""
    if value.endswith("\\") and value[0] == '"':
        return value[:-1] + more
    if not more:
        return value + "\n"
    return value + ("" if value.endswith("\n") else " ") + more


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", " ": " "}


def _scalar(x: str):
    if x[:1] == '"' and _closed(x):
        return re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), x.rstrip()[1:-1])
    if x[:1] == "'" and _closed(x):
        return x.rstrip()[1:-1].replace("''", "'")
    x = x.split(" #")[0].strip()
    return {"true": True, "false": False, "null": None}.get(x.lower(), x)


def _config_files(spark: SparkSession, folder: str):
    """(path, text) of task files in any store; names may begin with an underscore, which Spark's readers skip."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    found = fs.listFiles(root, True)
    while found.hasNext():
        path = found.next().getPath()
        if re.search(r"(\.ya?ml|_yaml)$", path.getName()):
            stream = fs.open(path)
            try:
                yield path.toString(), jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """(name, parent, dataset, split, metric, scorer, weight_by_size, folder, row_filter, doc_to_text, doc_to_choice, doc_to_target): a row for each task and for each member of each group.

    scorer and row_filter are tags, whose meaning may depend on the folder (see operators.scorers);
    choices that are a list are its JSON.

    A file's own settings win over those that it includes. Task files are small and few
    against data, so they are resolved in the driver.
    """
    texts = {path: parse(text) for path, text in _config_files(spark, folder)}

    def resolved(path: str, seen: tuple = ()) -> dict:
        own = texts[path]
        base = own.get("include")
        target = None if not base else path.rsplit("/", 1)[0] + "/" + base
        if target in texts and target not in seen:
            return resolved(target, (*seen, path)) | own
        return own

    rows = []
    for path in sorted(texts):
        spec = resolved(path)
        if "group" in texts[path]:
            members = spec.get("task") if isinstance(spec.get("task"), list) else [spec.get("task")]
            rows += [(str(m), str(spec["group"]), None, None, None, None, bool(spec.get("weight_by_size", False)), None, None, None, None, None) for m in members if m]
        elif isinstance(texts[path].get("task"), str):
            metric = spec.get("metric_list")
            choice = spec.get("doc_to_choice")
            texts_ = [spec.get("doc_to_text") or None, json.dumps(choice) if isinstance(choice, list) else choice, None if spec.get("doc_to_target") is None else str(spec["doc_to_target"])]
            rows.append((spec["task"], None, spec.get("dataset_path"), spec.get("test_split"), metric[0] if isinstance(metric, list) and metric else None, spec.get("process_results"), False, path.rsplit("/", 1)[0], spec.get("process_docs"), *texts_))
    return spark.createDataFrame(rows, "name string, parent string, dataset string, split string, metric string, scorer string, weight_by_size boolean, folder string, row_filter string, doc_to_text string, doc_to_choice string, doc_to_target string")


def leaves(registry_: DataFrame, group: str) -> list[str]:
    """The tasks under a group, through groups within it."""
    edges: dict[str, list[str]] = {}
    for r in registry_.where("parent is not null").select("parent", "name").collect():
        edges.setdefault(r["parent"], []).append(r["name"])
    out, todo, seen = [], [group], set()
    while todo:
        name = todo.pop()
        if name in seen:
            continue
        seen.add(name)
        if name in edges:
            todo += edges[name]
        else:
            out.append(name)
    return sorted(out)
