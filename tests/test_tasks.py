"""Templates of task files, scorers and row filters by their tags."""

import math

import pytest
from pyspark.sql import functions as F

from lexigauge.functions import templates
from lexigauge.operators import scorers
from lexigauge.sources import tasks

DOC = "q string, a string, n int, x double, ok boolean, c array<string>, s struct<t:string,k:int>, m map<string,string>"
ROW = ("  Why?\u00a0 ", "be", 3, None, True, ["u", "v", "w"], ("deep", 7), {"k": "v1"})


@pytest.mark.parametrize(
    ("template", "want"),
    [
        ("{{q.strip()}}\nA. {{a}}", "Why?\nA. be"), ("", ""), ("plain {x} text", "plain {x} text"), ("{{ n }}/{{x}}/{{ok}}", "3/None/True"),
        ("{{c[0]}}{{c[-1]}}{{c[9]}}", "uwNone"), ("{{s.t}} {{s.k}} {{m['k']}} {{m.none}}", "deep 7 v1 None"), ("{{a|upper}}{{a.upper()|lower}}{{ a|replace('b', 'c') }}", "BEbece"),
        ("{{c|join(', ')}}|{{c|length}}|{{a|length}}", "u, v, w|3|2"), ("{{c|first}}{{c|last}}", "uw"), ("{{'it\\'s' ~ n}}", "it's3"), ('{{"x" + a}}', "xbe"), ("{{n + 1}}{{n - 1}}", "42"),
        ("{% if n > 2 %}big{% elif n == 2 %}two{% else %}small{% endif %}!", "big!"), ("{% if x %}a{% else %}b{% endif %}", "b"), ("{% if ok and not (n == 4 or a == 'no') %}y{% endif %}", "y"),
        ("{% if a in c %}in{% endif %}{% if 'b' in a %}sub{% endif %}", "sub"), ("{{ 'p' if n == 3 else 'q' }}{{ 'p' if n != 3 }}", "p"), ("a {%- if ok -%} b {%- endif -%} c", "abc"), ("{# note #}z", "z"),
        ("{% if n == '3' %}same{% else %}other{% endif %}", "other"), ("{{a.split('b')[1]}}", "e"), ("{{x|default('none')}}", "none"), ("{{ a|capitalize }}{{ 3 }}", "Be3"), ("{% if ok %}{% if n == 3 %}1{% endif %}2{% endif %}", "12"),
    ],
)
def test_templates(spark, template, want):
    df = spark.createDataFrame([ROW], DOC)
    assert df.select(templates.rendered(template, df.schema).alias("t")).first().t == want


@pytest.mark.parametrize("template", ["{{missing}}", "{{q.title()}}", "{{q|nope}}", "{% for x in c %}{% endfor %}", "{% if ok %}", "{% endif %}", "{{q", "{{c}} x", "{{n ? 1}}", "{{n < a}}", "{{q.}}", "{{a - 'b'}}", "{% if ok %}a{% else %}b", "{{s['t']}}", "{{q[0]}}", "{{(a}}"])
def test_what_is_not_known_is_an_error(spark, template):
    df = spark.createDataFrame([ROW], DOC)
    with pytest.raises(ValueError):
        templates.Template(template, df.schema).value().text()
        if template == "{{q":
            raise ValueError("text as it is")


def test_forms_of_task_files(spark):
    """Every form that the task files use."""
    docs = spark.createDataFrame([(" Q ", "1", "2", "3", "4", "B", "good", "bad", "T", "p", ["x", "y"], 1, "travel")], "question string, option_a string, option_b string, option_c string, option_d string, answer string, sentence_good string, sentence_bad string, text string, prompt string, choices array<string>, label int, category string")
    text = "{{question.strip()}}\nA. {{option_a}}\nB. {{option_b}}\nC. {{option_c}}\nD. {{option_d}}\nAnswer:"
    r = templates.prompts(docs, {"doc_to_text": text, "doc_to_choice": ["A", "B", "C", "D"], "doc_to_target": "answer"}).first()
    assert (r.prompt, r.choices, r.gold) == ("Q\nA. 1\nB. 2\nC. 3\nD. 4\nAnswer:", ["A", "B", "C", "D"], 1)
    r = templates.prompts(docs, {"doc_to_text": "prompt", "doc_to_choice": "choices", "doc_to_target": "label"}).first()
    assert (r.prompt, r.choices, r.gold) == ("p", ["x", "y"], 1)
    r = templates.prompts(docs, {"doc_to_text": "", "doc_to_choice": "{{[sentence_good, sentence_bad]}}", "doc_to_target": 0}).first()
    assert (r.prompt, r.choices, r.gold) == ("", ["good", "bad"], 0)
    r = templates.prompts(docs, {"doc_to_text": "Given the categories, what category does the text: '{{text}}' belong to:", "doc_to_choice": '["sports", "travel"]', "doc_to_target": "{{category}}"}).first()
    assert (r.prompt, r.gold) == ("Given the categories, what category does the text: 'T' belong to:", 1)
    assert templates.prompts(docs, {"doc_to_text": "", "doc_to_choice": ["a"], "doc_to_target": "category"}).first().gold == -100
    with pytest.raises(ValueError):
        templates.prompts(docs, {"doc_to_text": "", "doc_to_choice": "{{text}}", "doc_to_target": 0})


def test_task_files(spark, tmp_path):
    (tmp_path / "global_mmlu" / "full" / "en").mkdir(parents=True)
    (tmp_path / "global_mmlu" / "full" / "en" / "a.yaml").write_text("task: a\ndoc_to_text: \"{{q}}\\n\n  D. {{d}} \\\"x\\\"\\\n  joined\"\ndoc_to_choice:\n  - A\n  - B\ndoc_to_target: answer\nprocess_docs: !function 'utils.process_world_religions'\n")
    (tmp_path / "b.yaml").write_text("task: b\ndoc_to_text: 'Given the,\n\n  text: ''{{text}}'' here'\ndoc_to_target: 0\n")
    own = {r.name: r for r in tasks.registry(spark, str(tmp_path)).collect()}
    assert own["a"].doc_to_text == '{{q}}\n D. {{d}} "x"joined' and own["a"].doc_to_choice == '["A", "B"]' and own["a"].doc_to_target == "answer"
    assert own["b"].doc_to_text == "Given the,\ntext: '{{text}}' here" and own["b"].doc_to_target == "0" and own["b"].row_filter is None
    rows = spark.createDataFrame([("world_religions",), ("virology",), ("World Religions",), (None,)], "subject string")
    assert rows.where(scorers.row_filter(own["a"].row_filter, own["a"].folder)).count() == 2
    assert scorers.row_filter(None, "x") is None
    rows = spark.createDataFrame([("Arts & Humanities",), ("STEM",)], "domain string")
    assert rows.where(scorers.row_filter("!function 'utils.process_arts_humanities'", "/t/include/default/Dutch")).count() == 1
    for bad in (("!function utils.other", "/t/include"), ("!function utils.process_x", "/t/elsewhere")):
        with pytest.raises(ValueError):
            scorers.row_filter(*bad)


def registry(spark, rows):
    return spark.createDataFrame([(n, None, s, f, m) for n, s, f, m in rows], "name string, parent string, scorer string, folder string, metric string")


CANDIDATES = "task string, item_id long, cand_idx int, score double, n_tokens int, n_chars int, has_unk boolean, label int"


def test_rules_of_ties(spark):
    """(2, 1) is right, (1, 2) wrong, a tie worth half, nothing or all, by the task's rule."""
    pairs = {1: (2.0, 1.0), 2: (1.0, 2.0), 3: (1.0, 1.0), 4: (math.nan, 1.0), 5: (None, None), 6: (3.0, 1.0)}
    rows = [(t, i, k, s, 1, 1, i == 6 and k == 1, 0) for t in ("part", "hanzi", "plain") for i, p in pairs.items() for k, s in enumerate(p)]
    tags = registry(spark, [("part", "!function tie_handling.process_results", "/x/multi", "acc"), ("hanzi", "!function utils.process_results", "/x/hanzi", "acc"), ("plain", None, "/x", "acc"), ("unused", None, None, "acc")])
    got = {}
    for r in scorers.item_credits(spark.createDataFrame(rows, CANDIDATES), scorers.rules(tags, listed_only=True)).collect():
        got.setdefault(r.task, {})[r.item_id] = r.credit
    assert got == {"part": {1: 1.0, 2: 0.0, 3: 0.5, 4: 0.0, 5: 0.5, 6: 1.0}, "hanzi": {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0}, "plain": {1: 1.0, 2: 0.0, 3: 1.0, 4: 0.0, 5: 1.0, 6: 1.0}}


def test_lengths_and_labels(spark):
    rows = [("l", 1, k, s, nt, nc, False, 1) for k, (s, nt, nc) in enumerate([(-4.0, 1, 8), (-6.0, 3, 2), (-9.0, 9, 0)])] + [("l", 2, 0, 1.0, 1, 1, False, -100)]
    rows += [("g", i, k, s, nt, nc, u, lab) for _, i, k, s, nt, nc, u, lab in rows]
    tags = registry(spark, [("l", "tie_handling.process_results_labeled", None, "acc"), ("g", "!function utils.process_results", "/x/global_piqa_parallel", "acc_norm")])
    got = {(r.task, r.metric, r.item_id): r.credit for r in scorers.item_credits(spark.createDataFrame(rows, CANDIDATES), scorers.rules(tags)).collect()}
    assert got == {("l", "acc", 1): 0.0, ("l", "acc_norm", 1): 0.0, ("l", "acc", 2): 0.0, ("l", "acc_norm", 2): 0.0, ("g", "acc_norm", 1): 0.0, ("g", "acc_norm", 2): 0.0}
    right = [(t, i, k, s, nt, nc, u, 2 if t == "g" else 0) for t, i, k, s, nt, nc, u, _ in rows if i == 1]
    got = {(r.task, r.metric): (r.items, r.value) for r in scorers.task_scores(spark.createDataFrame(right, CANDIDATES), tags).collect()}
    assert got == {("l", "acc"): (1, 1.0), ("l", "acc_norm"): (1, 1.0), ("g", "acc_norm"): (1, 1.0)}


def test_registering(spark):
    with pytest.raises(ValueError):
        scorers.metrics_of("!function other.score")
    with pytest.raises(ValueError):
        scorers.register("other.score", scorers.Metric("acc", "seeded"))
    scorers.register("other.score", scorers.Metric("exact", "strict"))
    try:
        assert scorers.metrics_of("!function other.score", "/any/folder")[0].name == "exact"
    finally:
        del scorers.SCORERS["other.score"]


def test_one_shuffle_of_candidates(spark):
    tags = registry(spark, [("a", None, None, "acc")])
    df = scorers.task_scores(spark.createDataFrame([("a", 1, 0, 1.0, 1, 1, False, 0)], CANDIDATES), tags)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan
    assert F.broadcast is not None and plan.count("HashAggregate") >= 4
