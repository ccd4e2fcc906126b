import pytest
from pyspark.sql import functions as F

from lexigauge import schemas
from lexigauge.functions import text
from lexigauge.operators import decode


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_minimal_pairs(spark):
    rows = frame(spark, [("g", "b", "syntax_semantics", "u", "t", "/x/a.jsonl"), ("g", "b", None, None, None, "/x/qa_easy.jsonl")], schemas.MINIMAL_PAIR + ", file string")
    a, b = decode.decode(rows, "blimp").collect()
    assert a.sentences == ["g", "b"] and a.prefixes == [None, None] and a.uid == "u" and a.meta["field"] == "syntax/semantics" and a.label == 0
    assert b.uid == "qa_easy" and b.meta == {"UID": "qa_easy", "field": "supplement", "linguistics_term": "supplement"}


def test_context_pairs(spark):
    r = decode.decode(frame(spark, [("c1", "c2", "t1", "t2", "dom", "ct", "cd", "td")], schemas.CONTEXT_PAIR), "ewok").first()
    assert r.sentences == ["c1 t1", "c2 t1"] and r.completions == [" t1", " t1"] and r.meta["context_type"] == "ct"


def test_options_with_nothing_are_left_out(spark):
    rows = frame(spark, [("p ", ["a", "nothing here"], 1, "/x/regular.jsonl"), ("p ", ["a", "b", "c"], 2, "/x/regular.jsonl")], schemas.STATE_OPTIONS + ", file string")
    (r,) = decode.decode(rows, "entity_tracking").collect()
    assert r.uid == "regular_2_ops" and r.sentences == ["p a", "p b", "p c"] and r.prefixes == ["p "] * 3


@pytest.mark.parametrize(("stem", "uid"), [("comps_base", "base"), ("comps_wugs", "wugs"), ("comps_wugs_dist-before", "wugs_dist_before"), ("other", "wugs_dist_in_between")])
def test_property_pairs(spark, stem, uid):
    r = decode.decode(frame(spark, [("a", "b", "p", f"/x/{stem}.jsonl")], schemas.PROPERTY_PAIR + ", file string"), "comps").first()
    assert r.uid == uid and r.sentences == ["a p", "b p"]


def test_questions_captions_solutions(spark):
    r = decode.decode(frame(spark, [("q", "x", ["y", "z"], 3)], schemas.QUESTION), "vqa").first()
    assert r.sentences == ["q x", "q y", "q z"] and r.completions == [" x", " y", " z"]
    r = decode.decode(frame(spark, [("a", "b", "Object", "Noun", "Sub", 1, "k")], schemas.CAPTIONS), "winoground").first()
    assert r.meta["Linguistic Sub-Feature"] == "Noun Sub"
    rows = frame(spark, [("p", "a", "b", "c", "d", 2, "e7")], schemas.SOLUTIONS)
    r = decode.decode(rows, "global_piqa_parallel").first()
    assert len(r.sentences) == 4 and r.label == 2 and r.uid == "e7"
    assert len(decode.decode(rows, "global_piqa_nonparallel").first().sentences) == 2
    with pytest.raises(NotImplementedError):
        decode.decode(rows, "no such task")


def test_sentence_columns():
    assert decode.sentence_columns(["idx", "premise", "hypothesis", "label"]) == (["premise"], ["hypothesis"], None)
    assert decode.sentence_columns(["paragraph", "question", "answer"])[2] == "Question: {} Answer: {}"
    assert decode.sentence_columns(["sentence", "linguistic_feature_type", "label"]) == (["sentence"], [], None)
    assert decode.sentence_columns(["u", "v", "w", "label"]) == (["u"], ["v"], None)
    assert decode.sentence_columns(["u"]) == (["u"], [], None)


def test_unified_records(spark):
    r = decode.unified(frame(spark, [(1, " pass ", "q", "a", "b", "c", "d", "2")], "idx long, flores_passage string, question string, mc_answer1 string, mc_answer2 string, mc_answer3 string, mc_answer4 string, correct_answer_num string"), "belebele").first()
    assert r.sentence == "pass\nq\nA: a\nB: b\nC: c\nD: d\n" and r.label == "B"
    r = decode.unified(frame(spark, [("q", "a", "b", "c", "d", 3)], "question string, option_a string, option_b string, option_c string, option_d string, answer int"), "include").first()
    assert r.sentence == "q\nA. a\nB. b\nC. c\nD. d\n" and r.label == "D"
    r = decode.unified(frame(spark, [("q", "['it\"s', 'b', \"c's\", 'd']", "C")], "question string, choices string, answer string"), "afrimmlu").first()
    assert r.label == "C" and "B. b" in r.sentence
    rows = frame(spark, [("cause", "p", "x", "y", 0), ("effect", "p", "x", "y", 1), ("?", "p", "x", "y", 1)], "question string, premise string, choice1 string, choice2 string, label int")
    assert [(r.sentence1, r.sentence2) for r in decode.unified(rows, "xcopa").collect()] == [("x p", "y p"), ("p x", "p y"), ("", "")]
    prompt = "Premise: one\ntwo\nHypothesis: three \n Question: which?"
    r = decode.unified(frame(spark, [(prompt, ["e", "n"], "1")], "prompt string, choices array<string>, label string"), "mubench", "mnli").first()
    assert (r.premise, r.hypothesis, r.label) == ("one\ntwo", "three", "n")
    r = decode.unified(frame(spark, [("Question: Why?\nAnswer with A, B, C, D.\nAnswer:", ["e"], "4")], "prompt string, choices array<string>, label string"), "mubench", "arc").first()
    assert r.sentence == "Why?" and r.label is None


def test_swapped_and_steps(spark):
    rows = decode.swapped(frame(spark, [(1, "a", "b")], "id int, x string, y string"), [("x", "y")]).collect()
    assert sorted((r.turned, r.x, r.y) for r in rows) == [(0, "a", "b"), (1, "b", "a")]
    steps = frame(spark, [(1,), (2,)], "step int")
    assert decode.step_rows(steps, frame(spark, [("w", ["c", "d"])], "word string, contexts array<string>")).count() == 4


def test_word_ids_and_samples(spark):
    r = frame(spark, [([None, 3, 3, 5, None], [9, 8, 7, 6, 5, 4])], "w array<int>, l array<int>").select(*[c.alias(n) for n, c in zip("il", decode.remap_word_ids(F.col("w"), F.col("l")), strict=True)]).first()
    assert r.i == [-1, 0, 0, 1, -1] and r.l == [6, 4]
    rows = frame(spark, [([["-1", "x"], ["-2", "x"]], "0", 1.0), ([["-1", "x"], ["-2", "x"]], "0", 0.0)], "resps array<array<string>>, target string, acc double")
    pred, unk = decode.two_scores(F.col("resps"), F.col("target"), F.col("acc"))
    assert [tuple(r) for r in rows.select(pred, unk).collect()] == [(0, False), (0, True)]
    bad = frame(spark, [([["nan", "x"], ["-2", "x"]], "0", 1.0)], rows.schema)
    with pytest.raises(Exception, match="two finite scores"):
        bad.select(pred).collect()


def test_text_functions(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    assert one(text.strip(F.lit("　 a b\t\n "))) == "a b"
    assert one(text.words(F.lit(" a  b\nc "))) == ["a", "b", "c"]
    assert [one(text.magnitude(F.lit(x))) for x in ("chck_10M", "1.5k", "x", "2B", "7")] == [1e7, 1500.0, None, 2e9, 7.0]
    assert [one(text.normal_id(F.lit(x))) for x in ("1.0", "12", "a.0", "1.5")] == ["1", "12", "a.0", "1.5"]
    choices = F.array(*map(F.lit, "abc"))
    assert [one(text.gold_index(F.lit(x), choices)) for x in ("b", "2", "zz", "-1")] == [1, 2, -100, -100]
    assert one(text.literal_list(F.lit("['a', 'b']"))) == ["a", "b"]
    assert one(text.file_stem(F.lit("/a/b.c/name.x.jsonl"))) == "name.x"
    assert one(text.languages_of_model(F.lit("en_nld_zho_equal"))) == ["eng", "nld", "zho"]
    assert one(text.languages_of_model(F.lit("gpt2-babylm-nld"))) == ["nld"]
    assert one(text.languages_of_model(F.lit("Strict-Small"))) == ["eng"]
    assert one(text.task_language(F.lit("sib200_bul_Cyrl"), "sib200", {"bg": "bul"})) == "bg"
    assert one(text.fill('Does "{}" refer to "{}"?', F.lit("x"), F.lit("y"))) == 'Does "x" refer to "y"?'
    assert one(text.starred(F.lit("pre*tar*"))[1]) == "tar"
