"""Validation of submissions: sizes, missing tasks, completeness, required files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .frames import numbered

#: Expected numbers of predictions by subset. Fixed values.
BLIMP_SIZES = {
    "superlative_quantifiers_2": 986, "superlative_quantifiers_1": 979, "anaphor_gender_agreement": 971, "principle_a_reconstruction": 967,
    "irregular_past_participle_adjectives": 961, "sentential_subject_island": 961, "wh_island": 960, "left_branch_island_simple_question": 951,
    "coordinate_structure_constraint_object_extraction": 949, "tough_vs_raising_1": 948, "left_branch_island_echo_question": 947, "principle_a_c_command": 946,
    "regular_plural_subject_verb_agreement_2": 945, "irregular_past_participle_verbs": 942, "determiner_noun_agreement_with_adj_2": 941, "principle_a_domain_3": 941,
    "determiner_noun_agreement_with_adjective_1": 933, "anaphor_number_agreement": 931, "determiner_noun_agreement_2": 931, "existential_there_quantifiers_1": 930,
    "determiner_noun_agreement_1": 929, "matrix_question_npi_licensor_present": 929, "adjunct_island": 928, "existential_there_subject_raising": 924, "animate_subject_trans": 923,
    "drop_argument": 920, "tough_vs_raising_2": 920, "wh_vs_that_with_gap": 919, "sentential_negation_npi_licensor_present": 919, "principle_a_case_2": 915,
    "principle_a_domain_2": 915, "principle_a_domain_1": 914, "npi_present_2": 914, "principle_a_case_1": 912, "existential_there_quantifiers_2": 911,
    "wh_vs_that_with_gap_long_distance": 910, "npi_present_1": 909, "coordinate_structure_constraint_complex_left_branch": 906, "passive_2": 903, "wh_questions_subject_gap": 898,
    "animate_subject_passive": 895, "irregular_plural_subject_verb_agreement_2": 892, "regular_plural_subject_verb_agreement_1": 890, "only_npi_licensor_present": 882,
    "wh_vs_that_no_gap_long_distance": 875, "distractor_agreement_relative_clause": 871, "sentential_negation_npi_scope": 871, "intransitive": 868, "transitive": 868,
    "wh_vs_that_no_gap": 861, "wh_questions_object_gap": 859, "wh_questions_subject_gap_long_distance": 857, "inchoative": 855, "complex_np_island": 846, "passive_1": 840,
    "determiner_noun_agreement_with_adj_irregular_2": 840, "only_npi_scope": 837, "ellipsis_n_bar_2": 828, "determiner_noun_agreement_irregular_2": 820, "causative": 818,
    "existential_there_object_raising": 812, "irregular_plural_subject_verb_agreement_1": 804, "ellipsis_n_bar_1": 802, "distractor_agreement_relational_noun": 788,
    "expletive_it_object_raising": 759, "determiner_noun_agreement_with_adj_irregular_1": 718, "determiner_noun_agreement_irregular_1": 681,
}
SUPPLEMENT_SIZES = {"hypernym": 842, "qa_congruence_easy": 64, "qa_congruence_tricky": 165, "subject_aux_inversion": 3867, "turn_taking": 280}
EWOK_SIZES = {
    "agent-properties": 2210, "social-relations": 1548, "physical-relations": 818, "material-dynamics": 770, "physical-interactions": 556, "spatial-relations": 490,
    "social-properties": 328, "quantitative-properties": 314, "social-interactions": 294, "material-properties": 170, "physical-dynamics": 120,
}
ENTITY_SIZES = {
    "regular_0_ops": 517, "regular_1_ops": 409, "regular_2_ops": 405, "regular_3_ops": 425, "regular_4_ops": 388, "regular_5_ops": 94,
    "ambiref_0_ops": 508, "ambiref_1_ops": 428, "ambiref_2_ops": 413, "ambiref_3_ops": 409, "ambiref_4_ops": 434, "ambiref_5_ops": 123,
    "move_contents_0_ops": 516, "move_contents_1_ops": 437, "move_contents_2_ops": 399, "move_contents_3_ops": 406, "move_contents_4_ops": 353, "move_contents_5_ops": 116,
}
COMPS_SIZES = {"base": 49340, "wugs_dist_before": 13896, "wugs_dist_in_between": 13896, "wugs": 13896}
GLUE_SIZES = {"boolq": 1635, "mnli": 4908, "mrpc": 204, "multirc": 2424, "qqp": 20215, "rte": 139, "wsc": 52}
SINGLE_SIZES = {"reading": 1726, "aoa_step": 8005, "winoground": 746, "vqa": 25230, "global_piqa_parallel": 103, "global_piqa_nonparallel": 100}
#: The same of a fast submission: each subset of a task has one size, but for entity tracking. Fixed values.
FAST_SIZES = {"blimp": 200, "blimp_supplement": 50, "ewok": 100}
FAST_ENTITY_SIZES = {"regular_0_ops": 517, "regular_1_ops": 409, "regular_2_ops": 405, "regular_3_ops": 425, "regular_4_ops": 388, "regular_5_ops": 94}
#: Shapes of the matrices of a developmental benchmark. Fixed values.
MATRIX_SHAPES = {"things": (1854, 1854), "trog": (76, 4, 1), "lex-viz_vocab": (119, 4, 1)}
#: Tasks that a leaderboard scores itself, and what it expects of each language. Fixed values.
SERVER_SCORED = ("hanzi_structure", "hanzi_pinyin", "meco_l1", "meco_l2")
EXPECTED_ZEROSHOT = {
    "eng": ["blimp", "hellaswag_en_mubench", "multiblimp_eng", "winogrande_en_mubench", "xstorycloze_en_mubench", "global_piqa_parallel_en", "global_piqa_nonparallel_en"],
    "nld": ["blimp_nl", "hellaswag_nl_mubench", "multiblimp_nld", "winogrande_nl_mubench", "xcomps_nl", "xstorycloze_nl_mubench", "global_piqa_parallel_nl", "global_piqa_nonparallel_nl"],
    "zho": ["hellaswag_zh_mubench", "winogrande_zh_mubench", "xcomps_zh", "xstorycloze_zh_mubench", "zhoblimp", "hanzi_structure", "hanzi_pinyin", "global_piqa_parallel_zh", "global_piqa_nonparallel_zh"],
}
EXPECTED_FINETUNE = {
    "en": ["arc", "belebele", "bmlama", "mnli", "pos", "sib200", "truthfulqa", "xnli"],
    "nl": ["arc", "belebele", "bmlama", "include", "mnli", "pos", "sib200", "truthfulqa"],
    "zh": ["arc", "belebele", "bmlama", "include", "mnli", "pos", "sib200", "truthfulqa", "xnli"],
}


def expected_sizes(fast: bool = False) -> list[tuple[str, str, int]]:
    """(task, uid, rows) of a full or a fast submission."""
    subsets = {"ewok": EWOK_SIZES, "blimp": BLIMP_SIZES, "blimp_supplement": SUPPLEMENT_SIZES}
    if fast:
        rows = [(task, uid, FAST_SIZES[task]) for task, sizes in subsets.items() for uid in sizes]
        return [*rows, *(("entity_tracking", uid, n) for uid, n in FAST_ENTITY_SIZES.items()), ("reading", "reading", SINGLE_SIZES["reading"])]
    rows = [(task, uid, n) for task, sizes in (subsets | {"entity_tracking": ENTITY_SIZES, "comps": COMPS_SIZES, "glue": GLUE_SIZES}).items() for uid, n in sizes.items()]
    return rows + [(task, task, n) for task, n in SINGLE_SIZES.items()]


def expected_tasks() -> list[tuple[str, str, str]]:
    """(kind, language, task) that a leaderboard expects of each language that a submission covers."""
    return [(kind, lang, task) for kind, table in (("zeroshot", EXPECTED_ZEROSHOT), ("finetune", EXPECTED_FINETUNE)) for lang, tasks in table.items() for task in tasks]


def reported(scores: DataFrame, task: str = "task", alias: str = "alias", include_server_scored: bool = False) -> DataFrame:
    """Rows of a result table that go into a submission: tasks one step in by their alias, and known tasks at any depth; not those that the leaderboard scores itself, unless asked for."""
    known = [t for tasks in EXPECTED_ZEROSHOT.values() for t in tasks]
    name = F.coalesce(F.col(alias), F.col(task))
    out = scores.where((F.length(name) - F.length(F.ltrim(name)) == 1) | F.col(task).isin(known))
    return out if include_server_scored else out.where(~F.col(task).isin(*SERVER_SCORED))


def shape_report(shapes: DataFrame) -> DataFrame:
    """(subtask, shape, ok) of matrices (subtask, shape array<long>, dtype): whether each has the expected shape and holds floats."""
    want = F.create_map(*[x for k, v in MATRIX_SHAPES.items() for x in (F.lit(k), F.array(*[F.lit(n).cast("long") for n in v]))])
    return shapes.select("subtask", "shape", F.coalesce((want[F.col("subtask")] == F.col("shape")) & F.col("dtype").startswith("float"), F.lit(False)).alias("ok"))


def size_report(predictions: DataFrame, expected: DataFrame, keys: list[str], count: str = "expected_rows") -> DataFrame:
    """(keys, expected_rows, found_rows, status) for each key on either side: ok, wrong size, missing or unknown. Keys are compared in lower case."""
    low = [F.lower(F.col(k)).alias(k) for k in keys]
    found = predictions.select(*low).groupBy(*keys).agg(F.count("*").alias("found_rows"))
    both = expected.select(*low, count).join(found, keys, "full")
    status = F.when(F.col(count).isNull(), "unknown").when(F.col("found_rows").isNull(), "missing").when(F.col(count) == F.col("found_rows"), "ok").otherwise("wrong size")
    return both.select(*keys, F.coalesce(count, F.lit(0)).alias("expected_rows"), F.coalesce("found_rows", F.lit(0)).alias("found_rows"), status.alias("status"))


def missing_tasks(found: DataFrame, expected: DataFrame, group: str, task: str) -> DataFrame:
    """(group, task) expected but not found, of groups that have one task at least."""
    begun = found.select(group).distinct()
    return expected.join(begun, group, "left_semi").join(found.select(group, task).distinct(), [group, task], "left_anti").select(group, task)


def step_completeness(rows: DataFrame, steps: DataFrame, step: str, needed: int) -> DataFrame:
    """(step, found_rows, complete) of each expected step."""
    found = rows.groupBy(step).agg(F.count("*").alias("found_rows"))
    out = steps.select(step).distinct().join(found, step, "left").withColumn("found_rows", F.coalesce("found_rows", F.lit(0)))
    return out.withColumn("complete", F.col("found_rows") == needed)


def one_each(predictions: DataFrame, key: str) -> DataFrame:
    """(key, n) of ids with more than one prediction."""
    return predictions.groupBy(key).agg(F.count("*").alias("n")).where("n <> 1")


def remaining(steps: DataFrame, done: DataFrame, step: str) -> DataFrame:
    """Steps that no result has; joined by the step itself, so any subset may be done."""
    return steps.join(done.select(step).distinct(), step, "left_anti")


#: Zero-shot results that a submission needs, by folder under zero_shot/<backend>, and finetuning tasks. Fixed values.
FAST_RESULTS = ["blimp/blimp_fast", "blimp/supplement_fast", "ewok/ewok_fast", "entity_tracking/entity_tracking_fast", "global_piqa_parallel/global_piqa_parallel", "global_piqa_nonparallel/global_piqa_nonparallel", "reading"]
FULL_RESULTS = ["blimp/blimp_filtered", "blimp/supplement_filtered", "ewok/ewok_filtered", "entity_tracking/entity_tracking", "comps/comps", "global_piqa_parallel/global_piqa_parallel", "global_piqa_nonparallel/global_piqa_nonparallel", "reading"]
MULTIMODAL_RESULTS = ["vqa/vqa_filtered", "winoground/winoground_filtered"]
MULTIMODAL_MATRICES = ["lex-viz_vocab.npy", "gram-trog.npy", "sem-things_pairwise_sims.npy"]


def required_paths(revision: str, backend: str, fast: bool, multimodal: bool = False) -> list[str]:
    """Result files that a submission needs of a revision, relative to the model's folder."""
    zero = f"{revision}/zero_shot/{backend}"
    if fast:
        return [f"{zero}/{r}/predictions.json" for r in FAST_RESULTS]
    out = [f"{revision}/finetune/{t}/predictions.json" for t in GLUE_SIZES]
    out += [f"{zero}/{r}/predictions.json" for r in FULL_RESULTS] + [f"{zero}/AoA_word/surprisal.json"]
    if multimodal:
        out += [f"{zero}/{r}/predictions.json" for r in MULTIMODAL_RESULTS] + [f"{revision}/zero_shot/devbench/{m}" for m in MULTIMODAL_MATRICES]
    return out


def missing_paths(spark, folder: str, required: list[str]) -> DataFrame:
    """(path) of required files that a folder, in any store, lacks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    want = spark.createDataFrame([(p,) for p in required], "path string")
    # what stands after the folder's own path, however its scheme is written
    inner = F.substring_index(F.col("path"), "/" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1).alias("path")
    return want.join(files.select(inner).distinct(), "path", "left_anti")


def finite_or_fail(x: Column, message: str) -> Column:
    """x, or an error when a row has no finite value."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(x)


def same_labels(df: DataFrame, group: str, label: str) -> None:
    """Raises if two groups have different sets of labels. One set a group comes to the driver."""
    sets = {r[0]: tuple(r[1]) for r in df.groupBy(group).agg(F.array_sort(F.collect_set(label))).collect()}
    if len(set(sets.values())) > 1:
        raise ValueError(f"labels differ: {sets}")


def positional_join(gold: DataFrame, pred: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of either side with one place in a key's order, as far as the shorter side goes. pred's columns have the prefix pred_."""
    right = numbered(pred, [key], order, "__place")
    right = right.select(F.col(key), F.col("__place").alias("place"), *[F.col(c).alias(f"pred_{c}") for c in pred.columns if c != key])
    return numbered(gold, [key], order, "place").join(right, [key, "place"])


def keyed_join(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Inner join by key; a gold row without prediction is an error when it is read."""
    out = gold.join(pred.withColumn("__there", F.lit(True)), key, "left")
    return out.where(F.coalesce(F.col("__there"), F.raise_error(F.concat(F.lit("no prediction for "), F.col(key).cast("string"))).cast("boolean"))).drop("__there")


#: Places of one bitmap. Fixed value of Spark's bitmap functions.
BITMAP = 32_768


def observed(predictions: DataFrame, expected: list[tuple[str, int]], uid: str = "uid", place: str = "place", value: str = "pred") -> tuple[DataFrame, Observation]:
    """(predictions, what is observed of them): metrics that ride on whatever job reads the rows next, such as their write, so that checking takes no job of its own.

    For each expected subset (name, number of predictions) they count its rows, its rows without
    a value (null, or NaN in numbers) and, in bitmaps of BITMAP places each, which places 0 to
    n - 1 have come; and the rows of no expected subset. Subsets are settings, a few hundred;
    bitmaps take a bit a prediction. See verdict().
    """
    bad = F.col(value).isNull()
    if predictions.schema[value].dataType.typeName() in ("double", "float"):
        bad = bad | F.isnan(value)
    own = [F.coalesce(F.col(uid) == name, F.lit(False)) for name, _ in expected]
    known = F.col(uid).isin([name for name, _ in expected]) if expected else F.lit(False)
    metrics = [F.count("*").alias("rows"), F.count_if(~F.coalesce(known, F.lit(False))).alias("unknown")]
    for k, (c, (_, n)) in enumerate(zip(own, expected, strict=True)):
        metrics += [F.count_if(c).alias(f"n{k}"), F.count_if(c & bad).alias(f"bad{k}")]
        for b in range(-(-n // BITMAP)):
            here = c & (F.col(place) >= b * BITMAP) & (F.col(place) < min(n, (b + 1) * BITMAP))
            bit = F.when(here, F.col(place).cast("long") - b * BITMAP)
            metrics.append(F.bitmap_count(F.bitmap_construct_agg(bit)).alias(f"set{k}_{b}"))
    found = Observation()
    return predictions.observe(found, *metrics), found


def verdict(spark, found: Observation, expected: list[tuple[str, int]]) -> DataFrame:
    """(uid, expected_rows, found_rows, different, bad, status) of each expected subset, from what was observed, and a row of null for rows of no subset if there are any.

    different: how many of its places have come. status: ok; missing; wrong size; repeated, if
    places came twice or out of range; or no value, if a prediction has none.
    """
    got, rows = found.get, []
    for k, (name, n) in enumerate(expected):
        size, bad = got[f"n{k}"], got[f"bad{k}"]
        different = sum(got[f"set{k}_{b}"] or 0 for b in range(-(-n // BITMAP)))
        status = "missing" if not size and n else "wrong size" if size != n else "repeated" if different != n else "no value" if bad else "ok"
        rows.append((name, n, size, different, bad, status))
    if got["unknown"]:
        rows.append((None, 0, got["unknown"], 0, 0, "unknown"))
    return spark.createDataFrame(rows, "uid string, expected_rows long, found_rows long, different long, bad long, status string")
