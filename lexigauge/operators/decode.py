"""Decoders: from rows of benchmark files to ranking records (sentences, prefixes, completions, label, uid, meta).

A decoder is a function from a DataFrame, which may have a column `file` with the file's
path, to one with the columns of a ranking record. DECODERS names them by task; register
adds one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import between, choice_at, clean, file_stem, fill, literal_list, strip

Decoder = Callable[[DataFrame], DataFrame]
DECODERS: dict[str, Decoder] = {}
RESERVED = ("sentences", "completions", "prefixes", "label", "image")


def register(name: str) -> Callable[[Decoder], Decoder]:
    def add(f: Decoder) -> Decoder:
        DECODERS[name] = f
        return f

    return add


def decode(df: DataFrame, task: str) -> DataFrame:
    """The ranking records of a task's rows; an unknown task is an error."""
    if task not in DECODERS:
        raise NotImplementedError(f"no decoder for {task}; there are {', '.join(sorted(DECODERS))}")
    return DECODERS[task](df)


def _record(df: DataFrame, sentences: Column, prefixes: Column, completions: Column, uid: Column, label: Column | None = None, **meta: Column) -> DataFrame:
    pairs = [x for k, v in {"UID": uid, **meta}.items() for x in (F.lit(k), v.cast("string"))]
    keep = [c for c in ("item_id", "ord") if c in df.columns]
    return df.select(*keep, sentences.alias("sentences"), prefixes.alias("prefixes"), completions.alias("completions"), (F.lit(0) if label is None else label).cast("int").alias("label"), uid.cast("string").alias("uid"), F.create_map(*pairs).alias("meta"))


def _nothing() -> Column:
    return F.array(F.lit(None).cast("string"), F.lit(None).cast("string"))


def _joined(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(" "), b)


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


@register("blimp")
def minimal_pair(df: DataFrame) -> DataFrame:
    """Good and bad sentence; rows without a field are supplements and go by their file."""
    both = F.array("sentence_good", "sentence_bad")
    field, uid, term = (_optional(df, c) for c in ("field", "UID", "linguistics_term"))
    stem = file_stem(_optional(df, "file"))
    has = field.isNotNull()
    return _record(df, both, _nothing(), both, F.when(has, uid).otherwise(stem), field=F.when(field == "syntax_semantics", "syntax/semantics").when(has, field).otherwise("supplement"), linguistics_term=F.when(has, term).otherwise("supplement"))


@register("ewok")
def context_pair(df: DataFrame) -> DataFrame:
    """One target after two contexts."""
    contexts = F.array("Context1", "Context2")
    return _record(df, F.transform(contexts, lambda c: _joined(c, F.col("Target1"))), contexts, F.transform(contexts, lambda _: F.concat(F.lit(" "), F.col("Target1"))), F.col("Domain"), context_type=F.col("ContextType"), context_contrast=F.col("ContextDiff"), target_contrast=F.col("TargetDiff"))


@register("entity_tracking")
def state_options(df: DataFrame) -> DataFrame:
    """Options after a prefix, the first right; rows with an option that says nothing are left out."""
    df = df.where(~F.exists("options", lambda o: o.contains("nothing")))
    uid = F.concat(file_stem(_optional(df, "file")), F.lit("_"), F.col("numops").cast("string"), F.lit("_ops"))
    return _record(df, F.transform("options", lambda o: F.concat(F.col("input_prefix"), o)), F.transform("options", lambda _: F.col("input_prefix")), F.col("options"), uid)


#: Subsets of property pairs by file. Fixed values; any other file is wugs_dist_in_between.
PROPERTY_FILES = {"comps_base": "base", "comps_wugs": "wugs", "comps_wugs_dist-before": "wugs_dist_before"}


@register("comps")
def property_pair(df: DataFrame) -> DataFrame:
    stem = file_stem(_optional(df, "file"))
    uid = F.lit("wugs_dist_in_between")
    for name, subset in PROPERTY_FILES.items():
        uid = F.when(stem == name, subset).otherwise(uid)
    prefixes = F.array("prefix_acceptable", "prefix_unacceptable")
    return _record(df, F.transform(prefixes, lambda p: _joined(p, F.col("property_phrase"))), prefixes, F.transform(prefixes, lambda _: F.col("property_phrase")), uid)


@register("vqa")
def question_answers(df: DataFrame) -> DataFrame:
    """The right answer, then the distractors, however many."""
    answers = F.concat(F.array("target_ans"), F.col("distractors"))
    return _record(df, F.transform(answers, lambda a: _joined(F.col("question"), a)), F.transform(answers, lambda _: F.col("question")), F.transform(answers, lambda a: F.concat(F.lit(" "), a)), F.lit("vqa"))


@register("winoground")
def captions(df: DataFrame) -> DataFrame:
    both = F.array("caption_0", "caption_1")
    return _record(df, both, _nothing(), both, F.lit("winoground"), **{"Type": F.col("collapsed_tag"), "Linguistic Feature": F.col("tag"), "Linguistic Sub-Feature": _joined(F.col("tag"), F.col("secondary_tag"))})


def _solutions(n: int) -> Decoder:
    def run(df: DataFrame) -> DataFrame:
        """Solutions to a prompt, the right one by the row's label; each example is its own uid."""
        own = F.array(*[f"solution{k}" for k in range(n)])
        return _record(df, F.transform(own, lambda s: _joined(F.col("prompt"), s)), F.transform(own, lambda _: F.col("prompt")), F.transform(own, lambda s: F.concat(F.lit(" "), s)), F.col("example_id"), F.col("label"))

    return run


DECODERS |= {"global_piqa_parallel": _solutions(4), "global_piqa_nonparallel": _solutions(2)}

#: Text pairs of classification tasks: columns of either side, and a template for several. Fixed values.
PAIRS: dict[str, tuple[list[str], list[str], str | None]] = {
    "boolq": (["question"], ["passage"], None),
    "cola": (["sentence"], [], None),
    "mnli": (["premise"], ["hypothesis"], None),
    "mrpc": (["sentence1"], ["sentence2"], None),
    "multirc": (["question", "answer"], ["paragraph"], "Question: {} Answer: {}"),
    "qnli": (["question"], ["sentence"], None),
    "qqp": (["question1"], ["question2"], None),
    "rte": (["sentence1"], ["sentence2"], None),
    "sst2": (["sentence"], [], None),
    "wsc": (["span2_text", "span1_text"], ["text"], 'Does "{}" refer to "{}" in this passage?'),
}


def text_pair(df: DataFrame, task: str) -> DataFrame:
    """(text_a, text_b, and label where there is one) of a classification task."""
    if task not in PAIRS:
        raise ValueError(f"no text pair for {task}")
    a, b, template = PAIRS[task]
    first = fill(template, *[F.col(c) for c in a]) if template else F.col(a[0])
    second = F.col(b[0]) if b else F.lit(None).cast("string")
    keep = [c for c in ("idx", "label") if c in df.columns]
    return df.select(*keep, first.alias("text_a"), second.alias("text_b"))


#: Names of sentence columns, in the order in which they are looked for. Fixed values.
_KNOWN_COLUMNS = (("sentence1", "sentence2"), ("question1", "question2"), ("premise", "hypothesis"), ("question", "passage"), ("question", "sentence"))


def sentence_columns(columns: list[str]) -> tuple[list[str], list[str], str | None]:
    """Which columns hold a data set's texts, and the template that joins several: known names first, else the first two but label and idx."""
    own = [c for c in columns if c not in ("label", "idx")]
    have = set(own)
    for a, b in _KNOWN_COLUMNS:
        if {a, b} <= have:
            return [a], [b], None
    for task in ("multirc", "wsc"):
        a, b, template = PAIRS[task]
        if {*a, *b} <= have:
            return a, b, template
    if {"sentence", "linguistic_feature_type"} <= have:
        return ["sentence"], [], None
    return own[:1], own[1:2], None


def options_prompt(question: Column, options: list[Column], mark: str = ".", passage: Column | None = None) -> Column:
    """A question with lettered options, one a line; mark stands after each letter."""
    lines = [strip(passage)] if passage is not None else []
    lines += [strip(question), *[F.concat(F.lit(f"{'ABCDE'[k]}{mark} "), strip(o)) for k, o in enumerate(options)]]
    return F.concat(F.concat_ws("\n", *[F.coalesce(x, F.lit("")) for x in lines]), F.lit("\n"))


def cause_or_effect(question: Column, premise: Column, choice: Column) -> Column:
    """A choice before its premise if it is the cause, after it if the effect; empty otherwise."""
    premise, choice = strip(premise), strip(choice)
    return F.when(strip(question) == "cause", _joined(choice, premise)).when(strip(question) == "effect", _joined(premise, choice)).otherwise("")


#: Codes and names of languages. Fixed values.
THREE_LETTERS = {
    "bg": "bul", "zh": "zho", "nl": "nld", "en": "eng", "fr": "fra", "de": "deu", "id": "ind", "fa": "pes", "uk": "ukr", "af": "afr", "ar": "arb", "eu": "eus", "et": "est", "el": "ell", "he": "heb",
    "it": "ita", "ja": "jpn", "pl": "pol", "pt": "por", "sr": "srp", "es": "spa", "sv": "swe", "cy": "cym", "yue": "yue", "ace": "ace", "ban": "ban", "bug": "bug", "hr": "hrv", "cs": "ces", "da": "dan",
    "hu": "hun", "is": "isl", "jv": "jav", "ko": "kor", "mak": "mak", "min": "min", "no": "nob", "nso": "nso", "ro": "ron", "ru": "rus", "st": "sot", "su": "sun", "tr": "tur", "xh": "xho", "zu": "zul",
}
LANGUAGE_NAMES = {
    "sq": "Albanian", "bg": "Bulgarian", "ms": "Malay", "nl": "Dutch", "ko": "Korean", "mk": "North Macedonian", "sr": "Serbian", "ml": "Malayalam", "vi": "Vietnamese", "hi": "Hindi", "ja": "Japanese",
    "de": "German", "et": "Estonian", "lt": "Lithuanian", "hu": "Hungarian", "ur": "Urdu", "uz": "Uzbek", "te": "Telugu", "kk": "Kazakh", "tr": "Turkish", "ru": "Russian", "ka": "Georgian", "it": "Italian",
    "tl": "Tagalog", "el": "Greek", "pt": "Portuguese", "he": "Hebrew", "fi": "Finnish", "pl": "Polish", "hr": "Croatian", "fr": "French", "be": "Belarusian", "hy": "Armenian", "az": "Azerbaijani",
    "es": "Spanish", "ta": "Tamil", "zh": "Chinese", "fa": "Persian", "id": "Indonesian", "ar": "Arabic", "ne": "Nepali", "uk": "Ukrainian", "bn": "Bengali", "eu": "Basque",
}
#: How prompt data sets name their parts. Fixed values.
PROMPT_PARTS = {"arc": "ARCEasyDataset", "bmlama": "BMLAMADataset", "mmlu": "MMLUDataset", "truthfulqa": "TruthfulQADataset", "mnli": "MNLIDataset"}


def dataset_config(dataset: str, language: str, subtask: str | None = None, scripts: dict[str, str] | None = None) -> tuple[str, dict[str, str]]:
    """The configuration name of a data set in a language, and which columns its unified records come from. scripts: full codes (bul_Cyrl) by language. Unknown ones are errors."""

    def known(table: dict[str, str] | None) -> str:
        if language not in (table or {}):
            raise ValueError(f"{dataset} has no language {language}")
        return table[language]

    pair = {"premise": "premise", "hypothesis": "hypothesis", "label": "label"}
    prompt = {"sentence": "prompt", "label": "label"}
    if dataset in ("facebook/xnli", "HiTZ/xnli-eu"):
        return language, pair
    if dataset == "masakhane/afrixnli":
        return known(THREE_LETTERS), pair
    if dataset == "masakhane/afrimmlu":
        return known(THREE_LETTERS), {"sentence": "question", "label": "answer"}
    if dataset == "Davlan/sib200":
        return known(scripts), {"sentence": "text", "label": "category", "idx": "index_id"}
    if dataset == "facebook/belebele":
        return known(scripts), prompt
    if dataset == "CohereLabs/include-base-44":
        return known(LANGUAGE_NAMES), prompt
    if dataset == "CohereLabs/Global-MMLU":
        return language, {"sentence": "question", "label": "answer"}
    if dataset in ("cambridgeltl/xcopa", "pkavumba/balanced-copa", "HiTZ/XCOPA-eu"):
        return language, {"sentence1": "premise", "sentence2": "premise", "label": "label"}
    if dataset == "aialt/MuBench" and subtask in PROMPT_PARTS:
        return f"{PROMPT_PARTS[subtask]}_en_template_{language}", pair if subtask == "mnli" else prompt
    raise ValueError(f"unknown data set {dataset} {subtask or ''}".strip())


LETTERS = ("A", "B", "C", "D", "E")


def unified(df: DataFrame, dataset: str, subtask: str | None = None) -> DataFrame:
    """Unified finetuning records (idx, sentence or premise/hypothesis or sentence1/sentence2, label) of a known data set."""
    letters = F.array(*map(F.lit, LETTERS))
    idx = F.col("idx") if "idx" in df.columns else F.lit(None).cast("long")
    if dataset == "belebele":
        options = [F.col(f"mc_answer{k}") for k in range(1, 5)]
        return df.select(idx.alias("idx"), options_prompt(F.col("question"), options, ":", F.col("flores_passage")).alias("sentence"), choice_at(letters, F.col("correct_answer_num").cast("int") - 1).alias("label"))
    if dataset in ("include", "global_mmlu"):
        options = [F.col(f"option_{c}") for c in "abcd"]
        label = choice_at(letters, F.col("answer").cast("int")) if dataset == "include" else F.col("answer")
        return df.select(idx.alias("idx"), options_prompt(F.col("question"), options).alias("sentence"), label.alias("label"))
    if dataset == "afrimmlu":
        choices = literal_list(F.col("choices"))
        return df.select(idx.alias("idx"), options_prompt(F.col("question"), [F.get(choices, F.lit(k)) for k in range(4)]).alias("sentence"), F.col("answer").alias("label"))
    if dataset == "xcopa":
        sides = [cause_or_effect(F.col("question"), F.col("premise"), F.col(c)) for c in ("choice1", "choice2")]
        return df.select(idx.alias("idx"), sides[0].alias("sentence1"), sides[1].alias("sentence2"), F.col("label").cast("string").alias("label"))
    if dataset == "mubench":
        label = choice_at(F.col("choices"), F.col("label").try_cast("int")) if subtask in ("arc", "bmlama", "mmlu", "mnli", "truthfulqa") else F.col("label").cast("string")
        if subtask == "mnli":
            prompt = strip(F.col("prompt"))
            return df.select(idx.alias("idx"), between(prompt, r"Premise:\s*", r"\nHypothesis:").alias("premise"), between(prompt, r"Hypothesis:\s*", r"\s*Question:").alias("hypothesis"), label.alias("label"))
        return df.select(idx.alias("idx"), clean(F.col("prompt"), subtask or "default").alias("sentence"), label.alias("label"))
    if dataset == "sib200":
        return df.select(F.col("index_id").alias("idx"), clean(F.col("text")).alias("sentence"), F.col("category").alias("label"))
    if dataset == "xnli":
        return df.select(idx.alias("idx"), clean(F.col("premise")).alias("premise"), clean(F.col("hypothesis")).alias("hypothesis"), F.col("label").cast("string").alias("label"))
    raise ValueError(f"unknown data set {dataset}")


def metadata(df: DataFrame) -> DataFrame:
    """Each record once for each of its grouping keys: (item_id, key, value)."""
    return df.select("item_id", F.explode("meta").alias("key", "value"))


def swapped(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Each row twice, the second time with each pair of columns exchanged; `turned` tells which. One scan, no union."""
    exchange = dict(pairs) | {b: a for a, b in pairs}
    twice = df.withColumn("turned", F.explode(F.array(F.lit(0), F.lit(1))))
    return twice.select(*[F.when(F.col("turned") == 1, F.col(exchange[c])).otherwise(F.col(c)).alias(c) if c in exchange else F.col(c) for c in df.columns], "turned")


def step_rows(steps: DataFrame, contexts: DataFrame) -> DataFrame:
    """Every context of every word at every step: contexts (word, contexts array<string>), steps (step); the ladder of steps is short by nature and broadcast."""
    each = contexts.select("word", F.posexplode("contexts").alias("context_id", "context"))
    return each.crossJoin(F.broadcast(steps.select("step").distinct()))


def with_images(records: DataFrame, images: DataFrame, index: str) -> DataFrame:
    """Records with the image whose position in its data set they name; a record without one keeps null. images: (position, image)."""
    return records.join(images.withColumnRenamed("position", index), index, "left")


def remap_word_ids(word_ids: Column, labels: Column) -> tuple[Column, Column]:
    """Words that survive truncation numbered from 0 in order of appearance, with -1 for special tokens, and their labels."""
    kept = F.array_distinct(F.filter(word_ids, lambda w: w.isNotNull()))
    ids = F.transform(word_ids, lambda w: F.when(w.isNull(), -1).otherwise((F.array_position(kept, w) - 1).cast("int")))
    return ids, F.transform(kept, lambda w: F.get(labels, w))


def two_scores(resps: Column, target: Column, acc: Column) -> tuple[Column, Column]:
    """Of a logged sample with two finite scores: the index of the greater (the first of equals), and whether an unknown token made it wrong. Anything else is an error when it is read."""
    scores = F.transform(resps, lambda r: F.get(r, F.lit(0)).try_cast("double"))
    ok = (F.size(scores) == 2) & F.forall(scores, lambda s: s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf")))
    pred = F.when(ok, (F.get(scores, F.lit(1)) > F.get(scores, F.lit(0))).cast("int")).otherwise(F.raise_error(F.lit("a sample needs two finite scores")).cast("int"))
    return pred, (pred == target.cast("int")) & (acc == 0)
