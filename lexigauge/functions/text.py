"""String expressions. All are built-in functions, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of Unicode, which Spark's trim leaves.
SPACE = r"[\s\x1c-\x1f\u0085   -     　]"

#: A run of SPACE, by Java's own class of Unicode's white space, which is tried much faster than the characters one by one.
SPACES = r"(?U)[\s\x1c-\x1f]+"

#: Marks that end a sentence before white space: a single full stop and its likes. Two stops or more in a row don't.
ENDS = r"(?:(?<!\.)\.(?!\.)|[!?։؟۔।॥။።‼‽⁇⁈⁉。！．？｡])"

#: Patterns that clean prompts, by data set; all ignore case. Fixed values.
CLEANING = {
    "truthfulqa": r"Question:\s*|Answer:\s*|Answer\s+with\s+A,\s*B,\s*C,\s*D,\s*\.\.\.",
    "mmlu": r"Question:\s*|Choice\s|Answer with\s*(?:,\s*)*.*?\nAnswer:",
    "arc": r"Question:\s*|Answer with\s*[A-D](?:,\s*[A-D])*.*?\nAnswer:",
    "bmlama": r"Question:\s*|Answer with\s*[A-D](?:,\s*[A-D])*.*?\nAnswer:",
    "default": r"Answer\s+with\s+A,\s*B,\s*C,\s*D,\s*\.\.\.",
}


def strip(x: Column) -> Column:
    """x without white space at its ends, that of Unicode included."""
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def words(x: Column) -> Column:
    """The parts of x between white space."""
    return F.filter(F.split(x, SPACES), lambda w: w != "")


def sentences(x: Column) -> Column:
    """The sentences of x: each ends at a mark of ENDS, with the marks that follow it, before white space, and the last at the end of x."""
    return F.regexp_extract_all(x, F.lit(f"(?s)(?!{SPACE}).+?(?:{ENDS}\\p{{P}}*(?={SPACE}|\\z)|\\z)"), F.lit(0))


def clean(x: Column, kind: str = "default") -> Column:
    """x without the phrases of its data set's prompts; dots match line ends in all but two of the patterns, where it makes no difference."""
    return strip(F.regexp_replace(strip(x), "(?is)" + CLEANING.get(kind, CLEANING["default"]), ""))


def between(x: Column, before: str, after: str) -> Column:
    """What stands between two patterns, ignoring case, over line ends; empty if they don't."""
    return strip(F.regexp_extract(x, f"(?is){before}(.*?){after}", 1))


#: Fixed value.
MAGNITUDE = r"(?i)(\d+(?:\.\d+)?)\s*([KMB]?)"


def magnitude(x: Column) -> Column:
    """The number in a name such as chck_10M, with K, M and B as thousands, millions and billions; null without digits."""
    number = F.regexp_extract(x, MAGNITUDE, 1)
    unit = F.upper(F.regexp_extract(x, MAGNITUDE, 2))
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.when(number != "", number.cast("double") * factor)


def normal_id(x: Column) -> Column:
    """An id that was read as a number in some files and as text in others: 1.0 and 1 are one."""
    return F.when(x.cast("string").rlike(r"^[+-]?\d+\.0+$"), F.regexp_replace(x.cast("string"), r"\.0+$", "")).otherwise(x.cast("string"))


def gold_index(gold: Column, choices: Column) -> Column:
    """The index of the right choice, given by its text, by a number, or by digits; -100 otherwise."""
    text = gold.cast("string")
    at = F.array_position(choices, text) - 1
    return F.when(at >= 0, at.cast("int")).when(text.rlike(r"^\d+$"), text.try_cast("int")).otherwise(F.lit(-100))


def choice_at(choices: Column, index: Column) -> Column:
    """The choice at an index, null outside the list."""
    return F.get(choices, index)


def fill(template: str, *values: Column) -> Column:
    """template with each {} filled in turn."""
    parts = template.split("{}")
    out: list[Column] = [F.lit(parts[0])]
    for value, rest in zip(values, parts[1:], strict=True):
        out += [value, F.lit(rest)]
    return F.concat(*out)


def starred(x: Column) -> tuple[Column, Column]:
    """Of prefix*target*: prefix and target."""
    parts = F.split(x, r"\*")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def literal_list(x: Column) -> Column:
    """The strings of a list written as a Python literal, with quotes of either kind."""
    double = F.regexp_replace(F.regexp_replace(x, '"', '\\\\\\\\"'), r"(?<=[\[,]\s{0,4})'|'(?=\s*[\],])", '"')
    return F.coalesce(F.from_json(x, "array<string>"), F.from_json(double, "array<string>"))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def languages_of_model(name: Column) -> Column:
    """Sorted training languages that a model's name tells: strict names are English, babylm-<language> names one, mixtures name each. The parts of names are fixed values."""
    low = F.lower(name)
    listed = F.array_compact(F.array(F.when(low.contains("en_") | low.startswith("en"), "eng"), F.when(low.contains("nld"), "nld"), F.when(low.contains("zho"), "zho")))
    return F.when(low.contains("strict"), F.array(F.lit("eng"))).when(low.contains("babylm-nld"), F.array(F.lit("nld"))).when(low.contains("babylm-zho"), F.array(F.lit("zho"))).otherwise(listed)


def task_language(task: Column, prefix: str, codes: dict[str, str]) -> Column:
    """The two-letter code of a task named <prefix>_<three letters>_<script>; codes: three letters by two. Null if unknown."""
    three = F.regexp_extract(task, f"^{prefix}_([a-z]{{3}})_[A-Za-z]+$", 1)
    table = F.create_map(*[F.lit(x) for two, code in codes.items() for x in (code, two)])
    return table[three]


def in_all_vocabulary(token_lists: Sequence[Column], vocabulary: Column) -> Column:
    """Whether all tokens of all lists are in a (small) vocabulary array; see vocabulary_filter for large ones."""
    return F.forall(F.concat(*token_lists), lambda t: F.array_contains(vocabulary, t))


#: The published Treebank word rules, in the order in which they apply: a pattern and what it becomes. Fixed values.
TREEBANK = (
    ("([«“‘„]|[`]+)", " $1 "),
    ('^"', "``"),
    ("(``)", " $1 "),
    (r"""([ (\[{<])("|'{2})""", "$1 `` "),
    (r"(?i)(')(?!re|ve|ll|m|t|s|d|n)(\w)\b", "$1 $2"),
    (r"""([^.])(\.)([\])}>"'»”’ ]*)\s*$""", "$1 $2 $3 "),
    (r"([:,])([^\d])", " $1 $2"),
    (r"([:,])$", " $1 "),
    (r"\.{2,}", " $0 "),
    (r"[;@#$%&]", " $0 "),
    (r"""([^.])(\.)([\])}>"']*)\s*$""", "$1 $2$3 "),
    (r"[?!]", " $0 "),
    (r"([^'])' ", "$1 ' "),
    (r"[*]", " $0 "),
    (r"[\]\[(){}<>]", " $0 "),
    (r"--", " -- "),
    (r"^|$", " "),
    ("([»”’])", " $1 "),
    (r"''", " '' "),
    (r'"', " '' "),
    (r"\s+", " "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    (r"(?i)\b(can)(not)\b", " $1 $2 "),
    (r"(?i)\b(d)('ye)\b", " $1 $2 "),
    (r"(?i)\b(gim)(me)\b", " $1 $2 "),
    (r"(?i)\b(gon)(na)\b", " $1 $2 "),
    (r"(?i)\b(got)(ta)\b", " $1 $2 "),
    (r"(?i)\b(lem)(me)\b", " $1 $2 "),
    (r"(?i)\b(more)('n)\b", " $1 $2 "),
    (r"(?i)\b(wan)(na)(?=\s)", " $1 $2 "),
    (r"(?i) ('t)(is)\b", " $1 $2 "),
    (r"(?i) ('t)(was)\b", " $1 $2 "),
)


#: What a text has if rules other than those of commas and a final stop can apply to it.
_MARKED = r"""(?i)['"`«»“”‘’„;:@#$%&*?!\[\](){}<>]|--|\.\.|cannot|gimme|gonna|gotta|lemme|wanna"""
_PLAIN_RULES = (5, 6, 7)


def treebank_words(x: Column, by_sentence: bool = True) -> Column:
    """The words of x by the Treebank rules: quotes, marks, brackets and a final stop stand alone, contractions are cut (do n't, it 's, can not).

    by_sentence: the rules apply to each sentence (see `sentences`), so that each final stop
    is cut off; without it only the last one is. Null has no words.
    """

    def cut(s: Column) -> Column:
        every = plain = s
        for k, (pattern, instead) in enumerate(TREEBANK):
            every = F.regexp_replace(every, "(?U)" + pattern, instead)
            plain = F.regexp_replace(plain, "(?U)" + pattern, instead) if k in _PLAIN_RULES else plain
        return words(F.when(s.rlike(_MARKED), every).otherwise(plain))

    out = F.flatten(F.transform(sentences(x), cut)) if by_sentence else cut(x)
    return F.coalesce(out, F.array().cast("array<string>"))
